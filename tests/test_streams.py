"""Streams in order of event time: one source in any split and order gives the batch result."""

import datetime as dt
import random

import pytest

from millrace.streaming import ordered as S
from millrace.streaming.stateful import drained

START = dt.datetime(2024, 1, 1)
LATE = 5000


def in_files(spark, folder, rows, parts, seed):
    """The rows as so many files, dealt by a jittered time, so that none is too late; each is a trigger."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(LATE - 1))
    cut = [len(order) * k // parts for k in range(parts + 1)]
    for a, b in zip(cut, cut[1:]):
        part = [(k, START + dt.timedelta(seconds=t), i) for k, t, i in order[a:b]]
        spark.createDataFrame(part, "user long, ts timestamp, id long").coalesce(1).write.mode("append").parquet(folder)
    S.with_state_store(spark)
    return spark.readStream.schema("user long, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(folder)


def some(seed):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(60_000), i) for i in range(300)]


def passed(rows):
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    w = max(t for _, t, _ in rows) - LATE
    return base, w, sorted((r for r in rows if r[1] <= w), key=lambda r: (r[1], r[2]))


@pytest.mark.parametrize("parts", [1, 3])
def test_alerts(spark, tmp_path, parts):
    rows = some(1)
    stream = in_files(spark, f"{tmp_path}/in", rows, parts, parts)
    got = sorted(map(tuple, drained(S.alert_timeline(stream, "user", "ts", "id", f"{LATE} seconds", 700, 3000), "append", "t").collect()), key=repr)
    base, w, ordered = passed(rows)
    want, open_, page = [], {}, {}
    for k, t, _ in ordered:
        if k in open_ and t - open_[k][0] > 700:
            want.append((k, base + open_[k][0] + 700, "resolved", open_.pop(k)[1]))
        if k not in open_:
            want.append((k, base + t, "opened", 1))
        open_[k] = (t, open_.get(k, (0, 0))[1] + 1)
        if k not in page or t - page[k] >= 3000:
            page[k] = t
            want.append((k, base + t, "paged", open_[k][1]))
    want += [(k, base + t + 700, "resolved", n) for k, (t, n) in open_.items() if t + 700 <= w]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_guard_and_limiter(spark, tmp_path, parts):
    rows = some(2)
    _, _, ordered = passed(rows)
    stream = in_files(spark, f"{tmp_path}/in", rows, parts, parts)
    got = {r.id: (r.n, r.state) for r in drained(S.guarded(stream, "user", "ts", "id", f"{LATE} seconds", 900, 3), "append", "g").collect()}
    held, want = {}, {}
    for k, t, i in ordered:
        held[k] = [x for x in held.get(k, []) if x >= t - 900] + [t]
        n = len(held[k])
        want[i] = (n, "block" if n > 3 else "warn" if n == 3 else "pass")
    assert got == want
    got = {r.id: r.accepted for r in drained(S.limited(stream, "user", "ts", "id", f"{LATE} seconds", 2, 900), "append", "l").collect()}
    held, want = {}, {}
    for k, t, i in ordered:
        held[k] = [x for x in held.get(k, []) if x >= t - 900]
        want[i] = len(held[k]) < 2
        if want[i]:
            held[k].append(t)
    assert got == want
