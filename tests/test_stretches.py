"""Tours sum up straight stretches before pointers are doubled."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import layout as L


def by_recursion(rows):
    below = {}
    for i, p, s in rows:
        below.setdefault(p, []).append((s, i))
    out, leaf = {}, [0]

    def walk(i, depth):
        first, total = leaf[0], i
        for _, c in sorted(below.get(i, [])):
            total += walk(c, depth + 1)
        leaf[0] += i not in below
        out[i] = (depth, first, leaf[0] - first, total)
        return total

    for _, r in sorted(below.get(None, [])):
        walk(r, 0)
    return out


@pytest.mark.parametrize("size", [7, 4096])
def test_ranges_cut_stretches(spark, monkeypatch, size):
    monkeypatch.setattr(L, "_RANGE", size)
    rng = random.Random(size)
    rows = [(1, None, 1), (2, None, 0), *[(i, rng.choice([1, 2, 3, 4, 5]) if i > 5 else rng.choice([1, 2]), rng.randrange(9)) for i in range(3, 90)]]
    rows += [(200, 201, 0), (201, 200, 0), (202, 999, 0), (203, 202, 0), (204, 202, 1)]  # a ring, and nodes below nothing
    found = L.toured(spark.createDataFrame(rows, "id long, parent_id long, s int"), ["s"], {"n": F.col("id")}).collect()
    assert {r.id: (r.depth, r.leaf_at, r.leaves, r.n) for r in found} == by_recursion(rows)


def test_a_star_doubles_few_rows(spark, monkeypatch):
    rows = [(0, None, 0), *[(i, 0, i) for i in range(1, 3001)]]
    counts, written = [], L.written

    def seen(df, label):
        out = written(df, label)
        if label == "doubled":
            counts.append(out.count())
        return out

    monkeypatch.setattr(L, "written", seen)
    found = L.toured(spark.createDataFrame(rows, "id long, parent_id long, s int"), ["s"]).collect()
    assert {r.id: r.leaf_at for r in found} == {0: 0, **{i: i - 1 for i in range(1, 3001)}}
    assert counts and max(counts) <= 10
