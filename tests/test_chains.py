"""Chains of kept rows and folds, by plain loops."""

import random

from pyspark.sql import functions as F

from millrace.operators import chains
from millrace.operators.tickets import ticket_states


def plain(rows, gap, inclusive):
    last, kept = {}, set()
    for key, t, item in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if key not in last or t - last[key] > gap or (inclusive and t - last[key] == gap):
            last[key] = t
            kept.add(item)
    return kept


def test_spaced(spark):
    rng = random.Random(6)
    # Half of the rows have one key, which many ranges share; some spacings are even, so that chains never meet.
    for gap, inclusive in ((7, False), (7, True), (40, False), (0, False), (1000, True)):
        rows = [(rng.choice([1, 1, 2, None, rng.randrange(40)]), rng.randrange(900), i) for i in range(1500)] + [(77, 2 * k, 5000 + k) for k in range(600)] + [(5, None, 9999)]
        df = spark.createDataFrame(rows, "k int, t long, id long")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        try:
            got = {r.id for r in chains.spaced(df, ["k"], F.col("t"), "id", gap, inclusive).collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == plain(rows, gap, inclusive)
    assert chains.spaced(df.limit(0), ["k"], F.col("t"), "id", 5).count() == 0


def test_spaced_every_five_hours(spark):
    df = spark.createDataFrame([("a", h * 3600, h) for h in (0, 5, 10, 15)], "k string, t long, id int")
    assert {r.id for r in chains.spaced(df, ["k"], F.col("t"), "id", 6 * 3600, inclusive=True).collect()} == {0, 10}


def test_folded(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.randrange(9)) for i in range(500)]

    def step(state, row):
        state["total"] = 2 * state["total"] % 1001 + row["v"]
        state["n"] += 1

    got = chains.folded(spark.createDataFrame(rows, "k int, i long, v long"), "k", ["i"], ["v"], lambda: {"total": 0, "n": 0}, step, "total long, n long").collect()
    want = {}
    for k, _, v in rows:
        total, n = want.get(k, (0, 0))
        want[k] = (2 * total % 1001 + v, n + 1)
    assert {r.k: (r.total, r.n) for r in got} == want


def test_ticket_states(spark):
    logs = {
        1: ["reply", "close", "customer", "close"],
        2: ["note", "escalate", "reply", "internal"],
        3: ["close", "customer", "customer", "escalate", "open"],
    }
    rows = [(k, i, a, 100 * (i + 1), 0) for k, actions in logs.items() for i, a in enumerate(actions)]
    got = {r.id: tuple(r)[1:] for r in ticket_states(spark.createDataFrame(rows, "id int, i int, action string, t long, created long"), "id", ["i"]).collect()}
    day = 86400
    assert got == {
        1: ("closed", "normal", 100, 400, None, 300 + 3 * day, 1),
        2: ("in_progress", "high", 100, None, 200, day, 0),
        3: ("pending", "high", None, None, 400, day, 1),
    }
