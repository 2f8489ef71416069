"""The sign-flip test against all flips, and on a group that is large."""

from itertools import product

from millrace.operators import evaluation as E


def exact(d):
    sums = [abs(sum(s * x for s, x in zip(signs, d))) for signs in product((-1, 1), repeat=len(d))]
    return sum(x >= abs(sum(d)) - 1e-9 for x in sums) / len(sums)


def test_by_brute_force(spark):
    groups = {"a": [0.5, -0.2, 0.7, 0.7, 0.7, 0.1, -0.4, 0.3, 0.9, -0.1], "b": [1.0, 1.0, 1.0, -1.0, 2.5, 0.0], None: [3.0, 2.0, 1.0], "even": [0.0, 0.0]}
    rows = spark.createDataFrame([(g, x + 1, 1.0) for g, d in groups.items() for x in d] + [("a", None, 1.0), ("a", float("nan"), 1.0), ("none", None, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in E.permutation_test(rows, "g", "x", "y").collect()}
    for g, d in groups.items():
        assert got[g].n == len(d) and abs(got[g].p - exact(d)) < 0.02, g
    assert (got["none"].n, got["none"].p) == (0, None)
    assert {r.g: r.p for r in E.permutation_test(rows.repartition(7), "g", "x", "y").collect()} == {g: r.p for g, r in got.items()}


def test_large_group_is_flipped_too(spark):
    # Three pairs of 150,003 differ: a quarter of the flips is as extreme, where a normal law would say 0.083.
    rows = spark.range(150_003).selectExpr("'a' AS g", "if(id < 3, 1.0D, 0.0D) AS x", "0.0D AS y")
    r = E.permutation_test(rows, "g", "x", "y").first()
    assert r.n == 150_003 and abs(r.p - 0.25) < 0.02
