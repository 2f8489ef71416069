"""The bootstrap against plain resampling, and groups that are large, empty or null."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import evaluation as E


def test_by_plain_resampling(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0.1, 1, 300).round(2).tolist(), "b": [1.0] * 50 + [0.0] * 70, None: rng.normal(-0.2, 1, 200).round(1).tolist()}
    rows = spark.createDataFrame([(g, x) for g, d in groups.items() for x in d] + [("a", None), ("a", float("nan")), ("none", None)], "g string, x double")
    got = {r.g: r for r in E.bootstrap(rows, "g", F.col("x")).collect()}
    for g, d in groups.items():
        means = np.array([np.mean(rng.choice(d, len(d))) for _ in range(4000)])
        assert got[g].n == len(d) and abs(got[g].mean - np.mean(d)) < 1e-6
        spread = means.std()
        assert abs(got[g].low - np.percentile(means, 2.5)) < 0.25 * spread and abs(got[g].high - np.percentile(means, 97.5)) < 0.25 * spread
        assert abs(got[g].p - ((means <= 0 if np.mean(d) >= 0 else means >= 0).sum() + 1) / 4001) < 0.03
    assert (got["none"].n, got["none"].low, got["none"].p) == (0, None, None)
    assert sorted(map(str, E.bootstrap(rows.repartition(7), "g", F.col("x")).collect())) == sorted(map(str, got.values()))


def test_large_group(spark):
    r = E.bootstrap(spark.range(200_000).selectExpr("'a' AS g", "cast(id % 2 AS double) AS x"), "g", F.col("x")).first()
    assert r.n == 200_000 and abs(r.low - (0.5 - 1.96 * 0.5 / 200_000**0.5)) < 2e-4 and abs(r.high - (0.5 + 1.96 * 0.5 / 200_000**0.5)) < 2e-4
