"""Ranking metrics, calibration, agreement and resampling statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import written
from .ordered import dealt


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query (query_id): hit, reciprocal rank, recall, precision (by k) and binary nDCG at k; ranked has item, rank; relevant has item."""
    n = relevant.groupBy("query_id").agg(F.countDistinct("item").alias("n_rel"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant.select("query_id", "item").distinct(), ["query_id", "item"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    j = n.join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("query_id", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) > 0).cast("int").alias("hit"), F.round(zero(1.0 / F.col("first")), 6).alias("rr"), F.round(zero(F.col("found") / F.col("n_rel")), 6).alias("recall"), F.round(zero(F.col("found") / float(k)), 6).alias("precision"), F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p, m = hits / n, z * z
    centre, half = p + m / (2 * n), z * F.sqrt(p * (1 - p) / n + m / (4 * n * n))
    return (centre - half) / (1 + m / n), (centre + half) / (1 + m / n)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance: one row n, kappa."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("r")), cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("c"))
    chance = rows.join(columns, "v").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("c")), F.lit(0.0)).alias("chance"))
    one = total.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total").cast("double") * F.col("total"))
    return one.select(F.col("total").alias("n"), F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def recall_of(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per query the share of the exact k nearest that the approximate ones have."""
    both = exact.join(approximate.select("query_id", "item").distinct(), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count("*").alias("common"))
    return exact.select("query_id").distinct().join(both, "query_id", "left").select("query_id", F.round(F.coalesce("common", F.lit(0)) / float(k), 6).alias("recall"))


def _flipped(rounds: int, seed: int):
    """Of rows g, d, m, h (m pairs of group g that differ by d; h a hash of both): partial sums g, round, s over sign flips.

    The signs of m equal differences add up to 2 x - m, x being binomial of m and 1/2; h and the seed name the draw, so it
    does not depend on the rows' order or partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        kind = None

        def given() -> Iterator[pa.RecordBatch]:
            for g, s in held.values():
                yield pa.RecordBatch.from_arrays([pa.array([g] * rounds, kind), pa.array(np.arange(rounds)), pa.array(s)], ["g", "round", "s"])
            held.clear()

        for batch in batches:
            g, d, m, h = (batch.column(i) for i in range(4))
            kind = g.type
            for group, size, n, name in zip(g.to_pylist(), d.to_pylist(), m.to_pylist(), h.to_pylist()):
                rng = np.random.default_rng([seed, name & (2**64 - 1)])
                if n == 1:
                    x = np.unpackbits(np.frombuffer(rng.bytes((rounds + 7) // 8), np.uint8))[:rounds]
                else:
                    x = rng.binomial(n, 0.5, rounds)
                key = repr(group)
                if key not in held:
                    if len(held) >= 256:
                        yield from given()
                    held[key] = (group, np.zeros(rounds))
                held[key][1][:] += size * (2.0 * x - n)
        yield from given()

    return run


def permutation_test(df: DataFrame, group: str, a: str, b: str, rounds: int = 10_000, seed: int = 1373) -> DataFrame:
    """Paired sign-flip test per group: n, mean difference, p, on all pairs of any number.

    Pairs with a null or NaN member do not count (a group of none has no p); a null group is a group. The pairs of a group
    that differ by the same amount are one row of the work; rows go to tasks by group and amount, so a large group is no
    hot task, and a task holds the sums of 256 groups at most.
    """
    difference = F.col(a) - F.col(b)
    pairs = df.select(F.col(group).alias("g"), F.when(~F.isnan(difference.cast("double")), difference).alias("x"))
    x = F.col("x").cast("double")
    stats = pairs.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.sum(x).alias("total"), F.sum(F.abs(x)).alias("scale"))
    amounts = pairs.filter(x != 0).groupBy("g", F.abs(x).alias("d")).agg(F.count("*").alias("m")).withColumn("h", F.xxhash64("g", "d"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = T.StructType([T.StructField("g", pairs.schema["g"].dataType), T.StructField("round", T.LongType()), T.StructField("s", T.DoubleType())])
    sums = amounts.repartition(tasks, "g", "d").mapInArrow(_flipped(rounds, seed), fields).groupBy("g", "round").agg(F.sum("s").alias("s"))
    # Sums of doubles differ in their last digits by order; equal sums count as extreme.
    far = sums.alias("s").join(stats.alias("t"), F.expr("s.g <=> t.g")).groupBy("t.g").agg(F.count_if(F.expr("abs(s.s) >= abs(t.total) - 1e-12 * t.scale")).alias("far"))
    # A group of equal pairs only has no sums: every flip is as extreme as it is.
    p = F.when(F.expr("t.n > 0"), (F.coalesce("f.far", F.lit(rounds)) + 1) / F.lit(rounds + 1))
    return stats.alias("t").join(far.alias("f"), F.expr("t.g <=> f.g"), "left").select(F.col("t.g").alias(group), "n", F.round("mean", 6).alias("mean"), F.round(p, 4).alias("p"))


def _resampled(rounds: int, seed: int):
    """Of rows g, d, m, h (m values d of group g; h a hash of both): partial sums g, round, s, w of the values and of their numbers.

    In each round a value counts as often as a Poisson draw of mean 1 says, as it does in a resample with replacement of many
    values; m equal values together draw from the Poisson law of mean m.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        kind = None

        def given() -> Iterator[pa.RecordBatch]:
            for g, s, w in held.values():
                yield pa.RecordBatch.from_arrays([pa.array([g] * rounds, kind), pa.array(np.arange(rounds)), pa.array(s), pa.array(w)], ["g", "round", "s", "w"])
            held.clear()

        for batch in batches:
            g, d, m, h = (batch.column(i) for i in range(4))
            kind = g.type
            for group, value, n, name in zip(g.to_pylist(), d.to_pylist(), m.to_pylist(), h.to_pylist()):
                draw = np.random.default_rng([seed, name & (2**64 - 1)]).poisson(n, rounds)
                key = repr(group)
                if key not in held:
                    if len(held) >= 256:
                        yield from given()
                    held[key] = (group, np.zeros(rounds), np.zeros(rounds))
                held[key][1][:] += value * draw
                held[key][2][:] += draw
        yield from given()

    return run


def bootstrap(df: DataFrame, group: str, value: Column, rounds: int = 2_000, seed: int = 1373) -> DataFrame:
    """Bootstrap of a mean per group: n, mean, low and high (2.5 and 97.5 % of the resampled means), p.

    p is (resampled means on the other side of 0, or on it, + 1) / (rounds + 1), which with a difference of two systems as
    value is the paired bootstrap test. Null and NaN values do not count; a group of none has only n. Equal values of a group
    are one row of the work, which goes to tasks by group and value, so a large group is no hot task.
    """
    x = value.cast("double")
    rows = df.select(F.col(group).alias("g"), F.when(~F.isnan(x), x).alias("x"))
    stats = rows.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    amounts = rows.filter("x is not null").groupBy("g", F.col("x").alias("d")).agg(F.count("*").alias("m")).withColumn("h", F.xxhash64("g", "d"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = T.StructType([T.StructField("g", rows.schema["g"].dataType), T.StructField("round", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("w", T.DoubleType())])
    sums = amounts.repartition(tasks, "g", "d").mapInArrow(_resampled(rounds, seed), fields).groupBy("g", "round").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = sums.filter("w > 0").select("g", (F.col("s") / F.col("w")).alias("m"))
    found = means.alias("r").join(stats.alias("t"), F.expr("r.g <=> t.g")).groupBy(F.col("t.g").alias("_g"), "n", "mean").agg(F.percentile("r.m", F.lit(0.025)).alias("low"), F.percentile("r.m", F.lit(0.975)).alias("high"), F.count_if(F.expr("if(t.mean >= 0, r.m <= 0, r.m >= 0)")).alias("beyond"))
    out = stats.join(found.select("_g", "low", "high", "beyond"), F.expr("g <=> _g"), "left")
    return out.select(F.col("g").alias(group), "n", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round((F.col("beyond") + 1) / F.lit(rounds + 1), 4).alias("p"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal value (rational approximation, error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """p of equal shares."""
    pooled = (x1 + x2) / (n1 + n2)
    return normal_two_sided((x1 / n1 - x2 / n2) / F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)), F.lit(0.0)))


def weight_grid(scores: DataFrame, a: str, b: str, target: str, fold: str, weights: list[float]) -> DataFrame:
    """Two-fold cross-validation of the weight w in w a + (1 - w) b: fold, w, mean.

    A fold's w is the one with the highest mean target of each query's best item on the other fold, ties to the smaller
    weight; mean is what that weight reaches on the fold itself. fold is 0 or 1.
    """
    rows = dealt(scores.select(fold, "query_id", "item", a, b, target), fold, "query_id")
    best_of = lambda w: F.max_by(target, F.struct((w * F.col(a) + (1 - w) * F.col(b)).alias("s"), "item", target))
    best = rows.groupBy(fold, "query_id").agg(F.array(*[F.struct(F.lit(float(w)).alias("w"), best_of(F.lit(float(w))).alias("t")) for w in weights]).alias("tried"))
    mean = written(best.select(fold, F.inline("tried")).groupBy(fold, "w").agg(F.round(F.avg("t"), 6).alias("mean")), "grid")
    chosen = mean.withColumn("r", F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("mean"), "w"))).filter("r = 1").select((1 - F.col(fold)).alias(fold), "w")
    return chosen.join(mean, [fold, "w"]).select(fold, "w", "mean")


def experiment_tests(rows: DataFrame, arm: str, metrics: dict[str, tuple[Column, Column]], enough: int = 100) -> DataFrame:
    """A row per metric of an experiment: metric, on_rate, off_rate, p_value, answers_on, answers_off, untagged, enough_data.

    arm is true, false, or null for rows without the flag. A metric is (hit, counted): its share of hits among the rows that
    count, by arm; an arm in which none counts has no rate and no p. enough_data tells whether each arm has that many rows.
    """
    on, off = F.col(arm), ~F.col(arm)
    sums = {}
    for m, (hit, counted) in metrics.items():
        for name, side in (("on", on), ("off", off)):
            sums[f"{m}_{name}_x"], sums[f"{m}_{name}_n"] = F.count_if(side & hit & counted), F.count_if(side & counted)
    all_ = rows.agg(F.count_if(on).alias("answers_on"), F.count_if(off).alias("answers_off"), F.count_if(F.col(arm).isNull()).alias("untagged"), *[c.alias(n) for n, c in sums.items()])
    rate = lambda m, s: F.col(f"{m}_{s}_x") / F.nullif(F.col(f"{m}_{s}_n"), F.lit(0))
    p = lambda m: two_proportions(*[F.nullif(F.col(f"{m}_{s}_n"), F.lit(0)) if k == "n" else F.col(f"{m}_{s}_x") for s in ("on", "off") for k in ("x", "n")])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(rate(m, "on"), 6).alias("on_rate"), F.round(rate(m, "off"), 6).alias("off_rate"), F.round(p(m), 4).alias("p_value")) for m in metrics])
    enough_data = F.least("answers_on", "answers_off") >= enough
    return all_.select(F.explode(each).alias("t"), "answers_on", "answers_off", "untagged", enough_data.alias("enough_data")).select("t.*", "answers_on", "answers_off", "untagged", "enough_data")
