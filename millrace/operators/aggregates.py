"""Grouped aggregates: counts, rollups, zero-filled groups, percentiles, decayed votes, argmax, fingerprints, term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, key: str, user: str, ts: str, limit: int) -> DataFrame:
    """Most frequent keys with their distinct users and last time; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(user).alias("users"), F.max(ts).alias("last")).orderBy(F.desc("n"), key).limit(limit)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for an empty denominator."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def endpoint_rollup(traffic: DataFrame) -> DataFrame:
    """Sums per endpoint with mean latency and error rate derived from the sums."""
    out = traffic.groupBy("endpoint").agg(*[F.sum(c).alias(c) for c in ("requests", "errors_4xx", "errors_5xx", "total_ms")], F.max("max_ms").alias("max_ms"))
    return out.withColumn("avg_ms", F.round(ratio(F.col("total_ms"), F.col("requests")), 4)).withColumn("error_rate", F.round(ratio(F.col("errors_5xx"), F.col("requests")), 6))


def daily(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, dimension: DataFrame, key: str, counted: str = "n") -> DataFrame:
    """Counts per member of a closed dimension; members without rows get 0, rows outside it are left out."""
    return dimension.join(count_by(df, key), key, "left").select(key, F.coalesce("n", F.lit(0)).alias(counted))


def active_days(df: DataFrame, user: str, ts: str, least: int) -> DataFrame:
    """Users active on at least so many distinct days."""
    return df.groupBy(user).agg(F.countDistinct(F.to_date(ts)).alias("days")).filter(F.col("days") >= least)


def case_folded(df: DataFrame, column: str) -> DataFrame:
    """Counts by lower-cased value, with the smallest spelling for display."""
    return df.groupBy(F.lower(column).alias("key")).agg(F.min(column).alias("display"), F.count("*").alias("n"))


def distinct_concat(df: DataFrame, key: str, value: str, sep: str = ",") -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), sep).alias("values"))


def sessions(session: str) -> Column:
    """Distinct sessions; each row with a blank session is one of its own."""
    return F.countDistinct(F.nullif(F.col(session), F.lit(""))) + F.count_if(F.coalesce(F.col(session), F.lit("")) == "")


def nearest_rank(value: str, p: float) -> Column:
    """The value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def decayed_votes(votes: DataFrame, key: str, verdict: str, ts: str, as_of: str, half_life_days: float) -> DataFrame:
    """Sums of 0.5^(age / half-life) by sign of the vote; negative ages count as 0."""
    age = F.greatest(F.lit(0.0), F.expr(f"timestampdiff(SECOND, {ts}, timestamp_ntz'{as_of}')").cast("double") / 86400.0)
    w = F.pow(F.lit(0.5), age / F.lit(float(half_life_days)))
    out = votes.withColumn("w", w).groupBy(key).agg(F.sum(F.when(F.col(verdict) > 0, F.col("w"))).alias("up"), F.sum(F.when(F.col(verdict) < 0, F.col("w"))).alias("down"), F.count_if(F.col(verdict) != 0).alias("total"))
    return out.select(key, F.round(F.coalesce("up", F.lit(0.0)), 6).alias("up"), F.round(F.coalesce("down", F.lit(0.0)), 6).alias("down"), "total")


def argmax(df: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """The value of the row with the largest `by`; ties by the smallest value."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(-F.col(by), F.col(value))).alias(value), F.max(by).alias(by))


def merged_rollups(stored: DataFrame, fresh: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Counters add, maxima keep the larger; the same for any order of merging."""
    return stored.unionByName(fresh).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def fingerprint(df: DataFrame, key: str, name: str, size: Column) -> DataFrame:
    """sha1 over a group's sorted `name|size` lines.

    A group's lines are one value, so a key of very many rows is hashed in ranges first: the lines of each of 256 hash
    ranges, then the ranges' digests in order.
    """
    line = F.concat(F.col(name).cast("string"), F.lit("|"), size.cast("string"))
    ranged = df.select(key, line.alias("line"), F.substring(F.sha1(line.cast("binary")), 1, 2).alias("range"))
    parts = ranged.groupBy(key, "range").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary")).alias("digest"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: x["digest"]), "\n").cast("binary")).alias("fingerprint"), F.sum("n").alias("n"))


def degree_centrality(edges: DataFrame, node: str, c: int = 8) -> DataFrame:
    return edges.groupBy(node).agg(F.count("*").alias("degree")).withColumn("centrality", F.round(F.col("degree") / (F.col("degree") + F.lit(c)), 6))


def tokens(column: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(column), "[^\\p{L}\\p{N}]+", " "), " "), lambda x: x != "")


def term_frequencies(df: DataFrame, doc: str, fields: dict[str, str]) -> DataFrame:
    """Term frequencies per document, one column per field: doc, term, tf_<field>."""
    parts = [df.select(doc, F.lit(f).alias("field"), F.explode(tokens(F.col(c))).alias("term")) for f, c in fields.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(doc, "term").agg(*[F.count_if(F.col("field") == f).alias(f"tf_{f}") for f in fields])


def coverage_curve(df: DataFrame, key: str, weight: str) -> DataFrame:
    """Share of the total weight that the heaviest keys cover, by rank (few keys: a closed vocabulary)."""
    by = Window.orderBy(F.desc(weight), key)
    return df.select(key, weight, F.row_number().over(by).alias("rank"), F.round(F.sum(weight).over(by.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy()), 6).alias("covered"))
