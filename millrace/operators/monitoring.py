"""Alert rules, alert lifecycle and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import spaced
from .ordered import seconds


def bursts(df: DataFrame, key: str, ts: str, within_s: int, least: int) -> DataFrame:
    """Keys with at least so many rows in some trailing window, with the largest count."""
    w = Window.partitionBy(key).orderBy(seconds(ts)).rangeBetween(-within_s, 0)
    return df.withColumn("_n", F.count("*").over(w)).groupBy(key).agg(F.max("_n").alias("most")).filter(F.col("most") >= least)


def cost_spikes(df: DataFrame, ts: str, cost: str, factor: float, floor: float, days: int = 7) -> DataFrame:
    """Days that cost `factor` times the mean of the days before (missing days count 0) and at least floor."""
    by_day = df.groupBy(F.to_date(ts).alias("day")).agg(F.sum(cost).alias("cost"))
    w = Window.orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-days, -1)
    mean = F.coalesce(F.sum("cost").over(w), F.lit(0.0)) / days
    return by_day.withColumn("before", mean).filter((F.col("cost") >= factor * F.col("before")) & (F.col("cost") >= floor)).select("day", F.round("cost", 4).alias("cost"), F.round("before", 4).alias("before"))


def alert_states(firing: DataFrame, open_alerts: DataFrame, owned_prefix: str) -> DataFrame:
    """opened, refreshed or resolved alerts by key; only owned keys resolve by themselves."""
    j = firing.select("key", F.lit(True).alias("f")).join(open_alerts.select("key", F.lit(True).alias("o")), "key", "full_outer")
    state = F.when(F.col("f") & F.col("o").isNull(), "opened").when(F.col("f"), "refreshed").when(F.col("key").startswith(owned_prefix), "resolved").otherwise("kept")
    return j.select("key", state.alias("state"))


def delivered(df: DataFrame, key: str, ts: str, item: str, cooldown_s: int) -> DataFrame:
    """Items whose notice goes out: a key's first, and each one at least the cool-down after the last that went out."""
    return spaced(df, [key], seconds(ts), item, cooldown_s, inclusive=True)


def change_events(df: DataFrame, key: str, ts: str, item: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before (a key's first row is silent), with the value before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(ts, item))
    return df.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def newest_kept(df: DataFrame, order: str, keep: int) -> DataFrame:
    """The newest rows by order (a number that is unique)."""
    return df.orderBy(F.desc(order)).limit(keep)


def silent_days(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Days of the whole log's span of days with rows on which a key has none: key, day.

    The days of the log are one sorted list (a day is 4 bytes), which each key takes its own days off.
    """
    seen = df.groupBy(key).agg(F.collect_set(F.to_date(ts)).alias("own"))
    days = df.select(F.to_date(ts).alias("day")).distinct().agg(F.sort_array(F.collect_list("day")).alias("days"))
    return seen.withColumn("_one", F.lit(1)).join(F.broadcast(days.withColumn("_one", F.lit(1))), "_one").select(key, F.explode(F.array_except("days", "own")).alias("day"))


def service_rules(traffic: DataFrame, keys: list[str], least_errors: int = 50, share: float = 0.05, least_latency: int = 10, latency_ms: float = 5000) -> DataFrame:
    """Keys where a rule holds, one row per rule: `errors` (share of 5xx on enough requests), `latency` (mean on enough requests)."""
    g = traffic.groupBy(*keys).agg(F.sum("requests").alias("n"), F.sum("errors_5xx").alias("e"), F.sum("total_ms").alias("ms"))
    errors = F.when((F.col("n") >= least_errors) & (F.col("e") / F.col("n") >= share), "errors")
    latency = F.when((F.col("n") >= least_latency) & (F.col("ms") / F.col("n") >= latency_ms), "latency")
    return g.select(*keys, F.explode(F.array_compact(F.array(errors, latency))).alias("rule"))
