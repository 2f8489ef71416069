"""Structured Streaming operators: rollups, exact uniques, sliding-window limits and suppression of repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import work_path


def table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 64) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{table}.parquet*")


def drained(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over all that is there now, exactly once, and reads the result.

    In complete mode the last batch holds the whole result; in append mode the file sink gathers all batches.
    """
    spark = stream.sparkSession
    out, checkpoint = work_path(spark, label), work_path(spark, f"{label}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def hourly_rollup(events: DataFrame, ts: str, keys: list[str], lateness: str | None = None) -> DataFrame:
    """Counts and value sums per hour of event time; any lateness is accepted unless a bound is given."""
    rows = events.withWatermark(ts, lateness) if lateness else events
    return rows.groupBy(F.window(ts, "1 hour").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *keys, "n")


def daily_uniques(events: DataFrame, ts: str, user: str) -> DataFrame:
    """First sight of each user on each day, once whatever repeats or writers there are."""
    return events.select(F.to_date(ts).alias("day"), user).dropDuplicates(["day", user])


def _limiter(limit: int, window_s: float, record_rejected: bool):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        accepted = []
        for t in pdf["t"]:
            held = [x for x in held if x >= t - window_s]
            ok = len(held) < limit
            accepted.append(ok)
            if ok or record_rejected:
                held.append(float(t))
        state.update((held[-max(limit, 1) :],))
        yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": accepted})

    return run


def rate_limited(events: DataFrame, key: str, limit: int, window_s: float, record_rejected: bool = False) -> DataFrame:
    """Marks each event as accepted if fewer than limit recorded ones lie in the trailing window, its start included.

    Only accepted events are recorded (or all, with record_rejected). The state of a key is at most limit times.
    Needs columns key, event_id, t (seconds).
    """
    return events.select(F.col(key).alias("key"), "event_id", "t").groupBy("key").applyInPandasWithState(_limiter(limit, window_s, record_rejected), "key long, event_id long, accepted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def repeats_suppressed(events: DataFrame, key: str, window_s: float) -> DataFrame:
    """Marks an event as recorded unless the last recorded one of its key lies within the window (a chain, not the last seen)."""
    return rate_limited(events, key, 1, window_s)
