"""Filters: time ranges, optional predicates, literal text search, visibility and dead ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_range(df: DataFrame, ts: str, as_of: str, days: int, least: int = 1, most: int = 365) -> DataFrame:
    """Rows of the `days` days (clamped) before as_of, that moment included."""
    days = max(least, min(most, days))
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= end - F.expr(f"interval {days} days")) & (F.col(ts) <= end))


def optional_equals(df: DataFrame, closed: dict[str, set] | None = None, **wanted) -> DataFrame:
    """Equality filters for the values that are given; a value outside a column's closed set is ignored."""
    for column, value in wanted.items():
        if value is not None and (not closed or column not in closed or value in closed[column]):
            df = df.filter(F.col(column) == value)
    return df


def not_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def contains_literal(column: Column, needle: str) -> Column:
    """Case-insensitive search of a literal text: no character is a wildcard."""
    return F.instr(F.lower(column), needle.lower()) > 0


def json_equals(column: Column, path: str, value: str) -> Column:
    return F.get_json_object(column, path) == value


def sla_breached(response_due: Column, responded: Column, resolve_due: Column, resolved: Column, now: Column) -> Column:
    """Past due without a response, or without a resolution."""
    return F.coalesce((response_due < now) & responded.isNull(), F.lit(False)) | F.coalesce((resolve_due < now) & resolved.isNull(), F.lit(False))


def hide_dead_ends(nodes: DataFrame) -> DataFrame:
    """Nodes without those that have neither content nor children, and without sections that have only such children."""
    def with_children(n: DataFrame) -> DataFrame:
        return n.join(n.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")

    alive = nodes.filter("content is not null").unionByName(with_children(nodes).filter("content is null"))
    kept = alive.filter("content is not null").unionByName(with_children(alive).filter("content is null"))
    return kept


def weak_hits_removed(hits: DataFrame, grounded: str, sim: str, bm25: str, floor: float = 0.55) -> DataFrame:
    """Of ungrounded queries whose best similarity is under the floor, only the hits with a keyword match or enough similarity."""
    best = F.max(sim).over(Window.partitionBy("query_id"))
    return hits.withColumn("_best", best).filter(F.col(grounded) | (F.col("_best") >= floor) | (F.col(bm25) > 0) | (F.col(sim) >= floor)).drop("_best")
