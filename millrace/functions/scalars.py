"""Scalar rules: buckets, service levels, decay, confidence, prices and states, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: str, item: Column) -> Column:
    """Stable bucket 0..99 of an item for a flag: first 8 hex digits of sha256(`key:id`) modulo 100."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(key + ":"), item.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def rollout(key: str, item: Column, percent: int, enabled: bool = True, force_on: list | None = None, force_off: list | None = None) -> Column:
    """forced off, then forced on, then disabled, then the bucket."""
    return F.when(item.isin(force_off or []), False).when(item.isin(force_on or []), True).otherwise(F.lit(enabled) & (bucket(key, item) < percent))


def sla_state(due_h: Column, done_h: Column, now_h: Column) -> Column:
    """met, breached or pending, by hours since creation; null without a due time."""
    return F.when(due_h.isNull(), None).when(done_h.isNotNull(), F.when(done_h <= due_h, "met").otherwise("breached")).otherwise(F.when(now_h > due_h, "breached").otherwise("pending"))


def feedback_factor(up: Column, clicks: Column, down: Column, total: Column) -> Column:
    """1 under three signals, else 1 plus the net share, scaled to 0.85..1.2."""
    net = (up + 0.5 * clicks - down) / (total + 1)
    return F.when(total < 3, 1.0).otherwise(F.when(net >= 0, 1 + net * 0.2).otherwise(1 + net * 0.15))


def outcome(status: Column) -> Column:
    return F.when(status < 400, "success").when(status.isin(401, 403, 429), "denied").otherwise("failure")


def seat_price(seats: Column) -> Column:
    """Graduated price: 10 a seat up to 5, 8 up to 20, then 6."""
    return F.least(seats, F.lit(5)) * 10 + F.greatest(F.lit(0), F.least(seats, F.lit(20)) - 5) * 8 + F.greatest(F.lit(0), seats - 20) * 6


def load_level(x: Column) -> Column:
    return F.when(x < 0.5, "quiet").when(x < 0.85, "busy").otherwise("heavy")
