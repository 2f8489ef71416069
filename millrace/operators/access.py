"""Grants, scopes and pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective(asked: Column, scope: Column) -> Column:
    """An empty list asks for all; never more than the scope."""
    return F.when(F.size(asked) == 0, scope).otherwise(F.array_intersect(asked, scope))


def user_documents(grants: DataFrame, company: DataFrame) -> DataFrame:
    """Documents per (user_id, car_id): an administrator's grant as it is, else within the company's (company_id, car_id, scope); no company grant gives null."""
    j = grants.join(company, ["company_id", "car_id"], "left")
    return j.select("user_id", "car_id", F.when(F.col("admin_granted"), F.col("documents")).when(F.col("scope").isNotNull(), effective(F.col("documents"), F.col("scope"))).alias("documents"))


def first_entry_wins(entries: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).filter("_n = 1").drop("_n")


def pending(present: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is there and not done."""
    return present.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def registrations(packages: DataFrame, known: DataFrame) -> DataFrame:
    """State of each package (stem, signature): registered (new), duplicate (same content), refreshed (other content), unrecognised (no stem)."""
    j = packages.join(known.select("stem", F.col("signature").alias("_known")), "stem", "left")
    state = F.when(F.coalesce(F.col("stem"), F.lit("")) == "", "unrecognised").when(F.col("_known").isNull(), "registered").when(F.col("_known") == F.col("signature"), "duplicate").otherwise("refreshed")
    return j.withColumn("state", state).drop("_known")


def missing_grants(cars: DataFrame, companies: DataFrame, granted: DataFrame) -> DataFrame:
    """Pairs (company_id, car_id) that companies with all cars lack: the result has up to a row per company and car.

    Cars meet the companies in 16 hash ranges, so neither side is gathered in one place.
    """
    ranges = 16
    near = companies.select("company_id", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"))
    wanted = cars.select("car_id", F.pmod(F.xxhash64("car_id"), F.lit(ranges)).cast("int").alias("range")).join(near, "range").select("company_id", "car_id")
    return wanted.join(granted.select("company_id", "car_id"), ["company_id", "car_id"], "left_anti")
