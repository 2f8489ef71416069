"""Gold sets for evaluation, by construction: known items, questions without an answer, parts that a vehicle does not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyword_index import KeywordIndex, absent
from .ordered import round_robin


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def known_items(pages: DataFrame, vehicles: DataFrame, topic: str, stratum: str, n: int, least: int = 1, most: int = 8, seed: str = "1373") -> DataFrame:
    """topic, stratum, turn, car, expected: n topics whose pages are few enough to be an answer.

    pages has item, topic and stratum (the smallest counts); vehicles has item and car. Topics with fewer than least or more
    than most pages, or in no vehicle, are left out. They are drawn stratum by stratum in turns, in an order given by a hash
    of seed and topic; each is asked for one of its vehicles, again by hash, so that no vehicle has most of the questions.
    """
    topics = pages.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.min(stratum).alias(stratum), F.sort_array(F.collect_set("item")).alias("expected")).filter(F.size("expected").between(least, most))
    cars = topics.select(topic, F.explode("expected").alias("item")).join(vehicles.select("item", "car").distinct(), "item")
    chosen = cars.groupBy(topic).agg(F.min(F.struct(_hash(F.lit(seed), topic, "car").alias("h"), "car"))["car"].alias("car"))
    return round_robin(topics.join(chosen, topic), stratum, _hash(F.lit(seed), topic), topic, n).select(topic, stratum, "turn", "car", "expected")


def out_of_scope(index: KeywordIndex, phrases: DataFrame, n: int, seed: str = "1373") -> DataFrame:
    """n of the phrases (query_id, text) whose words no document of the index has together: the proof of absence is the index itself."""
    proven = absent(index, phrases).select("query_id")
    return phrases.join(proven, "query_id").orderBy(_hash(F.lit(seed), F.col("query_id").cast("string")), "query_id").limit(n)


def wrong_vehicles(pages: DataFrame, vehicles: DataFrame, topic: str, share: float = 0.5, seed: str = "1373") -> DataFrame:
    """topic, car, present: topics that at most this share of the vehicles has, asked for one that has none of their pages.

    The vehicles are one closed list (a few bytes each), which each topic takes its own off.
    """
    have = pages.filter(F.col(topic).isNotNull()).select("item", topic).join(vehicles.select("item", "car").distinct(), "item").groupBy(topic).agg(F.collect_set("car").alias("have"))
    every = vehicles.select("car").distinct().agg(F.sort_array(F.collect_list("car")).alias("every")).withColumn("_one", F.lit(1))
    both = have.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").filter(F.size("have") <= share * F.size("every"))
    missing = both.withColumn("missing", F.array_except("every", "have")).filter("size(missing) > 0")
    turn = F.conv(F.substring(_hash(F.lit(seed), topic), 1, 8), 16, 10).cast("long") % F.size("missing")
    return missing.select(topic, F.get("missing", turn.cast("int")).alias("car"), F.size("have").cast("long").alias("present"))
