"""What stands around a search: gates, provenance, pins, evidence scope, suggestions, several phrasings of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def provenance(vector_rank: Column, keyword_rank: Column) -> Column:
    """Which path found a hit: both, meaning, words, or pinned (neither)."""
    return F.when(vector_rank.isNotNull() & keyword_rank.isNotNull(), "both").when(vector_rank.isNotNull(), "meaning").when(keyword_rank.isNotNull(), "words").otherwise("pinned")


def scope_gate(asked: DataFrame, indexed: DataFrame, scope: str) -> DataFrame:
    """Adds status: `ok`, or `not_indexed` where the asked scope has nothing indexed; a null scope asks for all."""
    known = indexed.select(scope, F.lit(True).alias("_known")).distinct()
    return asked.join(known, scope, "left").withColumn("status", F.when(F.col(scope).isNull() | F.col("_known"), "ok").otherwise("not_indexed")).drop("_known")


def pinned_first(hits: DataFrame, pins: DataFrame, floor: float) -> DataFrame:
    """Hits (query_id, item, rank) with each query's best pin (query_id, pin_id, item, sim) of at least floor on top.

    Of equally good pins the latest (largest pin_id) wins; a hit that the pin repeats goes. Ranks are counted anew from 1.
    """
    best = pins.filter(F.col("sim") >= floor).groupBy("query_id").agg(F.max(F.struct("sim", "pin_id", "item")).alias("p")).select("query_id", F.col("p.item").alias("item"), F.lit(0).alias("rank"))
    rest = hits.select("query_id", "item", "rank").join(best.select("query_id", "item"), ["query_id", "item"], "left_anti")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("_rank"))
    return rest.unionByName(best).withColumnRenamed("rank", "_rank").withColumn("rank", again).select("query_id", "item", "rank", (F.col("_rank") == 0).alias("pinned"))


def evidence_scope(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """How far a question's evidence (question_id, car, component) reaches: counts inside and outside its own car and component.

    asked has question_id, car, component. verdict: none, own_car, other_cars or component_absent.
    """
    j = asked.join(hits.select("question_id", F.col("car").alias("_car"), F.col("component").alias("_component")), "question_id", "left")
    own = F.count_if(F.col("_car") == F.col("car"))
    g = j.groupBy("question_id").agg(own.alias("in_car"), F.count_if(F.col("_car") != F.col("car")).alias("other_cars"), F.count_if(F.col("_component") == F.col("component")).alias("same_component"))
    verdict = F.when(F.col("in_car") + F.col("other_cars") == 0, "none").when(F.col("same_component") == 0, "component_absent").when(F.col("in_car") > 0, "own_car").otherwise("other_cars")
    return g.withColumn("verdict", verdict)


def over_fetched(ranked: DataFrame, keys: list[str], wanted: Column, k: int, factor: int = 4, most: int = 120) -> DataFrame:
    """The first k wanted rows among the first min(k * factor, most) of each group; ranked has rank."""
    few = ranked.filter(F.col("rank") <= min(k * factor, most)).filter(wanted)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter(F.col("place") <= k)


def fused_phrasings(lists: DataFrame, k: int, damping: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the ranked lists (query_id, phrasing, item, rank) of a question's phrasings: the k best."""
    # In two steps by the same keys, as distinct counts would shuffle lists that are dealt by question again.
    each = lists.groupBy("query_id", "item", "phrasing").agg(F.sum(1.0 / (damping + F.col("rank"))).alias("_s"))
    fused = each.groupBy("query_id", "item").agg(F.round(F.sum("_s"), 8).alias("score"), F.count("phrasing").alias("phrasings"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))).filter(F.col("place") <= k)
