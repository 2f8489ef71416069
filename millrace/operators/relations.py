"""Joins and set operations: as-of, longest prefix, phrase, reconciliation, upsert, fusion of ranked lists, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .ordered import seconds


def asof_previous(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_id: str, within_s: int) -> DataFrame:
    """Each left row with the latest earlier (or equal) right row of its keys, at most so many seconds old.

    Both sides go through one window in time order, so a key of very many rows gives no pairs.
    """
    both = left.withColumn("_side", F.lit(1)).withColumn("_seen", F.lit(None).cast("struct<t:bigint,id:bigint>")).unionByName(
        right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(seconds(ts).alias("t"), F.col(right_id).cast("long").alias("id")).alias("_seen")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_side", F.col("_seen.id")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_seen", ignorenulls=True).over(w)
    out = both.withColumn("_last", last).filter("_side = 1")
    return out.withColumn("matched", F.when(seconds(ts) - F.col("_last.t") <= within_s, F.col("_last.id"))).drop("_side", "_seen", "_last")


def longest_prefix(left: DataFrame, right: DataFrame, name: str, prefix: str) -> DataFrame:
    """Each left name with the longest right prefix that it equals or begins with as whole words.

    A name's word prefixes are looked up as equal keys, so no pairs of all names arise.
    """
    words = F.split(name, " ")
    tried = left.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))).alias(prefix))
    return tried.join(right.select(prefix).distinct(), prefix).groupBy(name).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def reconciled(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or changed keys of two snapshots."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return b.join(a, key, "full_outer").withColumn("state", state).filter("state is not null")


def upserted(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fresh values where there are any, else the stored ones."""
    s, f = stored.select(key, *columns).alias("s"), fresh.select(key, *columns).alias("f")
    return s.join(f, key, "full_outer").select(key, *[F.coalesce(F.col(f"f.{c}"), F.col(f"s.{c}")).alias(c) for c in columns])


def ranked_upsert(rows: DataFrame, key: str, value: str, rank: str, confidence: str) -> DataFrame:
    """Per key the value of the highest rank (then confidence, then the smallest value); confidence never falls."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(-F.col(rank), -F.col(confidence), F.col(value))).alias(value), F.max(rank).alias(rank), F.max(confidence).alias(confidence))


def fused(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of candidate lists (columns rrf, sim, bm25, any may be null): summed rrf, best similarity, best (smallest) bm25."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    return rows.groupBy(*keys).agg(F.sum("rrf").alias("rrf"), F.max("sim").alias("sim"), F.min("bm25").alias("bm25"))


def content_deduped(df: DataFrame, content: str, item: str) -> DataFrame:
    """One row per distinct content: its sha1, the first item that has it, and how many do."""
    return df.groupBy(F.sha1(F.col(content).cast("binary")).alias("content_hash")).agg(F.min(item).alias("first_item"), F.count("*").alias("n_occ"))


def disambiguated(df: DataFrame, parent: str, label: str, item: str) -> DataFrame:
    """Labels that siblings share get ` #id`."""
    n = F.count("*").over(Window.partitionBy(parent, label))
    return df.withColumn("label", F.when(n > 1, F.concat(F.col(label), F.lit(" #"), F.col(item).cast("string"))).otherwise(F.col(label)))


def numbered_collisions(df: DataFrame, name: str, item: str) -> DataFrame:
    """Second and later rows of a name get ` (2)`, ` (3)`, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(item))
    return df.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def conflicting_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys that several rows have, with whether the rows differ."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (F.countDistinct(F.struct(*columns)) > 1).alias("conflict")).filter("n > 1")


def token_subset_pairs(texts: DataFrame, doc: str, phrases: DataFrame, item: str, words: str) -> DataFrame:
    """Pairs (doc, item) of which all of the phrase's words are in the text; words holds each row's distinct words.

    A phrase meets texts by its rarest word only, so that common words make no pairs; then the whole phrase is compared.
    Only numbers and single words meet there: a text is moved once, for its comparisons, not once for each of its words.
    Phrases without a word meet nothing.
    """
    wanted = phrases.select(item, F.explode(words).alias("_word"))
    met = texts.select(doc, F.explode(words).alias("_word")).join(wanted.select("_word").distinct(), "_word", "left_semi")
    counts = met.groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = wanted.join(counts, "_word", "left").groupBy(item).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word")).alias("_r")).select(item, F.col("_r._word").alias("_word"))
    tried = written(texts.select(doc, F.explode(words).alias("_word")).join(written(rarest, "rarest"), "_word").select(doc, item), "tried")
    whole = tried.join(phrases.select(item, F.col(words).alias("_all")), item)
    return whole.join(texts.select(doc, F.col(words).alias("_text")), doc).filter(F.size(F.array_except("_all", "_text")) == 0).select(doc, item)
