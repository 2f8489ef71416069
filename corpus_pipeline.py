"""Corpus pipeline: toxicity, quality, near duplicates, mixing and packing, each stage on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import staged, work_dir
from millrace.llm.mixing import mix_sources
from millrace.llm.ngram_jaccard import ngram_jaccard_groups
from millrace.llm.packing import pack_mixed
from millrace.llm.quality import score_quality
from millrace.llm.queries import TOKENIZER
from millrace.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Settings of the mix, for the mixing and the packing stage alike.
MIX = {"temperature": 0.5, "block_docs": 16}
#: The scorers give doc_id by themselves; with these, each row comes back whole next to its score.
REST = [c for c in COLUMNS if c != "doc_id"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that score 0.5 or more, whatever their ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, carry=REST).filter("predicted = 0").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the scorer, taught by the label model, puts below 0.5, whatever their ids."""
    return score_quality(docs, carry=REST).filter("keep").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked rows: that of the smallest id, null ids last.

    Rows are told apart by a hash of all columns, which stands for the id in the grouping; so null ids are grouped too,
    and an id's other texts are rows of their own. Rows that are equal in all columns count once. Texts without a word
    are linked with nothing.
    """
    # The hash passes over nulls, so it takes in which columns are null.
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    groups = staged(ngram_jaccard_groups(keyed, id_col="row_key", words=5, percent=75).select(F.col("doc_id").alias("row_key"), "component_id"), "groups")
    # Only rows that are linked with another row or equal to one have something to settle; minima are taken in two steps.
    shared = groups.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    linked = staged(groups.join(shared, "component_id").groupBy("row_key", "component_id").agg(F.count("*").alias("n")), "linked")
    ids = keyed.select("row_key", "doc_id").join(linked, "row_key").select("component_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key").alias("r"))
    first = ids.groupBy("component_id").agg(F.min("r").alias("r")).select(F.col("r.row_key").alias("row_key"))
    copies = staged(linked.select("row_key").join(first, "row_key", "left_anti"), "copies")
    again = staged(linked.filter("n > 1").select("row_key").join(copies, "row_key", "left_anti"), "again")
    once = keyed.join(copies.unionByName(again), "row_key", "left_anti").select(*COLUMNS)
    return once.unionByName(keyed.join(again, "row_key", "left_semi").select(*COLUMNS).dropDuplicates())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mix.

    Files do not keep the order of rows, and documents have no column for it: the packing stage finds each document's
    slot again, from ids, sources and MIX.
    """
    mixed = mix_sources(docs.select(*COLUMNS), keep=True, **MIX)
    return mixed.orderBy("slot", "place").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens, in the order of the mix; sequence ids grow in that order."""
    return pack_mixed(docs, TOKENIZER, MIX, 1024, 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models decide the first stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{work_dir(spark)}/millrace-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
