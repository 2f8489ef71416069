"""Builds for serving: what is left of a tree when leaves that cannot be served go, and the gates that a build must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .hierarchy import ancestor_paths
from .layout import toured


def serving_build(nodes: DataFrame, order: list[str], servable: Column) -> DataFrame:
    """Nodes with a servable leaf below them or in them: id, parent_id (by content), path, depth, is_leaf, kept_leaves, pruned_leaves.

    Titles that siblings share are numbered from the second on; a node's id is the SHA-1 of its path, so that a rebuild of
    the same content gives the same ids. nodes: id, parent_id, title and what order and servable read.
    """
    is_leaf = nodes.join(nodes.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("_leaf"))
    marked = written(nodes.join(is_leaf, "id", "left").withColumn("_good", F.coalesce(F.col("_leaf") & servable, F.lit(False))), "marked")
    tree = toured(marked, order, {"kept_leaves": F.col("_good").cast("int"), "all_leaves": F.coalesce("_leaf", F.lit(False)).cast("int")})
    kept = tree.filter("kept_leaves > 0").select("id", "depth", "kept_leaves", (F.col("all_leaves") - F.col("kept_leaves")).alias("pruned_leaves"))
    few = written(marked.join(kept, "id").select("id", "parent_id", "title", "_leaf", "depth", "kept_leaves", "pruned_leaves", *[c for c in order if c not in ("id", "parent_id", "title")]), "kept")
    same = F.row_number().over(Window.partitionBy("parent_id", "title").orderBy(*order, "id"))
    named = few.withColumn("_n", same).withColumn("title", F.when(F.col("_n") > 1, F.concat("title", F.lit(" ("), "_n", F.lit(")"))).otherwise(F.col("title")))
    paths = ancestor_paths(named).select("id", F.array_join("path", "/").alias("path"), F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), "/").alias("_above"))
    own = named.join(paths, "id")
    above = F.when(F.col("_above") != "", F.sha1(F.col("_above").cast("binary")))
    return own.select(F.sha1(F.col("path").cast("binary")).alias("id"), above.alias("parent_id"), "path", "depth", F.coalesce("_leaf", F.lit(False)).alias("is_leaf"), "kept_leaves", "pruned_leaves")


def build_faults(build: DataFrame) -> DataFrame:
    """What a build must not have: gate and id.

    repeated_id; orphan (a parent that is not there); empty_section (no servable leaf below); not_counted (an inner node
    whose kept leaves are not those of its children together); wrong_depth (not its parent's and one).
    """
    own = build.groupBy("id").agg(F.count("*").alias("n"), F.first("parent_id").alias("parent_id"), F.first("depth").alias("depth"), F.first("is_leaf").alias("is_leaf"), F.first("kept_leaves").alias("kept"))
    parents = own.select(F.col("id").alias("parent_id"), F.col("depth").alias("_above"), F.lit(True).alias("_there"))
    below = build.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum("kept_leaves").alias("_below"))
    j = own.join(parents, "parent_id", "left").join(below, "id", "left")
    gates = {
        "repeated_id": F.col("n") > 1,
        "orphan": F.col("parent_id").isNotNull() & F.col("_there").isNull(),
        "empty_section": F.col("kept") <= 0,
        "not_counted": ~F.col("is_leaf") & ~F.col("kept").eqNullSafe(F.col("_below")),
        "wrong_depth": ~F.col("depth").eqNullSafe(F.when(F.col("parent_id").isNull(), 0).otherwise(F.col("_above") + 1)) & F.col("_there").eqNullSafe(F.when(F.col("parent_id").isNotNull(), True)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in gates.items()]))
    return j.select(F.explode(found).alias("gate"), "id")
