"""Trees and graphs as parent links: ancestor paths, subtrees, reach, leaves, layout and one-hop expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written


def ancestor_paths(nodes: DataFrame) -> DataFrame:
    """Each node with its path of titles from the root, its ids on the way and its depth.

    Goes down level by level: a join of the last level with its children, written to the checkpoint folder, until a level
    is empty; so there is no bound on depth or rows. A node is not visited twice on a path. Nodes that no root leads to,
    those of a ring among them, are left out.
    """
    nodes = nodes.select("id", "parent_id", "title")
    level = nodes.filter("parent_id is null").select("id", F.array("title").alias("path"), F.array("id").alias("ids"), F.lit(0).alias("depth"))
    found, level = level, written(level, "level")
    while not level.isEmpty():
        below = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_path"), F.col("ids").alias("_ids"), F.col("depth").alias("_depth"))
        down = nodes.join(below, "parent_id").filter(~F.array_contains("_ids", F.col("id")))
        level = written(down.select("id", F.concat("_path", F.array("title")).alias("path"), F.concat("_ids", F.array("id")).alias("ids"), (F.col("_depth") + 1).alias("depth")), "level")
        found = found.unionByName(level)
    return found


def subtree(paths: DataFrame, root: str) -> DataFrame:
    """The node and all below it, with the path below it; paths as ancestor_paths gives them."""
    at = F.array_position("ids", root)
    return paths.filter(F.array_contains("ids", root)).select("id", F.array_join(F.expr(f"slice(path, array_position(ids, '{root}') + 1, size(path))"), " > ").alias("below"), (F.col("depth") - at.cast("int") + 1).alias("level"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that no node names as its parent."""
    return nodes.join(nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def kept_with_ancestors(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the wanted nodes and of all nodes above them."""
    return paths.join(wanted.select("id"), "id", "left_semi").select(F.explode("ids").alias("id")).distinct()


def nearest_marked_ancestor(paths: DataFrame, marked: DataFrame) -> DataFrame:
    """Each node with the nearest node above it that is marked (null: none)."""
    up = paths.select("id", F.posexplode(F.slice("ids", 1, F.size("ids") - 1)).alias("at", "ancestor"))
    met = up.join(marked.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").groupBy("id").agg(F.max_by("ancestor", "at").alias("ancestor"))
    return paths.select("id").join(met, "id", "left")


def tree_order_keys(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sort keys of the tree's order: ordinals of 8 digits on the way down, joined by dots."""
    steps = paths.select("id", F.posexplode("ids").alias("at", "step")).join(nodes.select(F.col("id").alias("step"), "sort_order"), "step")
    return steps.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.lpad(F.col("sort_order").cast("string"), 8, "0").alias("o")))), lambda x: x["o"]), ".").alias("sort_key"))


def one_hop(edges: DataFrame, order: dict[str, int], cap: int) -> DataFrame:
    """Each source's distinct targets, best relation first, then weight, at most cap."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in order.items() for x in p])[F.col("relation")], F.lit(99))
    best = edges.withColumn("priority", rank).groupBy("src_blob", "dst_blob").agg(F.min(F.struct("priority", (-F.col("weight")).alias("w"))).alias("b"))
    w = Window.partitionBy("src_blob").orderBy("b.priority", "b.w", "dst_blob")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("src_blob", "dst_blob", F.col("b.priority").alias("priority"), (-F.col("b.w")).alias("weight"), "rank")


def neighbour_votes(edges: DataFrame, seeds: DataFrame, per_seed: int, limit: int) -> DataFrame:
    """Targets by the summed weight of the seeds' strongest edges, seeds left out."""
    own = edges.join(seeds.select(F.col("id").alias("src_blob")), "src_blob", "left_semi")
    w = Window.partitionBy("src_blob").orderBy(F.desc("weight"), "dst_blob", "relation")
    top = own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_seed)
    votes = top.groupBy("dst_blob").agg(F.round(F.sum("weight"), 4).alias("votes"))
    return votes.join(seeds.select(F.col("id").alias("dst_blob")), "dst_blob", "left_anti").orderBy(F.desc("votes"), "dst_blob").limit(limit)


def resolved_titles(nodes: DataFrame, wanted: DataFrame, segments: int) -> DataFrame:
    """Paths of titles (path_id, segments: an array) resolved from the roots down: path_id, id.

    A child matches a segment by its title, or by `title of the segment before: segment`. One join per segment, so many as
    said; paths of another length resolve to nothing.
    """
    n = nodes.select("id", "parent_id", "title")
    at = wanted.filter(F.size("segments") == segments).join(n.filter("parent_id is null").drop("parent_id"), F.col("title") == F.get("segments", F.lit(0))).select("path_id", "segments", "id")
    for i in range(1, segments):
        seg, before = F.get("segments", F.lit(i)), F.get("segments", F.lit(i - 1))
        below = n.select(F.col("id").alias("_child"), F.col("parent_id").alias("id"), F.col("title").alias("_title"))
        at = at.join(below, "id").filter((F.col("_title") == seg) | (F.col("_title") == F.concat(before, F.lit(": "), seg))).select("path_id", "segments", F.col("_child").alias("id"))
    return at.select("path_id", "id")


def path_counts(paths: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """Each path with the number of paths at it or below it (equal, or beginning with it and a separator); repeated paths count each."""
    parts = F.split(path, separator)
    heads = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), separator))).alias(path))
    return heads.groupBy(path).agg(F.count("*").alias("n")).join(paths.select(path).distinct(), path)
