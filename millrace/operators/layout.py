"""Trees of any depth without a pass per level: Euler tours ranked by pointer doubling, and contraction for values from below.

A tour goes down and up every edge once. Places of tour steps, depths, orders of leaves and sums over subtrees are sums along
it, which doubling the pointers gives in as many joins as the length has binary digits. Stretches of steps that follow one
another by number, as over the leaves of one parent, are summed up first: a chain of a million nodes takes twenty joins, a
star few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .ordered import numbered


def _placed(nodes: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Nodes by number: place (from 1; siblings in order one after another), parent, first and last child, next sibling.

    Nodes of unknown parents and rings have no tour and are dropped later; a repeated id keeps its first row.
    """
    rows = nodes.dropDuplicates(["id"]) if "id" in order else nodes
    placed = numbered(rows.select("id", "parent_id", *[c for c in dict.fromkeys([*order, *keep]) if c not in ("id", "parent_id")]), ["parent_id", *order, *([] if "id" in order else ["id"])], "place")
    placed = written(placed, "placed")
    spans = placed.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    own = placed.join(spans, "id", "left")
    above = placed.select(F.col("id").alias("parent_id"), F.col("place").alias("parent"))
    after = placed.select((F.col("place") - 1).alias("place"), F.col("parent_id").alias("_next_parent"))
    full = own.join(above, "parent_id", "left").join(after, "place", "left")
    # A next number with the same parent is the next sibling; roots follow one another as well.
    following = F.when(F.col("_next_parent").eqNullSafe(F.col("parent_id")) & (F.col("parent_id").isNotNull() | F.col("_is_next")), F.col("place") + 1)
    last = placed.agg(F.max("place")).first()[0] or 0
    return written(full.withColumn("_is_next", F.col("place") < last).select("id", "parent_id", "place", "first", "last", "parent", following.alias("next"), *keep), "numbered-nodes")


#: Steps of a range within which straight stretches are summed up.
_RANGE = 4096


def _stretches(steps: DataFrame, sums: list[str]) -> DataFrame:
    """Steps with tail, the end of the stretch of consecutive numbers that they are in, and the sums from them to it.

    Children are numbered one after another, so a tour passes leaves of one parent in the order of their steps.
    """
    back = Window.partitionBy(F.expr(f"step div {_RANGE}")).orderBy(F.desc("step"))
    so_far = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    straight = F.coalesce((F.col("next") == F.col("step") + 1) & (F.lag("step").over(back) == F.col("next")), F.lit(False))
    seen = steps.select("*", straight.alias("_on"), *[F.sum(c).over(so_far).alias(f"_{c}") for c in sums])
    at_tail = lambda c: F.last(F.when(~F.col("_on"), c), ignorenulls=True).over(so_far)
    return seen.select("step", "next", at_tail(F.col("step")).alias("tail"), *[(F.col(f"_{c}") - at_tail(F.col(f"_{c}") - F.col(c))).alias(c) for c in sums])


def _suffix_sums(steps: DataFrame, sums: list[str]) -> DataFrame:
    """For each step (step, next, sums): the sums from it to the tour's end; steps that reach no end are left out.

    Only the ends of straight stretches go through the rounds of doubling.
    """
    steps = written(_stretches(steps, sums), "stretches")
    entered = steps.select(F.col("step").alias("next"), F.col("tail").alias("_next"), *sums)
    ends = steps.filter("step = tail").select("step", "next").join(entered, "next", "left").select("step", F.col("_next").alias("next"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    ends = written(ends, "ends")
    for _ in range((ends.count() + 1).bit_length()):
        ahead = ends.select(F.col("step").alias("next"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in sums])
        ends = written(ends.join(ahead, "next", "left").select("step", F.col("_next").alias("next"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]), "doubled")
        if ends.filter("next is not null").isEmpty():
            break
    rest = ends.filter("next is null").select(F.col("step").alias("tail"), *[F.col(c).alias(f"_{c}") for c in sums])
    return steps.join(rest, "tail").select("step", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def toured(nodes: DataFrame, order: list[str], weights: dict[str, Column] | None = None) -> DataFrame:
    """Nodes (id, parent_id) with parent, first and last child by number, depth, leaf_at (leaves before it in tree order) and,
    for each weight, its sum over the node and all below it.

    Siblings, and roots, are in the given order, ties by id; null values sort first. Nodes that no root leads to (those of
    a ring, or below an unknown parent) are left out. Weights are whole numbers.
    """
    weights = weights or {}
    rows = nodes.select("*", *[F.coalesce(w.cast("long"), F.lit(0)).alias(f"w_{n}") for n, w in weights.items()])
    placed = _placed(rows, order, [f"w_{n}" for n in weights])
    leaf = F.col("first").isNull().cast("long")
    up = F.when(F.col("next").isNotNull(), 2 * F.col("next")).when(F.col("parent").isNotNull(), 2 * F.col("parent") + 1)
    # A root's way up leads to the next root's way down, or ends; a node below an unknown parent leads nowhere but to itself.
    lost = F.col("parent").isNull() & F.col("parent_id").isNotNull()
    up = F.when(lost, 2 * F.col("place")).otherwise(up)
    down = F.coalesce(2 * F.col("first"), 2 * F.col("place") + 1)
    names = ["leaves", "level", *[f"w_{n}" for n in weights]]
    downs = placed.select((2 * F.col("place")).alias("step"), down.alias("next"), leaf.alias("leaves"), F.lit(1).cast("long").alias("level"), *[F.col(f"w_{n}") for n in weights])
    ups = placed.select((2 * F.col("place") + 1).alias("step"), up.alias("next"), F.lit(0).cast("long").alias("leaves"), F.lit(-1).cast("long").alias("level"), *[F.lit(0).cast("long").alias(f"w_{n}") for n in weights])
    after = written(_suffix_sums(downs.unionByName(ups), names), "summed")
    total = after.agg(F.max("leaves")).first()[0] or 0
    first = after.select((F.col("step") / 2).cast("long").alias("place"), *[F.col(c).alias(f"a_{c}") for c in names]).filter(F.col("step") % 2 == 0)
    second = after.select(((F.col("step") - 1) / 2).cast("long").alias("place"), *[F.col(c).alias(f"b_{c}") for c in names]).filter(F.col("step") % 2 == 1)
    met = placed.select("id", "parent_id", "place", "first", "last", "parent").join(first, "place").join(second, "place")
    return met.select("id", "parent_id", "place", "first", "last", "parent", (-F.col("a_level")).cast("int").alias("depth"), (F.lit(total) - F.col("a_leaves")).alias("leaf_at"), (F.col("a_leaves") - F.col("b_leaves")).alias("leaves"), *[(F.col(f"a_w_{n}") - F.col(f"b_w_{n}")).alias(n) for n in weights])


def middles(tree: DataFrame) -> DataFrame:
    """place and x: a leaf's leaf_at, and for other nodes the middle of the first and the last child.

    Works by contraction. A node both of whose outer children are known is known; one with a single unknown outer child is
    a linear function of it, and chains of such nodes are shortened by doubling until they end at a node that waits for two
    or is known. Each round settles the outermost chains, so there are about as many rounds as the tree has branchings
    within branchings.
    """
    known = written(tree.filter("first is null").select("place", F.col("leaf_at").cast("double").alias("x")), "known")
    open_ = written(tree.filter("first is not null").select("place", "first", "last"), "open")
    while not open_.isEmpty():
        a = known.select(F.col("place").alias("first"), F.col("x").alias("xa"))
        b = known.select(F.col("place").alias("last"), F.col("x").alias("xb"))
        seen = open_.join(a, "first", "left").join(b, "last", "left")
        one = F.col("first") == F.col("last")
        on = F.when(F.col("xa").isNotNull() & F.col("xb").isNotNull(), F.lit(None)).when(one | F.col("xb").isNotNull(), F.col("first")).when(F.col("xa").isNotNull(), F.col("last"))
        slope = F.when(one & F.col("xa").isNull(), 1.0).otherwise(0.5)
        base = F.when(one & F.col("xa").isNull(), 0.0).when(F.col("xa").isNotNull() & F.col("xb").isNotNull(), (F.col("xa") + F.col("xb")) / 2).otherwise(F.coalesce("xa", "xb") / 2)
        linear = written(seen.filter("xa is not null or xb is not null or first = last").select("place", on.alias("on"), slope.alias("slope"), base.alias("base")), "linear")
        while True:
            ahead = linear.select(F.col("place").alias("on"), F.col("on").alias("_on"), F.col("slope").alias("_slope"), F.col("base").alias("_base"), F.lit(True).alias("_met"))
            joined = linear.join(ahead, "on", "left")
            moved = joined.select("place", F.when(F.col("_met"), F.col("_on")).otherwise(F.col("on")).alias("on"), F.when(F.col("_met"), F.col("slope") * F.col("_slope")).otherwise(F.col("slope")).alias("slope"), F.when(F.col("_met"), F.col("slope") * F.col("_base") + F.col("base")).otherwise(F.col("base")).alias("base"), (F.coalesce("_met", F.lit(False)) & F.col("_on").isNotNull()).alias("more"))
            linear = written(moved, "shortened")
            if linear.filter("more").isEmpty():
                break
            linear = linear.drop("more")
        done = written(linear.filter("on is null").select("place", F.col("base").alias("x")), "settled")
        known = written(known.unionByName(done), "known")
        open_ = written(open_.join(done.select("place"), "place", "left_anti"), "open")
    return known


def tidy_layout(nodes: DataFrame, order: list[str], column: float = 240.0, row: float = 150.0) -> DataFrame:
    """id, x, y of a tree drawing: leaves side by side in tree order, a parent over the middle of its children, levels below one another."""
    tree = written(toured(nodes, order), "toured")
    return tree.join(middles(tree), "place").select("id", (F.col("x") * column).alias("x"), (F.col("depth") * row).alias("y"))
