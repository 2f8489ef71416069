"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

A source's documents form blocks of `block_docs`. With weight w, its block j (from 0) is released at slot floor(j / w) and
due at ceil((j + 1) / w); each slot takes the released block with the earliest deadline, the first source by name if several
are due alike. So after any number of slots a source is less than one block away from weight x slots.

Weights are whole numbers m of a sum M, w = m / M, so releases and deadlines are exact; where a weight had to be rounded to
10^-9 of the sum, its unrounded value is at most slots x 10^-9 blocks further away. The slots are simulated in chunks of
a fixed length, each a row of its own: all that a chunk needs from those before it is how many blocks each source has had.
At slot T that is floor(w T) or, for some sources, one more. Which sources, comes from a short simulation: it begins at
an earlier slot B with the sources whose next block is due first, meets all deadlines from there on, and lasts
longer than the longest window from release to deadline, so that no block of slots before B is open any more. Both ends of
a chunk thus belong to a valid schedule, and the chunk runs from one to the other with its deadlines cut at its end.

A source that has run out leaves its further slots empty; the others keep their slots, hence their proportions to each
other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

NO_SOURCE = "(none)"
#: Weights that are not whole numbers are rounded to this share of their sum.
SCALE = 1_000_000_000
#: The least length of a chunk, in slots, and the picks that are held in one array while a chunk is simulated.
_CHUNK, _PICKS = 1024, 512


def _pick(done: str, slot: str, limit: str = "true", due: str = "{due}") -> str:
    """SQL for the number of the source whose block is due first, of those released (or else of those to come)."""
    own = f"(({done}[i] + 1) * total + m - 1) div m"
    return f"array_min(transform(m, (m, i) -> if({limit}, named_struct('late', {done}[i] * total div m > {slot}, 'due', {due.format(due=own)}, 'i', i), null))).i"


def _after(slot: str) -> str:
    """SQL for the blocks that each source has had before a slot at which a chunk begins."""
    from_ = f"({slot} - warm)"
    open_ = f"filter(transform(m, (m, i) -> named_struct('due', ((m * {from_} div total + 1) * total + m - 1) div m, 'i', i, 'open', m * {from_} % total > 0)), x -> x.open)"
    first = f"transform(slice(array_sort({open_}), 1, cast({from_} - aggregate(m, 0L, (a, m) -> a + m * {from_} div total) as int)), x -> x.i)"
    start = f"transform(array({first}), f -> transform(m, (m, i) -> m * {from_} div total + if(array_contains(f, i), 1L, 0L)))[0]"
    step = f"transform(array({_pick('d', 't')}), p -> transform(d, (x, i) -> if(i = p, x + 1L, x)))[0]"
    return f"if({slot} = 0, transform(m, m -> 0L), aggregate(sequence({from_}, {slot} - 1), {start}, (d, t) -> {step}))"


def pfair_schedule(weights: DataFrame, slots_col: str = "slots") -> DataFrame:
    """The slots of sources with whole-number weights (columns source, m; slots: how many slots are wanted, the same in each row).

    Returns source, nth (its block), slot: at least so many slots, one row each.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("source", "m"))).alias("s"), F.max(slots_col).alias("slots"))
    arrays = one.select("slots", F.expr("transform(s, x -> x.source)").alias("sources"), F.expr("transform(s, x -> x.m)").alias("m"), F.expr("aggregate(s, 0L, (a, x) -> a + x.m)").alias("total"))
    # A chunk is longer than two windows, so no block is open for a whole chunk; the simulation before it, longer than one.
    sized = arrays.filter("total > 0").withColumn("warm", F.expr(f"greatest({_CHUNK // 2}L, (total + array_min(m) - 1) div array_min(m) + 1)")).withColumn("chunk", F.col("warm") * 2)
    row = staged(sized.withColumn("chunks", F.expr("greatest(1L, (slots + chunk - 1) div chunk)")), "weights")
    starts = row.withColumn("from", F.explode(F.expr("transform(sequence(0L, chunks - 1), c -> c * chunk)"))).repartition("from")
    starts = starts.withColumn("until", F.expr("if(chunks = 1, greatest(1L, slots), from + chunk)"))
    pick = _pick("y.done", "t", "y.done[i] < y.stop[i]", "least({due}, y.due)")
    fold = f"""
        aggregate(
          sequence(from, until - 1, {_PICKS}L),
          named_struct('done', {_after('from')}, 'stop', if(chunks = 1, transform(m, m -> 9223372036854775807L), {_after('until')}),
                       'due', if(chunks = 1, 9223372036854775807L, until), 'parts', cast(array() as array<array<struct<i: int, nth: bigint>>>)),
          (x, b) -> transform(
            array(aggregate(
              sequence(b, least(b + {_PICKS}L, until) - 1),
              named_struct('done', x.done, 'stop', x.stop, 'due', x.due, 'picks', cast(array() as array<struct<i: int, nth: bigint>>)),
              (y, t) -> transform(array({pick}), p -> named_struct(
                'done', transform(y.done, (d, i) -> if(i = p, d + 1L, d)), 'stop', y.stop, 'due', y.due,
                'picks', concat(y.picks, array(named_struct('i', p, 'nth', y.done[p])))))[0])),
            z -> named_struct('done', z.done, 'stop', z.stop, 'due', z.due, 'parts', concat(x.parts, array(z.picks))))[0],
          x -> flatten(x.parts))"""
    picks = starts.select("from", "sources", F.posexplode(F.expr(fold)).alias("at", "pick"))
    return picks.select(F.expr("sources[pick.i]").alias("source"), F.col("pick.nth").alias("nth"), (F.col("from") + F.col("at")).alias("slot"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_docs: int = 16, id_col: str = "doc_id", source_col: str = "source", keep: bool = False) -> DataFrame:
    """Places every document in the mix: doc_id, source, block, slot, place; with keep also `row`, a struct of all columns.

    Reading by (slot, place) gives the mix. Without weights, a source weighs its number of documents to the power of
    temperature. Given weights count relative to their sum; negative and non-finite ones are an error. Whole numbers of a sum
    up to 10^9 are taken exactly, others to 10^-9 of the sum. A source that `weights` leaves out, or gives 0, comes
    after all others, so that no row is lost. Null source: the source "(none)". A source's documents come in the order of md5
    of the id's text, then the id; null ids by a hash of the row, repeated rows next to each other in any order. Other
    columns, whatever their names, are only in `row`. An empty table gives an empty result.

    Ranks are counted in hash ranges of about 1000 documents, whose sizes are then added up, so a source with a third of
    all rows is no hot task.
    """
    if weights and not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    nulls = F.when(F.col(id_col).isNull(), F.xxhash64("*")).alias("null_key")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"), nulls, *([F.struct("*").alias("row")] if keep else []))
    counts = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else F.lit(None).cast("map<string,double>")
        weighed = counts.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)))
    # One row of all sources, so that each sees the sums; then written: a small table, which Spark broadcasts by its size.
    exact = F.expr(f"forall(all, x -> x.weight = floor(x.weight)) and total <= {SCALE}")
    one = weighed.agg(F.sort_array(F.collect_list(F.struct("source", "n", "weight"))).alias("all"), F.sum("weight").alias("total"))
    scaled = one.select(F.explode("all").alias("x"), exact.alias("exact"), "total").select("x.source", "x.n", F.expr(f"cast(if(x.weight = 0, 0, if(exact, x.weight, greatest(1, round(x.weight / total * {SCALE})))) as bigint)").alias("m"))
    many = F.expr(f"(n + {int(block_docs)} - 1) div {int(block_docs)}")
    needed = scaled.agg(F.collect_list(F.struct("source", "n", "m", many.alias("blocks"))).alias("all")).withColumn("sum", F.expr("aggregate(all, 0L, (a, x) -> a + x.m)"))
    last = F.expr("array_max(transform(all, x -> if(x.m > 0, (x.blocks * sum + x.m - 1) div x.m, 0L)))")
    after = "aggregate(filter(all, y -> y.m = 0 and y.source < x.source), 0L, (a, y) -> a + y.blocks)"
    quotas = staged(needed.withColumn("slots", last).select("slots", F.explode(F.expr(f"transform(all, x -> struct(x.source, x.n, x.m, {after} as after))")).alias("x")).select("x.*", "slots"), "quotas")
    schedule = staged(pfair_schedule(quotas.filter("m > 0").select("source", "m", "slots")), "schedule")

    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("null_key").cast("string"))).cast("binary"))
    hashed = base.join(quotas, "source").withColumn("key", key)
    ranged = hashed.withColumn("range", F.expr("cast(conv(substr(key, 1, 8), 16, 10) as bigint) * (1 + n div 1000) div 4294967296L"))
    before = F.coalesce(F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("source", "range").agg(F.count("*").alias("in_range")).select("source", "range", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("source", "range").orderBy("key", "doc_id")) - 1
    ranked = ranged.withColumn("nth_in_range", nth).join(ranges, ["source", "range"]).withColumn("rank", F.col("before") + F.col("nth_in_range"))
    blocks = ranked.withColumn("block", F.expr(f"rank div {int(block_docs)}")).withColumn("place", F.expr(f"rank % {int(block_docs)}"))
    placed = blocks.join(schedule.select("source", F.col("nth").alias("block"), F.col("slot").alias("own")), ["source", "block"], "left")
    return placed.select("doc_id", "source", "block", F.coalesce("own", F.expr("slots + after + block")).alias("slot"), "place", *(["row"] if keep else []))
