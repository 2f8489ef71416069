"""Rules over records of work: assignment, progress, completeness, staleness, transitions, repointing, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def least_used(items: DataFrame, holders: DataFrame) -> DataFrame:
    """Deals items (item) one after another to the holder (holder, load) that has least at that moment, the first by name.

    The n-th item goes to the n-th free place, places counted by level and holder; places of a level are as many as
    holders below it, so only levels up to the last one needed are laid out. Both sides are numbered in sorted ranges.
    """
    total = items.agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    spread = holders.agg(F.max("load").alias("most"), F.count("*").alias("holders")).withColumn("_one", F.lit(1))
    top = total.join(spread, "_one").select("_one", (F.col("most") + F.ceil(F.col("n") / F.col("holders"))).alias("top"))
    places = holders.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").filter("top > load").select("holder", F.explode(F.expr("sequence(load + 1, top)")).alias("level"))
    return numbered(items.select("item"), ["item"], "_n").join(numbered(places, ["level", "holder"], "_n"), "_n").select("item", "holder", "level")


def zipped(left: DataFrame, right: DataFrame, key: str, order: str, values: tuple[str, str]) -> DataFrame:
    """Rows of both sides with the same key and the same place in its order; complete says whether the key has as many of both."""
    w = Window.partitionBy(key).orderBy(order)
    number = lambda df, v: df.withColumn("place", F.row_number().over(w)).select(key, "place", v)
    both = number(left, values[0]).join(number(right, values[1]), [key, "place"], "full_outer")
    whole = F.bool_and(F.col(values[0]).isNotNull() & F.col(values[1]).isNotNull()).over(Window.partitionBy(key))
    return both.withColumn("complete", whole)


def reconciled_tables(snapshot: DataFrame, live: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Per group the rows that are equal, changed, only in the snapshot (gone) and only live (new)."""
    a, b = snapshot.select(key, F.col(group).alias("_ga"), F.col(value).alias("_a"), F.lit(1).alias("_ina")), live.select(key, F.col(group).alias("_gb"), F.col(value).alias("_b"), F.lit(1).alias("_inb"))
    both = (F.col("_ina") == 1) & (F.col("_inb") == 1)
    j = a.join(b, key, "full_outer").withColumn(group, F.coalesce("_gb", "_ga"))
    same = both & F.col("_a").eqNullSafe(F.col("_b"))
    return j.groupBy(group).agg(F.count_if(same).alias("equal"), F.count_if(both & ~same).alias("changed"), F.count_if(F.col("_inb").isNull()).alias("gone"), F.count_if(F.col("_ina").isNull()).alias("new"))


def repointed(grants: DataFrame, moved: DataFrame, owner: str, item: str) -> DataFrame:
    """Grants (owner, item) with items moved as told (item, kept); what an owner then has twice stays once."""
    return grants.join(moved.select(item, "kept"), item, "left").select(owner, F.coalesce("kept", item).alias(item)).distinct()


def completeness(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Share of the fields that a record has filled, in percent (blank text counts as empty)."""
    filled = sum((F.when(F.trim(F.col(f).cast("string")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return df.select(key, F.round(100.0 * filled / len(fields), 1).alias("percent"))


def stale(sources: DataFrame, built: DataFrame, key: str, builder: int) -> DataFrame:
    """Records to build anew: missing, made by an older builder, or older than their source (changed_at, built_at)."""
    j = sources.select(key, "changed_at").join(built.select(key, "built_at", F.col("builder").alias("_builder")), key, "left")
    why = F.when(F.col("built_at").isNull(), "missing").when(F.col("_builder") < builder, "older_builder").when(F.col("changed_at") > F.col("built_at"), "older_than_source")
    return j.withColumn("why", why).filter("why is not null").select(key, "why")


def ticket_activity(closed: Column, unread: Column, last_from_customer: Column) -> Column:
    """State that a desk shows: closed, else unread, else whose turn it is."""
    return F.when(closed, "closed").when(unread > 0, "unread").when(last_from_customer, "awaiting_us").otherwise("awaiting_them")


def load_band(seconds: Column) -> Column:
    return F.when(seconds < 60, "light").when(seconds < 600, "medium").otherwise("heavy")


def kept_grants(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Grants of a compiled permission: the wanted documents, but an administrator's grant that holds all of them stays as it is.

    wanted and present have keys and `documents` (an array); present has admin_granted.
    """
    j = wanted.join(present.select(*keys, F.col("documents").alias("_have"), "admin_granted"), keys, "left")
    wider = F.coalesce(F.col("admin_granted") & (F.size(F.array_except("documents", "_have")) == 0), F.lit(False))
    return j.select(*keys, F.when(wider, F.col("_have")).otherwise(F.col("documents")).alias("documents"), wider.alias("kept"))


def nearest_senior(paths: DataFrame, people: DataFrame) -> DataFrame:
    """Each node's supervisor: the nearest active node above it of strictly smaller rank, else the active one of least rank.

    paths as hierarchy.ancestor_paths gives them; people have id, rank, active. The fallback is the first by rank and id,
    nobody being their own.
    """
    up = paths.select("id", F.posexplode("ids").alias("at", "above")).filter("above <> id")
    own, other = people.select("id", F.col("rank").alias("_own")), people.filter("active").select(F.col("id").alias("above"), "rank")
    met = up.join(other, "above").join(own, "id").filter("rank < _own").groupBy("id").agg(F.max_by("above", "at").alias("supervisor"))
    tops = people.filter("active").orderBy("rank", "id").limit(2).agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("tops")).withColumn("_one", F.lit(1))
    named = people.select("id").join(met, "id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(tops), "_one")
    first = F.get(F.filter("tops", lambda t: t["id"] != F.col("id")), F.lit(0))["id"]
    return named.select("id", F.coalesce("supervisor", first).alias("supervisor"), F.col("supervisor").isNull().alias("fallback"))


def section_gaps(vehicles: DataFrame, sections: DataFrame, rules: DataFrame) -> DataFrame:
    """stem, missing, empty, optional_missing (sorted titles) of every vehicle.

    vehicles: stem, electrified, pure_electric. sections: stem, title, leaves (with content). rules: title, requirement, one of
    required, electrified (for such vehicles only), combustion (not for purely electric ones), optional. Titles compare in
    lower case without double blanks. Only optional sections may be missing without being a gap; empty ones of them are none.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    fits = (F.col("requirement") != "electrified") | F.col("electrified")
    fits = fits & ((F.col("requirement") != "combustion") | ~F.col("pure_electric"))
    # A few rules for each vehicle: they travel as one list.
    listed = rules.agg(F.collect_list(F.struct(plain("title").alias("title"), "requirement")).alias("rules")).withColumn("_one", F.lit(1))
    expected = vehicles.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").select("stem", "electrified", "pure_electric", F.explode("rules").alias("r")).select("stem", "electrified", "pure_electric", "r.title", "r.requirement").filter(fits)
    have = sections.groupBy("stem", plain("title").alias("title")).agg(F.sum("leaves").alias("leaves"))
    met = expected.join(have, ["stem", "title"], "left")
    of = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("title"))))
    optional = F.col("requirement") == "optional"
    gaps = met.groupBy("stem").agg(of(~optional & F.col("leaves").isNull()).alias("missing"), of(~optional & (F.col("leaves") == 0)).alias("empty"), of(optional & F.col("leaves").isNull()).alias("optional_missing"))
    none = F.array().cast("array<string>")
    return vehicles.select("stem").join(gaps, "stem", "left").select("stem", *[F.coalesce(c, none).alias(c) for c in ("missing", "empty", "optional_missing")])


def exemplars(batches: DataFrame, dictionary: DataFrame, matched: int = 5, stable: int = 5) -> DataFrame:
    """batch, id, kind, place: examples for each batch of terms (batch, words) out of a dictionary (id, words).

    matched: the first rows by id that share a word with the batch; stable: rows at even distances over the dictionary by id
    that are not among those. Of each word only the first rows are looked at, as no later one can be among a batch's first.
    """
    entry = dictionary.select("id", F.explode(F.array_distinct("words")).alias("word"))
    first = entry.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("id"))).filter(F.col("k") <= matched).select("word", "id")
    words = batches.select("batch", F.explode("words").alias("word")).distinct()
    near = words.join(first, "word").select("batch", "id").distinct()
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("id"))).filter(F.col("place") <= matched)
    placed = numbered(dictionary.select("id"), ["id"], "n")
    step = max(1, dictionary.count() // max(1, stable))
    # As many as could be among the matched ones more than wanted.
    even = placed.filter((F.col("n") - 1) % step == 0).orderBy("n").limit(stable + matched).select("id")
    every = even.agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("_one", F.lit(1))
    asked = batches.select("batch").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").select("batch", F.explode("ids").alias("id")).join(near.select("batch", "id"), ["batch", "id"], "left_anti")
    rest = asked.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("id"))).filter(F.col("place") <= stable)
    return near.select("batch", "id", F.lit("matched").alias("kind"), "place").unionByName(rest.select("batch", "id", F.lit("stable").alias("kind"), "place"))
