"""Similarity join of documents by the Jaccard coefficient of their word shingles, with token-combination prefixes.

A document's set is that of its distinct n-word shingles (64-bit hashes). All sets are ordered alike: rare shingles
first, then the frequent ones by document frequency. Two sets that reach the threshold share at least l shingles within
their prefixes of length size - ceil(threshold * size) + l. So rare shingles of the 1-prefix are indexed one by one,
frequent ones of the extended 2-prefix in pairs. A set whose prefix holds many frequent shingles (a member of a large
group of near copies) would give too many pairs: it indexes its frequent shingles one by one as well, and sets with
pairs also look up ("probe") single frequent shingles, to meet just those.

Sets that are equal form one class, which takes part once. Index entries with the same key are not paired with each
other at once: each class is first verified against the smallest class that it meets, the resulting components are
found, and only entries of one key that are still in different components are paired, verified and linked. A group of
m near copies thus costs about m verifications, and no link between different texts is lost.

At keys that many classes share, pairs are told apart by bit maps before they become rows: a map holds the parity of the
number of a set's shingles in each of 512 parts, so two maps differ in at most as many bits as the sets differ in
shingles. Sets that share a passage but too little else make no rows there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, give_back_memory, mix64, rows_of, staged, text_blocks, word_hashes
from .components import connected_components

_K = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles counted together before the counts of the repeated ones leave the task.
_COUNT_BLOCK = 1 << 22
#: Sets of so many representatives at most are looked up by broadcast (16 bytes each).
_BROADCAST_IDS = 500_000
#: Words of 64 bits of a set's bit map, and entries from which on a key's pairs are told apart by it.
_MAP_WORDS = 8
_CROWDED = 16


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; ASCII letters count in lower case.

    Words are runs of bytes other than white space (space, tab to carriage return). A text of fewer words has one
    shingle, the whole sequence; one without words has none.
    """
    out: list[np.ndarray] = []
    for a, b in byte_blocks(texts):
        part = [t.lower() for t in texts[a:b]]
        h, doc, _, _ = word_hashes(part)
        m = len(h)
        s = np.zeros(max(0, m - words + 1), np.uint64)
        for j in range(words):
            s += h[j : m - words + 1 + j] * _K[j] if m >= words else 0
        s = mix64(s)
        ends = np.cumsum(np.bincount(doc, minlength=len(part)))
        start = 0
        for end in ends.tolist():
            if end - start >= words:
                out.append(np.unique(s[start : end - words + 1]))
            elif end > start:
                out.append(mix64((h[start:end] * _K[: end - start]).sum(keepdims=True) + _K[words + end - start]))
            else:
                out.append(h[:0])
            start = end
    return out


def _class_of(s: np.ndarray) -> int:
    """64-bit identity of a set, as a signed integer."""
    return int(mix64(mix64(s ^ _K[40]).sum(keepdims=True) + np.full(1, len(s), np.uint64) * _K[41]).view(np.int64)[0])


def parity_map(s: np.ndarray) -> np.ndarray:
    """64-bit words whose bits are the parities of the number of hashes in each part: linear in the symmetric difference."""
    odd = (np.bincount((s & np.uint64(64 * _MAP_WORDS - 1)).view(np.int64), minlength=64 * _MAP_WORDS) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _profile(words: int):
    """Rows (kind 0: doc_id, class, set size, bit map) and (kind 1: shingle, sets of a block that hold it, if several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def counted() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            held.clear()
            part = (every >> np.uint64(61)).astype(np.uint8)
            for k in range(8):  # an eighth of the hashes at a time
                token, n = np.unique(every[part == k], return_counts=True)
                token, n = token[n > 3], n[n > 3]
                none = pa.nulls(len(n), pa.list_(pa.int64()))
                yield _batch([np.ones(len(n), np.int64), token.view(np.int64), n, np.zeros(len(n), np.int64), none], "kind", "a", "b", "n", "bits")

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, texts in text_blocks(batch):
                sets = shingle_sets(texts, words)
                classes = [_class_of(s) if len(s) else None for s in sets]
                maps = pa.ListArray.from_arrays(pa.array(np.arange(0, _MAP_WORDS * len(sets) + 1, _MAP_WORDS), pa.int32()), pa.array(np.concatenate([parity_map(s) for s in sets])))
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int64()), ids.slice(a, b - a), pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), maps], ["kind", "a", "b", "n", "bits"])
                for c, s in zip(classes, sets):
                    if c is not None and c not in seen:
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                        if size >= _COUNT_BLOCK:
                            yield from counted()
                            size, seen = 0, set()
        if held:
            yield from counted()
        give_back_memory()

    return run


def _batch(columns: list[np.ndarray | pa.Array], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], list(names))


def prefix_keys(s: np.ndarray, often: np.ndarray, counts: np.ndarray, percent: int, most_pairs_of: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """Index keys of a set, for each size << 32 | place of the last shingle << 2 | (shingles - 1) << 1 | probe, and the set's thousandths of rare shingles."""
    n = len(s)
    least = -(-percent * n // 100)
    one, two = n - least + 1, n - least + 2
    at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
    frequent = often[at] == s if len(often) else np.zeros(n, bool)
    rare = s[~frequent]
    r = len(rare)
    base = n << 32
    keys = [rare[:one]]
    metas = [base | (np.arange(min(r, one), dtype=np.int64) << 2)]
    if r < (two if least > 1 else one):
        f = s[frequent]
        f = f[np.lexsort((f, counts[at[frequent]]))]
        single = f[: max(0, one - r)]
        paired = least > 1 and two - r <= most_pairs_of
        keys.append(single)
        metas.append(base | (np.arange(r, r + len(single), dtype=np.int64) << 2) | int(paired))
        if paired:
            i, j = np.triu_indices(min(len(f), two - r), 1)
            keys.append(mix64(f[i] * _K[50] + f[j] * _K[51]))
            metas.append(base | ((r + j.astype(np.int64)) << 2) | 2)
    return np.concatenate(keys).view(np.int64), np.concatenate(metas), 1000 * r // n


def _may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that meet at an index key can share enough: sizes, places in the prefixes, and not two probes."""
    na, nb = a >> 32, b >> 32
    rest = np.minimum(na - ((a & 0xFFFFFFFF) >> 2), nb - ((b & 0xFFFFFFFF) >> 2)) - 1
    return (((a >> 1) & 1) + 1 + rest >= -(-percent * (na + nb) // (100 + percent))) & ((a & b & 1) == 0)


def _may_link_sql(percent: int) -> str:
    place = "(({0} & 4294967295L) >> 2)"
    return f"((x.meta >> 1) & 1) + least((x.meta >> 32) - {place.format('x.meta')}, (y.meta >> 32) - {place.format('y.meta')}) >= ceil({percent} * ((x.meta >> 32) + (y.meta >> 32)) / {100 + percent}.0D) and (x.meta & y.meta & 1L) = 0"


def _indexer(frequent, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = frequent.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, texts in text_blocks(batch, 1 << 21):
                keys, classes, metas, rares = [], [], [], []
                for s in shingle_sets(texts, words):
                    if len(s) and (c := _class_of(s)) not in seen:
                        if len(seen) >= 1 << 20:
                            seen.clear()
                        seen.add(c)
                        k, m, rare = prefix_keys(s, often, counts, percent)
                        keys.append(k)
                        metas.append(m)
                        classes.append(np.full(len(k), c, np.int64))
                        rares.append(np.full(len(k), rare, np.int32))
                if keys:
                    yield _batch([np.concatenate(keys), np.concatenate(classes), np.concatenate(metas), np.concatenate(rares)], "key", "class", "meta", "rare")
        give_back_memory()

    return run


def _stars(percent: int):
    """Of entries sorted by key, those whose key several classes have, with the key's first class as pivot.

    One row of a key is held at a time, so a key that very many classes share takes no more memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shown = None, False
        for batch in batches:
            key, cls, meta = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            if held:
                key, cls, meta = (np.concatenate([np.array([h], np.int64), x]) for h, x in zip(held, (key, cls, meta)))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            pivot = starts[run_of]
            other = cls != cls[pivot]
            several = np.logical_or.reduceat(other, starts)
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (cls[1:] == cls[:-1])])
            keep = several[run_of] & ~same
            if shown:  # the held row has been given out before
                keep[0] = False
            last = starts[-1]
            shown = bool(several[-1]) or (shown and last == 0)
            held = (key[last], cls[last], meta[last])
            may = _may_link(meta, meta[pivot], percent)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cls[keep]), pa.array(meta[keep]), pa.array(cls[pivot][keep], mask=~other[keep]), pa.array(may[keep])], ["key", "class", "meta", "pivot", "may"])

    return run


def _shared_enough(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(x)) for x in ("set_a", "set_b"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            rows = batch.select(["a", "b"]).filter(pa.array(keep))
            if rows.num_rows:
                yield rows

    return run


def _packed_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = rows_of(batch, "class")
            for a, b, texts in text_blocks(batch):
                # An id that several rows have may come with several texts: only the class's own set counts.
                own = [(c, s.tobytes()) for c, s in zip(classes[a:b], shingle_sets(texts, words)) if len(s) and _class_of(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], ["class", "shingles"])
        give_back_memory()

    return run


def ngram_jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, frequent_from: int = 64, star_rounds: int = 2) -> DataFrame:
    """Groups documents linked by shingle sets of Jaccard coefficient >= percent / 100.

    Returns doc_id, n_shingles (set size), set_id (64-bit identity of the set, null if empty), component_id (smallest
    doc_id reachable by links, itself included). One row per input row; repeated rows stay. Null or blank text: an empty
    set, linked with nothing. A null id: component_id null, linked with nothing. Other columns are ignored. An empty
    table gives an empty result.

    The frequent shingles (broadcast) are those found at least max(frequent_from, shingles / 2^20) times, so there are
    2^20 of them at most, whatever the corpus. A shingle's frequency counts blocks of 2^22 shingles in which it is in
    more than three sets; a shingle that this leaves out counts as rare, which costs time but loses nothing.
    """
    if star_rounds < 1:
        raise ValueError("star_rounds must be 1 or more")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = staged(docs.mapInArrow(_profile(words), "kind long, a long, b long, n long, bits array<long>"), "profile")
    rows = profile.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("b").alias("class"))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    floor = max(frequent_from, total >> 20)
    often = profile.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).filter(F.col("n") >= floor).toArrow()
    token, count = often.column("a").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(token)
    frequent = spark.sparkContext.broadcast((token[order], count[order]))

    known = docs.filter("doc_id is not null")
    index = known.select("text").mapInArrow(_indexer(frequent, words, percent), "key long, class long, meta long, rare int")
    # A key's first entry is its pivot: a set of the fewest rare shingles, which among near copies is the one most like all.
    shared = staged(index.repartition("key").sortWithinPartitions("key", "rare", "class").mapInArrow(_stars(percent), "key long, class long, meta long, pivot long, may boolean"), "shared")
    reps = rows.filter("doc_id is not null and class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = staged(pairs, f"pairs-{label}")
        ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = staged(reps.join(ends, "class"), f"wanted-{label}")
        side = F.broadcast(wanted) if wanted.count() <= _BROADCAST_IDS else wanted
        texts = known.join(side, known.doc_id == side.rep).select("class", "text")
        sets = staged(texts.mapInArrow(_packed_sets(words), "class long, shingles binary"), f"sets-{label}")
        met = pairs.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), "a")
        return staged(met.select("a", "b", "set_a", "set_b").mapInArrow(_shared_enough(percent), "a long, b long"), f"links-{label}")

    # Stars: each class with the pivot that it meets at most keys, until a round finds little.
    links, tried, met, base = None, None, shared.filter("pivot is not null"), shared.select("key", "class", "meta")
    for r in range(star_rounds):
        counted = met.groupBy("class", "pivot").agg(F.count("*").alias("keys"), F.first(F.expr("meta >> 32")).alias("n"), F.bool_or("may").alias("may"))
        # Few common keys make a link unlikely; the last step looks at those.
        best = counted.filter(f"may and keys * 300 >= n * {100 - percent}").select(F.col("pivot").alias("a"), F.col("class").alias("b"), "keys")
        best = best if tried is None else best.join(tried, ["a", "b"], "left_anti")
        star = staged(best.groupBy("b").agg(F.max_by("a", F.struct("keys", "a")).alias("a")).select("a", "b"), f"star{r}")
        tried = star if tried is None else tried.unionByName(star)
        found = verified(star, f"star{r}")
        links = found if links is None else links.unionByName(found)
        roots = staged(connected_components(links).select(F.col("node").alias("class"), "root"), "roots")
        marked = base.join(F.broadcast(roots) if roots.count() <= _BROADCAST_IDS else roots, "class", "left").select("key", "class", "meta", F.coalesce("root", "class").alias("root")).repartition("key")
        # Entries of a key whose classes are all in one component are done; of the others another class becomes the pivot.
        turn = F.struct(F.xxhash64("class", F.lit(r)).alias("turn"), "class", "meta", "root")
        split = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(turn).alias("pivot"), F.count("*").alias("entries")).filter("lo <> hi").select("key", "pivot", "entries")
        open_ = staged(marked.join(split, "key"), "open")
        base = open_.select("key", "class", "meta")
        if found.count() * 20 < star.count() or not star.count():
            break
        met = open_.filter("root <> pivot.root").select("class", F.col("pivot.class").alias("pivot"), "meta", F.expr(_may_link_sql(percent).replace("x.meta", "meta").replace("y.meta", "pivot.meta")).alias("may"))
    # The rest: sets in different components that share a key. All shingles of the 1-prefixes are keys, so their common
    # ones are counted, and a pair that reaches the threshold has a least number of them. Sets of too different sizes never
    # meet; the partitions of a key that very many sets share are split by adaptive execution. A pair that reaches the
    # threshold passes the bit maps at every key, so its count stays whole.
    size, other = "(any_value(x.meta) >> 32)", "(any_value(y.meta) >> 32)"
    need = f"ceil({percent} * ({size} + {other}) / {100 + percent}.0D) - greatest(ceil({percent} * {size} / 100.0D), ceil({percent} * {other} / 100.0D)) + 1"
    alike = f"{percent} * (x.meta >> 32) <= 100 * (y.meta >> 32) and {percent} * (y.meta >> 32) <= 100 * (x.meta >> 32)"
    crowded = open_.filter(F.col("entries") >= _CROWDED).select("key", "class", "meta", "root")
    members = crowded.select("class").distinct()
    maps = profile.filter("kind = 0 and a is not null").select(F.col("b").alias("class"), "bits").join(members, "class").groupBy("class").agg(F.any_value("bits").alias("bits"))
    crowded = staged(crowded.join(maps, "class"), "crowded")
    differ = " + ".join(f"bit_count(x.bits[{i}] ^ y.bits[{i}])" for i in range(_MAP_WORDS))
    close = f"{100 + percent} * ({differ}) <= {100 - percent} * ((x.meta >> 32) + (y.meta >> 32))"
    met_at = f"x.key = y.key and x.class < y.class and x.root <> y.root and {alike}"
    sparse = open_.filter(F.col("entries") < _CROWDED).select("key", "class", "meta", "root")

    def counts(side: DataFrame, on: str) -> DataFrame:
        pairs = side.alias("x").join(side.alias("y"), F.expr(on))
        return pairs.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(F.expr("count_if((x.meta & 2L) = 0)").alias("common"), F.expr(f"bool_or({_may_link_sql(percent)})").alias("met"), F.expr(need).alias("need"))

    both = counts(sparse, met_at).unionByName(counts(crowded, f"{met_at} and {close}"))
    rest = both.groupBy("a", "b").agg(F.sum("common").alias("common"), F.bool_or("met").alias("met"), F.any_value("need").alias("need"))
    rest = rest.filter("met and common >= need").select("a", "b")
    links = links.unionByName(verified(rest, "rest"))
    roots = connected_components(links)
    named = reps.join(roots.withColumnRenamed("node", "class"), "class")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    grouped = reps.join(roots.withColumnRenamed("node", "class"), "class", "left").join(least, "root", "left").select("class", F.coalesce("component", "rep").alias("component"))
    return rows.join(grouped, "class", "left").select("doc_id", "n_shingles", F.col("class").alias("set_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
