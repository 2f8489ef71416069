"""Periodic runs of words: maximal stretches that repeat themselves with a period, at all scales.

Words at i and i + q are equal over a stretch of at least 2q places in a run of period q that repeats three times. For each
octave of periods, boundaries are set in a fixed distance that no such stretch can step over. A document is exploded into
overlapping tiles around its boundaries, octave by octave; only tiles go on in which a window of hashed words at a boundary
comes again within the octave's distance, as it must in a run. Tiles are solved independently of one another: Z-functions
at a boundary give, for all periods of the octave at once, how far the text agrees with itself forwards and backwards, up
to the next boundaries. These fragments are shuffled by document and period and stitched where they meet.

A run found under a multiple of its period covers the very same words (by the periodicity lemma, as it is at least three
periods long), so the smallest period of equal stretches is the run's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back_memory, mix64, staged, text_blocks, word_hashes

#: Least words of a run, and least repeats.
SHORTEST, REPEATS = 24, 3
#: Words that the boundaries of one tile span at least.
_SPAN = 4096


def octaves(longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(least period, end of periods, distance of boundaries, window) for texts of so many words.

    With 24 words and three repeats, periods below 8 agree over more than 16 places: they share the first octave.
    """
    low = 1
    while REPEATS * low <= longest:
        high = max(8, 2 * low)
        yield low, high, max(16, high), max(8, low)
        low = high


def _unlike(n: int, salt: int) -> np.ndarray:
    """Numbers that no window of words has."""
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(salt << 40))


def _repeated_at(window: np.ndarray, low: int, high: int, step: int, width: int) -> np.ndarray:
    """Boundaries (multiples of step) whose window forwards or backwards comes again low to high - 1 words later."""
    rows = -(-len(window) // step) + 1
    grid = np.concatenate([window, _unlike(rows * step - len(window), 3)]).reshape(rows, step)
    met = (grid[:, low:high] == grid[:, :1]).any(1)
    # The window that ends at a boundary begins in the row before, and comes again there or in the boundary's row.
    again, first = (grid[:-1, step - width + low : step - width + high], 1) if high <= width else (grid[1:, :width], 1)
    met[first:] |= (again == grid[:-1, step - width, None]).any(1)
    return np.flatnonzero(met[:-1]) * step


def tiles_of(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """Tiles of a block of documents (hashed words, and each word's document) that may hold fragments of runs.

    Yields document, least period, end of periods, place of the first word in its document, words (numbered anew), and
    boundaries (places in the tile).
    """
    if not len(codes):
        return
    size = np.bincount(owner)
    start = np.concatenate([[0], np.cumsum(size)])
    # Words of different documents are never alike.
    window, width = codes ^ _unlike(len(size), 1)[owner], 1
    for low, high, step, wanted in octaves(int(size.max())):
        while width < wanted:
            longer = window[:-width] + window[width:] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) if len(window) > width else window[:0]
            window = np.concatenate([longer, _unlike(min(width, len(window)), 7 + width)])
            width *= 2
        at = _repeated_at(window, low, high, step, width)
        at = at[at < len(codes)]
        if not len(at):
            continue
        doc = owner[at]
        span = max(step, _SPAN)
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] // span != at[:-1] // span)) + 1
        for a, b in zip([0, *cut], [*cut, len(at)]):
            d = int(doc[a])
            first, last = max(int(start[d]), int(at[a]) - step), min(int(start[d + 1]), int(at[b - 1]) + 2 * step)
            yield d, low, high, first - int(start[d]), np.unique(codes[first:last], return_inverse=True)[1].astype(np.int32), at[a:b] - first


def z_function(words: list[int], upto: int) -> list[int]:
    """For places below upto: how many words from there on agree with those at the beginning."""
    n, z, left, right = len(words), [0] * upto, 0, 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def fragments_of(words: list[int], boundaries: list[int], low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Stretches (period, first, end) of the tile's places i with words[i] == words[i + period].

    A stretch that reaches a next boundary is given whatever its length, others if they can be a whole run's.
    """
    step = max(16, high)
    period = np.arange(low, high)
    least = np.maximum((REPEATS - 1) * period, SHORTEST - period)
    open_: dict[int, tuple[int, int]] = {}
    for c in boundaries:
        ahead = words[c : c + 2 * step]
        forward = np.zeros(high, np.int64)
        z = z_function(ahead, min(high, len(ahead)))
        forward[: len(z)] = z
        forward = np.minimum(forward[low:], step)
        behind = words[max(0, c - step) : c][::-1]
        end = min(len(words), c + high - 1)
        z = np.array(z_function([*behind, -1, *words[max(0, c - step) : end][::-1]], len(behind) + 1 + end - max(0, c - step)), np.int64)
        place = end - c - period
        backward = np.where(place >= 0, z[np.maximum(len(behind) + 1 + place, 0)], 0)
        for i in np.flatnonzero((forward + backward >= least) | (forward == step) | (backward == step)).tolist():
            q, a, b = low + i, c - int(backward[i]), c + int(forward[i])
            before = open_.get(q)
            if before and a <= before[1]:
                a, b = before[0], max(b, before[1])
            elif before:
                yield q, *before
            open_[q] = (a, b)
    for q, (a, b) in open_.items():
        yield q, a, b


_TILED = "doc_id long, text_key long, low int, high int, base long, words binary, boundaries binary, text string"


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of each text, and beside them the text itself, if it has any."""
    names = ["doc_id", "text_key", "low", "high", "base", "words", "boundaries", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    for batch in batches:
        ids, keys = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_key"))
        for a, _, texts in text_blocks(batch):
            codes, owner, _, _ = word_hashes(texts)
            out, size, met = [], 0, set()
            for d, low, high, base, words, at in tiles_of(codes, owner):
                key = ids[a + d].as_py(), keys[a + d].as_py()
                if d not in met:
                    met.add(d)
                    out.append((*key, None, None, None, None, None, texts[d].decode()))
                    size += len(texts[d])
                out.append((*key, low, high, base, words.tobytes(), at.astype(np.int32).tobytes(), None))
                size += words.nbytes
                if size > 1 << 22:
                    yield give(out)
                    out, size = [], 0
            if out:
                yield give(out)
    give_back_memory()


def _without_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that have no tile, with single spaces: they have no run."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for a, b, texts in text_blocks(batch):
            codes, owner, _, _ = word_hashes(texts)
            rest = np.ones(b - a, bool)
            rest[[d for d, *_ in tiles_of(codes, owner)]] = False
            at = np.flatnonzero(rest)
            whole = pa.array([b" ".join(texts[i].split()) for i in at.tolist()], pa.binary()).cast(pa.string())
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), pa.array([], _RUN))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(at)), none, whole], ["doc_id", "runs", "collapsed"])
    give_back_memory()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of = lambda name: batch.column(batch.schema.get_field_index(name))
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            doc, key, low, high, base, words, at = (of(c)[i].as_py() for c in ("doc_id", "text_key", "low", "high", "base", "words", "boundaries"))
            found = fragments_of(np.frombuffer(words, np.int32).tolist(), np.frombuffer(at, np.int32).tolist(), low, high)
            rows.extend((doc, key, q, base + a, base + b) for q, a, b in found)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["doc_id", "text_key", "period", "first", "stop"])


def stitched(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments (first, stop) of each group that overlap or touch, as one."""
    by = Window.partitionBy(*keys).orderBy("first", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    numbered = fragments.withColumn("_new", F.when(F.col("first") <= before, 0).otherwise(1)).withColumn("_piece", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_piece").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("_piece")


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column(batch.schema.get_field_index("runs"))
        for a, b, texts in text_blocks(batch):
            out = []
            for text, found in zip(texts, runs.slice(a, b - a).to_pylist()):
                words = text.split()
                for r in found or ():
                    for i in range(r["start"] + r["period"], r["start"] + r["length"]):
                        words[i] = None
                out.append(b" ".join(w for w in words if w is not None) if found else b" ".join(words))
            rest = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in ("doc_id", "runs")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])
    give_back_memory()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, smallest period; by start, then period) and collapsed text of every whole text.

    Words are what ASCII white space separates, numbered from 0. A run has at least 24 words and three periods and cannot
    be extended. The collapsed text has the words that no run holds after its first period, with single spaces. Null and
    empty texts have no runs and collapse to nothing. Null ids and repeated rows stay, each with its runs; other columns
    are ignored; an empty table gives an empty result. Words are compared by 64-bit hashes. The fragments of one period of
    one text meet in one task, sorted, not gathered.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    tiled = staged(rows.mapInArrow(_tiled, _TILED), "tiles")
    # Dealt by place in the table, as equal rows would meet in one task by their columns; a million words a task.
    tiles = tiled.filter("text is null").drop("text").withColumn("spread", F.monotonically_increasing_id())
    tasks = max(1, min(100_000, (tiles.agg(F.sum(F.length("words"))).first()[0] or 0) >> 22))
    fragments = tiles.repartition(tasks, "spread").mapInArrow(_solved, "doc_id long, text_key long, period long, first long, stop long").distinct()
    keys = ["doc_id", "text_key"]
    length = F.col("stop") - F.col("first") + F.col("period")
    long_enough = stitched(fragments, [*keys, "period"]).withColumn("length", length).filter(F.col("length") >= F.greatest(F.lit(SHORTEST), REPEATS * F.col("period")))
    found = long_enough.groupBy(*keys, F.col("first").alias("start"), "length").agg(F.min("period").alias("period"))
    of_text = staged(found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")), "runs")
    met = of_text.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "runs")
    # Only texts with tiles are joined with their runs; the others are done where they are read.
    asked = tiled.filter("text is not null").select("doc_id", "text_key", "text")
    joined = asked.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    done = joined.select("doc_id", "runs", "text").mapInArrow(_collapsed, f"doc_id long, runs {_RUNS}, collapsed string")
    done = done.withColumn("runs", F.coalesce("runs", F.expr(f"cast(array() as {_RUNS})")))
    return done.unionByName(rows.select("doc_id", "text").mapInArrow(_without_tiles, f"doc_id long, runs {_RUNS}, collapsed string"))
