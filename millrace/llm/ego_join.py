"""Epsilon grid order join of embeddings: all pairs of vectors within a cosine threshold.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2 c). The vectors are turned to their principal axes (which
changes no distance), cut into grid cells of width eps on the leading axes and sorted by cell. Blocks of consecutive
vectors, and intervals of 16, 256, ... blocks, have bounding boxes. The join goes down from the pair of the whole
sequence with itself: a pair of intervals whose boxes are more than eps apart is skipped, others are split, first over blocks
in Spark, then over the intervals within a pair of blocks in its task. Boxes span the leading axes and the length of what
the other axes hold, whose difference is a distance too. In the last intervals the leading half of the axes and the
lengths of the rest bound each pair's cosine from above; pairs that may reach the threshold are compared exactly, by their
original components in double precision.

Equal vectors take part once, with their number. Vectors of different lengths link with nothing of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, staged
from .components import connected_components

_FAN = 16
#: Vectors of the last intervals.
_LEAF = 512
#: Blocks that a length is cut into, if they are neither larger than allowed nor smaller than _SMALLEST.
_BLOCKS, _SMALLEST = 8, 64
#: Lengths whose principal axes are fitted.
_FITTED = 8


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, digest of the vector (null if it can link with nothing), its 64-bit components, their number."""
    for batch in batches:
        ids, vectors = rows_of(batch, "vec_id"), rows_of(batch, "embedding")
        digests, raws, dims = [], [], []
        for i, v in zip(ids, vectors):
            x = None if i is None or not v or None in v else np.array(v, np.float64) + 0.0
            fit = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
            raw = x.tobytes() if fit else None
            digests.append(hashlib.blake2b(raw, digest_size=16).digest() if fit else None)
            raws.append(raw)
            dims.append(len(x) if fit else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "digest", "raw", "dim"])


def _unit(raws: list[bytes], dim: int, kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(raws), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes_of(axes: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return axes.get(dim, np.eye(dim))


def _celled(axes: dict[int, np.ndarray], eps: float, cells: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, dims = rows_of(batch, "raw"), batch.column(batch.schema.get_field_index("dim")).to_numpy()
            cell: list = [None] * len(raws)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim).tolist()
                turned = _unit([raws[i] for i in at], dim) @ _axes_of(axes, dim)
                for i, c in zip(at, np.floor(turned[:, :cells] / eps).astype(np.int32)):
                    cell[i] = c
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("dim", "rep", "n")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cell, pa.list_(pa.int32())), pa.array([np.frombuffer(r, np.float64).astype(kind).tobytes() for r in raws], pa.binary())], ["dim", "rep", "n", "cell", "raw"])

    return run


def _folded(turned: np.ndarray, lead: int) -> np.ndarray:
    """The leading coordinates, then the length of what the others hold; products of such rows bound those of whole vectors."""
    rest = turned[:, lead:]
    return np.concatenate([turned[:, :lead], np.sqrt((rest * rest).sum(1, keepdims=True))], 1)


def _blocked(axes: dict[int, np.ndarray], cells: int, kind: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        dim = int(pdf["dim"].iloc[0])
        m = _folded(_unit(pdf["raw"].tolist(), dim, kind) @ _axes_of(axes, dim), cells)
        # Vectors of another length are out of reach by the first coordinate; all boxes have as many.
        m = np.concatenate([np.full((len(m), 1), 1000.0 * dim), m, np.zeros((len(m), cells + 1 - m.shape[1]))], 1)
        return pd.DataFrame({"block": [key[0]], "dim": [dim], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "counts": [pdf["n"].to_numpy(np.int64).tobytes()], "vectors": [b"".join(pdf["raw"])], "lo": [m.min(0)], "hi": [m.max(0)]})

    return run


def _leaf_pairs(a: np.ndarray, b: np.ndarray, same: bool, eps: float, leaf: int) -> Iterator[tuple[int, int]]:
    """Numbers of the pairs of last intervals that are not provably apart; a and b hold the coordinates of boxes.

    Intervals are halved until they are last ones; a pair of intervals whose boxes are too far apart is left out whole.
    """
    boxes = [(np.minimum.reduceat(x, at := np.arange(0, len(x), leaf)), np.maximum.reduceat(x, at)) for x in (a, b)]

    def down(i: int, i_end: int, j: int, j_end: int) -> Iterator[tuple[int, int]]:
        if same and j_end <= i:
            return
        (lo_a, hi_a), (lo_b, hi_b) = boxes
        gap = np.maximum(0, np.maximum(lo_a[i:i_end].min(0) - hi_b[j:j_end].max(0), lo_b[j:j_end].min(0) - hi_a[i:i_end].max(0)))
        if gap @ gap > (eps * (1 + 1e-9)) ** 2:
            return
        if i_end - i == j_end - j == 1:
            if not same or i <= j:
                yield i, j
        elif i_end - i >= j_end - j:
            half = (i + i_end) // 2
            yield from down(i, half, j, j_end)
            yield from down(half, i_end, j, j_end)
        else:
            half = (j + j_end) // 2
            yield from down(i, i_end, j, half)
            yield from down(i, i_end, half, j_end)

    return down(0, len(boxes[0][0]), 0, len(boxes[1][0]))


def _stars(linked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Components of a bipartite link matrix without empty rows: (rows, columns) of each."""
    left, found = np.ones(len(linked), bool), []
    while left.any():
        rows = np.zeros(len(linked), bool)
        rows[int(left.argmax())] = True
        columns = linked[rows].any(0)
        while True:
            more = linked[:, columns].any(1)
            if (more == rows).all():
                break
            rows = more
            columns = linked[rows].any(0)
        found.append((np.flatnonzero(rows), np.flatnonzero(columns)))
        left &= ~rows
    return found


def _linked(x: np.ndarray, y: np.ndarray, folded_x: np.ndarray, folded_y: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors of x and y have a cosine of at least the threshold."""
    near = folded_x @ folded_y.T >= cosine - 1e-9
    r, c = np.nonzero(near)
    for i in range(0, len(r), 1 << 16):
        part = slice(i, i + (1 << 16))
        near[r[part], c[part]] = np.einsum("ij,ij->i", x[r[part]], y[c[part]]) >= cosine
    return near


def _compared(axes: dict[int, np.ndarray], cells: int, kind: str, cosine: float, eps: float, leaf: int):
    def matrix(row) -> tuple[np.ndarray, ...]:
        unit = _unit([row.vectors], row.dim, kind)
        turned = unit @ _axes_of(axes, row.dim)
        return np.frombuffer(row.ids, np.int64), np.frombuffer(row.counts, np.int64), unit, _folded(turned, -(-row.dim // 2)), _folded(turned, cells)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [matrix(r) for r in pdf.sort_values("side").itertuples()]
        same = len(sides) == 1
        (ia, na, a, fa, box_a), (ib, nb, b, fb, box_b) = sides[0], sides[-1]
        counts_a, counts_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in _leaf_pairs(box_a, box_b, same, eps, leaf):
            x, y = slice(i * leaf, (i + 1) * leaf), slice(j * leaf, (j + 1) * leaf)
            near = _linked(a[x], b[y], fa[x], fb[y], cosine)
            if same and i == j:
                near &= ~np.eye(len(near), dtype=bool)
            if not near.any():
                continue
            counts_a[x] += near @ nb[y]
            if not (same and i == j):
                counts_b[y] += na[x] @ near
            row = np.flatnonzero(near.any(1))
            for r, c in _stars(near[row]):
                nodes = np.concatenate([ia[x][row[r]], ib[y][c]])
                links.append((nodes, np.full(len(nodes), nodes.min())))
        out = []
        for ids, n in ((ia, counts_a), (ib, counts_b)):
            if n.any():
                out.append(pd.DataFrame({"kind": 0, "a": ids[n > 0], "b": n[n > 0]}))
        if links:
            out.append(pd.DataFrame({"kind": 1, "a": np.concatenate([x for x, _ in links]), "b": np.concatenate([y for _, y in links])}).query("a != b"))
        return pd.concat(out) if out else pd.DataFrame({"kind": pd.Series(dtype="int32"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    return run


def _close_pairs(boxes: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """Pairs (a <= b) of blocks whose boxes are at most eps apart, found from the top of the interval tree down."""
    least = lambda x, y: F.zip_with(x, y, lambda p, q: F.least(p, q))
    most = lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(p, q))
    levels = [boxes.select(F.col("block").alias("node"), "lo", "hi")]
    while n_blocks > 1:
        n_blocks = -(-n_blocks // _FAN)
        up = levels[-1].groupBy(F.floor(F.col("node") / _FAN).alias("node")).agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
        levels.append(staged(up.select("node", F.aggregate("los", F.col("los")[0], least).alias("lo"), F.aggregate("his", F.col("his")[0], most).alias("hi")), "intervals"))
    spark = boxes.sparkSession
    pairs = spark.sql("select 0L as a, 0L as b")
    for level in reversed(levels[:-1]):
        child = lambda x: F.explode(F.sequence(F.col(x) * _FAN, F.col(x) * _FAN + _FAN - 1))
        down = pairs.select(child("a").alias("a"), "b").select("a", child("b").alias("b")).filter("a <= b")
        met = down.join(level.select(F.col("node").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a")), "a").join(level.select(F.col("node").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")), "b")
        gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        square = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
        pairs = met.filter(square <= (eps * (1 + 1e-9)) ** 2).select("a", "b")
    return pairs


def _fitted_axes(classes: DataFrame, lengths: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Principal axes of the most frequent lengths, each on about `sample` vectors; other lengths keep their own axes."""
    axes = {}
    for r in lengths.orderBy(F.desc("count"), "dim").limit(_FITTED).collect():
        rate = min(1.0, sample / r["count"])
        few = classes.filter((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)).select("raw").toArrow()
        if few.num_rows > 1:
            x = _unit(few.column("raw").to_pylist(), r["dim"])
            axes[r["dim"]] = np.linalg.eigh(np.cov(x, rowvar=False, bias=True).reshape(r["dim"], r["dim"]))[1][:, ::-1].copy()
    return axes


def grid_blocks(classes: DataFrame, lengths: DataFrame, axes: dict[int, np.ndarray], kind: str, eps: float, block_vectors: int, cells: int) -> DataFrame:
    """The sequence of all vectors by length and grid cell, in blocks of one length each: block (from 0), dim, ids, counts, vectors, and its box."""
    celled = classes.select("dim", "rep", "n", "raw").mapInArrow(_celled(axes, eps, cells, kind), "dim int, rep long, n long, cell array<int>, raw binary")
    # Ranks in the grid order: place in a range of the sorted sequence plus the sizes of the ranges before.
    order = ["dim", "cell", "rep"]
    total = lengths.agg(F.sum("count")).first()[0] or 0
    ordered = celled.repartitionByRange(max(1, -(-total // 20_000)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ordered = staged(ordered, "ordered")
    before = lambda c, by: F.coalesce(F.sum(c).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size")).select("part", before("size", "part").alias("before"))
    width = F.greatest(F.lit(min(_SMALLEST, block_vectors)), F.least(F.lit(block_vectors), F.ceil(F.col("count") / _BLOCKS)))
    spans = lengths.withColumn("width", width).withColumn("blocks", F.ceil(F.col("count") / F.col("width")))
    spans = staged(spans.select("dim", "width", before("count", "dim").alias("first"), before("blocks", "dim").alias("first_block")), "spans")
    ranked = ordered.join(sizes, "part").withColumn("rank", F.col("before") + F.col("at")).join(spans, "dim")
    block = F.col("first_block") + F.floor((F.col("rank") - F.col("first")) / F.col("width"))
    rows = ranked.select(block.alias("block"), "dim", "rank", "rep", "n", "raw")
    return staged(rows.groupBy("block").applyInPandas(_blocked(axes, cells, kind), "block long, dim int, ids binary, counts binary, vectors binary, lo array<double>, hi array<double>"), "blocks")


def _joined(blocks: DataFrame, axes: dict[int, np.ndarray], kind: str, cosine: float, leaf: int, cells: int) -> DataFrame:
    """Links (kind 1: a, b) and numbers of linked vectors (kind 0: a, b) among the vectors of all blocks."""
    eps = float(np.sqrt(2 - 2 * cosine))
    pairs = staged(_close_pairs(blocks.select("block", "lo", "hi"), blocks.count(), eps), "block-pairs")
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(pairs.filter("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("block")))
    tiles = sides.join(blocks.select("block", "dim", "ids", "counts", "vectors"), "block").select("a", "b", "side", "dim", "ids", "counts", "vectors")
    return staged(tiles.groupBy("a", "b").applyInPandas(_compared(axes, cells, kind, cosine, eps, leaf), "kind int, a long, b long"), "found")


def ego_join_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block_vectors: int = 16_384, leaf: int = _LEAF, cells: int = 8, axes_sample: int = 20_000) -> DataFrame:
    """Links of cosine >= `cosine` and their components: vec_id, n_links, component_id, kept.

    One row per input row. n_links counts the other rows linked directly (equal vectors are linked), component_id is the
    smallest id reachable, kept says whether it is the row's own. Vectors link with those of their own length only. Null,
    empty and zero vectors, those with null or non-finite components, and rows without an id link with nothing (component_id
    is then the own id; kept is null for a null id). Other columns are ignored. An empty table gives an empty result.

    The principal axes are fitted on about `axes_sample` vectors for each of the eight most frequent lengths; they decide how
    much is skipped, never what is found. All lengths are one sequence, and tables of every size go the same way: a length
    is cut into eight blocks, or more if these would hold more than block_vectors.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"  # what is moved around keeps the input's precision
    rows = staged(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).mapInArrow(_parsed, "vec_id long, digest binary, raw binary, dim int"), "vectors")
    classes = staged(rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("dim").alias("dim")), "classes")
    lengths = staged(classes.groupBy("dim").count(), "lengths")
    axes = _fitted_axes(classes, lengths, axes_sample)
    blocks = grid_blocks(classes, lengths, axes, kind, float(np.sqrt(2 - 2 * cosine)), block_vectors, cells)
    found = _joined(blocks, axes, kind, cosine, leaf, cells)

    roots = connected_components(found.filter("kind = 1").select("a", "b"))
    linked = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    known = classes.select("digest", "rep", "n").join(linked, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = known.select("digest", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("component"))
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"))
