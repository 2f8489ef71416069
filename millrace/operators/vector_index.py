"""An inverted file over vectors: cells around trained centres, searched cell by cell, with a measured number of probes.

Vectors are kept as they are, by cell; a search compares a query with all vectors of its nearest cells. So a true neighbour
is found if, and only if, its cell is among those probed, and the recall of every number of probes follows from the ranks of
the true neighbours' cells in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import _best, _query_passes, _unit_rows, nearest

_ROWS = 1024


def trained_centres(vectors: DataFrame, item: str, vector: str, cells: int, sample: int = 16_384, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centres of about `cells` groups by cosine: k-means on at most `sample` different vectors of one length.

    The sample is the vectors of lowest hash, of the most frequent length; a bounded number of them goes to the driver, as
    the centres do. Fewer different vectors than cells give fewer centres; none give an empty array.
    """
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("n"))
    sizes = rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes or not sizes[0]["n"]:
        return np.empty((0, 0))
    n, total = sizes[0]
    few = rows.filter(F.col("n") == n).withColumn("h", F.xxhash64("v"))
    likely = few.filter(F.pmod("h", F.lit(1 << 30)) <= min(1.0, 2 * sample / total) * (1 << 30))
    part = likely.dropDuplicates(["h"]).orderBy("h").limit(sample).select("v").toArrow().column("v").to_pylist()
    points = next((x for _, x in _unit_rows(part).values()), np.empty((0, n)))
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:cells]]
    for _ in range(rounds if len(centres) else 0):
        own = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1)
        # An empty cell starts again at a point that its own centre fits worst.
        worst = np.argsort((points * centres[own]).sum(1))
        sums[norm == 0] = points[worst[: int((norm == 0).sum())]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-300)[:, None]
    return centres


def with_cells(rows: DataFrame, vector: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """rows with their nearest `probes` cells in order (cells, array<int>); null for vectors that fit no centre.

    Those are null or zero, hold null or non-finite numbers, or have another length.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    probes = min(probes, len(centres))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        # In slices, and as Arrow lists: all cells of many rows would be a large number of Python objects.
        for batch in (whole.slice(a, _ROWS) for whole in batches for a in range(0, whole.num_rows, _ROWS)):
            at, x = _unit_rows(batch.column(batch.schema.get_field_index(vector)).to_pylist()).get(c.shape[1], (np.empty(0, int), None))
            sizes, order = np.zeros(batch.num_rows, np.int32), np.empty((0, 0), np.int32)
            if len(at):
                sizes[at] = probes
                order = np.argsort(-(x[np.argsort(at)] @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(order.ravel()), mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return rows.mapInArrow(run, ", ".join([*names, "cells array<int>"]))


class VectorIndex:
    """Vectors in Parquet by cell (item, v, cell), their centres and where they lie."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray):
        self.spark, self.path, self.centres = spark, path, centres

    def rows(self) -> DataFrame:
        return self.spark.read.schema("item long, v array<double>, cell int").parquet(f"{self.path}/cells")


def write_index(vectors: DataFrame, item: str, vector: str, path: str, cells: int, rows_per_file: int = 500_000, sample: int = 16_384) -> VectorIndex:
    """Trains centres, files every vector that fits under its cell, and keeps the centres beside them.

    A large cell is spread over several tasks and files, by a hash of the item.
    """
    spark = vectors.sparkSession
    centres = trained_centres(vectors, item, vector, cells, sample)
    rows = vectors.select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v"))
    placed = with_cells(rows, "v", centres).filter("cells is not null").select("item", "v", F.col("cells")[0].alias("cell"))
    spread = placed.repartition("cell", F.pmod(F.xxhash64("item"), F.lit(8)))
    spread.write.option("maxRecordsPerFile", rows_per_file).partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return VectorIndex(spark, path, centres)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow().column("centre").to_pylist()
    return VectorIndex(spark, path, np.array(found) if found else np.empty((0, 0)))


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int, others_only: bool = False) -> DataFrame:
    """The k most similar vectors of each query's nearest `probes` cells: query_id, item, sim (5 places), rank.

    queries: query_id, qvec. Cells that no query probes are not read. Queries go over in parts of at most 64 MB, each with
    its cells; vectors stream by, a task keeps k per query, ranks are settled over those, ties by item. Queries that fit no
    centre get nothing.
    """
    asked = with_cells(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")), "qvec", index.centres, probes).filter("cells is not null")
    found = None
    for part in _query_passes(asked):
        ids = part.column("query_id").to_numpy()
        vectors = part.column("qvec").to_pylist()
        at, x = _unit_rows(vectors).get(index.centres.shape[1], (np.empty(0, int), np.empty((0, 0))))
        by_cell: dict[int, list[int]] = {}
        cells = part.column("cells").to_pylist()
        for row, i in enumerate(at.tolist()):
            for c in cells[i]:
                by_cell.setdefault(c, []).append(row)
        shared = index.spark.sparkContext.broadcast((ids[at], x, {c: np.array(r) for c, r in by_cell.items()}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x, by_cell = shared.value
            kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                items, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for c in np.unique(cell).tolist():
                    here = np.flatnonzero(cell == c)
                    rows = by_cell.get(c)
                    if rows is None:
                        continue
                    values = batch.column(1).take(pa.array(here)).flatten().to_numpy().reshape(len(here), -1)
                    v = values / np.linalg.norm(values, axis=1)[:, None]
                    for a in range(0, len(rows), _ROWS):
                        some = rows[a : a + _ROWS]
                        sim = x[some] @ v.T
                        if others_only:
                            sim[ids[some][:, None] == items[here][None]] = -np.inf
                        least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(sim), -np.inf)
                        row, column = np.nonzero((sim >= least[:, None]) & np.isfinite(sim))
                        block = int(some[0]) // _ROWS
                        new = (some[row], sim[row, column], items[here][column])
                        r, s, i = (np.concatenate(p) for p in zip(kept.get(block, (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))), new))
                        best = _best(r, s, i, k)
                        kept[block] = r[best], s[best], i[best]
            for r, s, i in kept.values():
                yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(i, pa.int64()), pa.array(s)], ["query_id", "item", "sim"])

        # The cells are folders: those that nobody asks for are pruned before anything is read.
        wanted = index.rows().filter(F.col("cell").isin(sorted(by_cell))) if len(by_cell) < len(index.centres) else index.rows()
        own = wanted.select("item", "v", "cell").mapInArrow(run, "query_id long, item long, sim double")
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "item", F.round("sim", 5).alias("sim"), "rank")


def recall_by_probes(index: VectorIndex, exact: DataFrame, queries: DataFrame) -> list[float]:
    """The share of exact neighbours (query_id, item) that 1, 2, ... probes find, over all these queries."""
    cells = len(index.centres)
    order = with_cells(queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")), "qvec", index.centres, cells).select("query_id", "cells")
    # The query's place of the neighbour's cell.
    place = exact.join(order, "query_id").join(index.rows().select("item", "cell"), "item").groupBy(F.array_position("cells", F.col("cell")).alias("p")).agg(F.count("*").alias("n")).collect()
    total = exact.count()
    found = np.zeros(cells + 1)
    for r in place:
        found[int(r["p"])] += r["n"]
    return (np.cumsum(found)[1:] / max(total, 1)).tolist()


def probes_for(recalls: list[float], least: float) -> int:
    """The smallest number of probes with this recall; all cells if none has it."""
    return next((i for i, r in enumerate(recalls, 1) if r >= least), max(len(recalls), 1))


def tuned_search(index: VectorIndex, vectors: DataFrame, item: str, vector: str, queries: DataFrame, k: int, least: float = 0.9, others_only: bool = False) -> DataFrame:
    """search_index with the fewest probes whose recall on these queries, against the exact search, is at least `least`.

    Adds probes, and recall: each query's share of its exact k neighbours that were found.
    """
    exact = nearest(vectors, item, vector, queries, k, others_only).select("query_id", F.col(item).alias("item"))
    probes = probes_for(recall_by_probes(index, exact, queries), least)
    hits = search_index(index, queries, k, probes, others_only)
    met = exact.join(hits.select("query_id", "item", F.lit(1).alias("_met")), ["query_id", "item"], "left").groupBy("query_id").agg(F.round(F.count("_met") / F.count("*"), 6).alias("recall"))
    return hits.join(met, "query_id").withColumn("probes", F.lit(probes)).select("query_id", F.col("item").alias(item), "sim", "rank", "probes", "recall")
