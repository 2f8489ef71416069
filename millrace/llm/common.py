"""Helpers shared by the training-data operators: shared work tables, text hashing, Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence, Sized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own; elsewhere a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millrace-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, carry: Sequence[str], text_col: str) -> tuple[list, list[str]]:
    """The columns of docs that go through an operator's Arrow step beside doc_id and text, and all carried ones' fields.

    A carried text column is the operator's own `text`, so that it is not moved twice.
    """
    names = [c for c in carry if c != "text" or text_col != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return [F.col(c) for c in names], [f"`{c}` {kinds[c]}" for c in carry]


def crc_mod(id_col: str, m: int):
    """crc32 of the id's decimal text, modulo m (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_blocks(batch: pa.RecordBatch, limit: int = 1 << 22, name: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices (from, to) of a batch and their texts in UTF-8, about `limit` bytes at a time; null texts are empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "").cast(pa.binary())
    total = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


def give_back_memory() -> None:
    """Returns freed memory to the system at the end of a task: workers live on, and the next stage may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_blocks(texts: Sequence[Sized], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of texts, known by their lengths, that hold about `limit` bytes each; a longer text is a block of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:
    have = kept.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, (1 << 20) + 4096), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 22:
            kept[int(base)] = have
    return have[:n]


#: Bytes that end a word where punctuation does: all of ASCII but letters and digits.
_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[bytes], punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of the texts, in order; with punctuation, that separates too.

    Returns (hash, index of its text, first byte, end byte) per word; byte places are in b"\\n".join(texts).
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if not len(texts):
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e, e
    space = (_PUNCTUATION if punctuation else _SPACE)[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    total = np.empty(len(joined) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[joined] * _powers(_BASE, len(joined)), out=total[1:])
    h = mix64((total[end] - total[begin]) * _powers(_INVERSE, len(joined))[begin])
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(starts, begin, "right") - 1, begin, end
