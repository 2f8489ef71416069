"""Byte-level BPE: encoding by a hierarchical-bitmap queue of merge ranks, and decoding.

A text is cut into pre-tokens by a pattern. A pre-token that is no token itself is merged: its parts are a linked list, and
each pair of neighbours that makes a token waits in the bucket of that token's rank. A bitmap of the buckets in use, with
bitmaps of its words above it, gives the lowest rank by find-first-set; within a bucket the leftmost pair is next. Pairs
whose parts have merged meanwhile stay in their buckets and are skipped when met. Pre-tokens do not touch one another, so
all new ones of a block go through one queue, and a bucket's pairs are merged from left to right until a lower rank comes
up. A pre-token of n bytes takes n steps of a fixed cost each, besides sorting within buckets.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, text_blocks

#: Bits of a bitmap's word: 2 to the power of _SHIFT; the highest bitmap is one number of as many bits as there are words.
_SHIFT = 8
_BIT = [1 << k for k in range(1 << _SHIFT)]
#: White space between pre-tokens: Python's own class has four control characters more than Unicode's property.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Distinct stretches of text, and pre-tokens, that a task remembers before a new generation begins.
_REMEMBERED = 1 << 18
#: Stretches whose new pre-tokens share a queue.
_AT_ONCE = 1 << 15
_BORDER = -2


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class BytePairs:
    """An encoder of one vocabulary; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        # A bit for each bucket in use; merged() has a bitmap of the words that are not 0 above it.
        self.low = [0] * ((max(ranks.values(), default=0) >> _SHIFT) + 1)
        # Ids of stretches and of pre-tokens, in two generations: a full one becomes the old one, what is in use moves up.
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.old_pieces: dict[bytes, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, one queue for all of them: their parts are one list with borders that no pair goes over."""
        get, low, bits, mask = self.ranks.get, self.low, _BIT, (1 << _SHIFT) - 1
        data = b"\0" + b"\0".join(pieces) + b"\0"
        borders = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        # after[i] and before[i]: where the parts next to the one at i begin; tokens[i]: its id, or the border's mark.
        tokens = [self.single[b] for b in data]
        for i in borders.tolist():
            tokens[i] = _BORDER
        if -1 in tokens:
            raise ValueError("the vocabulary lacks a byte")
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        letters = np.frombuffer(data, np.uint8).astype(np.int64)
        first = self.double[letters[:-1] << 8 | letters[1:]]
        first[borders[:-1]] = first[borders[1:] - 1] = -1
        waits = [*first.tolist(), -1]  # the rank under which the pair at i waits; another one met in the queue is stale
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        cuts = np.flatnonzero(np.diff(first[order], prepend=-1))
        places, top = order.tolist(), 0
        buckets: dict[int, list[int]] = {}
        for rank, a, b in zip(first[order[cuts]].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(places)]):
            buckets[rank] = places[a:b]
            low[rank >> _SHIFT] |= bits[rank & mask]
            top |= 1 << (rank >> _SHIFT)
        while top:
            # Find-first-set, twice.
            w = (top & -top).bit_length() - 1
            word = low[w]
            rank = (w << _SHIFT) + (word & -word).bit_length() - 1
            low[w] = word = word & (word - 1)
            if not word:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            for n, i in enumerate(bucket):
                if waits[i] != rank:
                    continue
                j = after[i]
                after[i] = k = after[j]
                before[k] = i
                tokens[i] = rank
                waits[j] = waits[i] = -1
                left = before[i]
                new = [(i, data[i : after[k]])] if tokens[k] != _BORDER else []
                if tokens[left] != _BORDER:
                    waits[left] = -1
                    new.append((left, data[left:k]))
                least = rank
                for at, pair in new:
                    found = get(pair)
                    if found is None:
                        continue
                    waits[at] = found
                    if found in buckets:
                        buckets[found].append(at)
                    else:
                        buckets[found] = [at]
                        w = found >> _SHIFT
                        word = low[w]
                        low[w] = word | bits[found & mask]
                        if not word:
                            top |= 1 << w
                    if found < least:
                        least = found
                if least < rank and n + 1 < len(bucket):
                    # A lower rank has come up: the rest of this bucket waits.
                    buckets[rank] = bucket[n + 1 :]
                    low[rank >> _SHIFT] |= bits[rank & mask]
                    top |= 1 << (rank >> _SHIFT)
                    break
        out, ids, i = [], [], 1
        while i < len(data):
            if tokens[i] == _BORDER:
                out.append(ids)
                ids = []
            else:
                ids.append(tokens[i])
            i = after[i]
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Ids of stretches that are not known."""
        get, pieces, old = self.ranks.get, self.pieces, self.old_pieces
        cut = [[p.encode() for p in self.pattern.findall(c)] for c in chunks]
        new = []
        for p in {p for ps in cut for p in ps}.difference(pieces):
            found = old.get(p)
            if found is None:
                whole = get(p)
                if whole is None:
                    new.append(p)
                    continue
                found = array("i", (whole,)).tobytes()
            pieces[p] = found
        for p, ids in zip(new, self.merged(new) if new else ()):
            pieces[p] = array("i", ids).tobytes()
        for c, ps in zip(chunks, cut):
            self.chunks[c] = b"".join([pieces[p] for p in ps])
        if len(pieces) > _REMEMBERED:
            self.pieces, self.old_pieces = {}, pieces

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts."""
        if len(self.chunks) > _REMEMBERED:
            self.chunks, self.old_chunks = {}, self.chunks
        # White space after other characters always starts a pre-token.
        parts = [_CHUNK.findall(t) for t in texts]
        chunks, missing = self.chunks, []
        for c in set().union(*parts).difference(chunks):
            found = self.old_chunks.get(c)
            if found is None:
                missing.append(c)
            else:
                chunks[c] = found
        for a in range(0, len(missing), _AT_ONCE):
            self._learn(missing[a : a + _AT_ONCE])
        return [np.frombuffer(b"".join(map(chunks.__getitem__, p)), np.int32) for p in parts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in order of rank, and where each begins (one more for the end); unused ranks are empty."""
    size = max(ranks.values(), default=-1) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def decoded_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids one after another, and where each id's begin (one more for the end)."""
    data, begin = table
    length = (begin[1:] - begin[:-1])[ids]
    out = np.concatenate([[0], np.cumsum(length)])
    return data[np.arange(out[-1]) + np.repeat(begin[ids] - out[:-1], length)], out


def _encoded(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs(read_ranks(ranks_path), pattern)
        for batch in batches:
            for a, b, texts in text_blocks(batch):
                found = coder.encode_all([t.decode() for t in texts])
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])
        give_back_memory()

    return run


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, as by the vocabulary's usual encoder without special tokens.

    Each match of the pattern is encoded by itself; bytes between matches, which a pattern for all text does not leave,
    would be dropped. Null and empty texts: no ids. Control strings are text like other. A long text is one row, whatever
    its length below 2^31 tokens. Null ids and repeated rows stay; other columns are ignored; an empty table gives an
    empty result. The file of ranks is read in each task and must be at the same path on all executors.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(ranks_path, pattern), "doc_id long, ids array<int>")


def _decoded(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(read_ranks(ranks_path))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            offsets = column.offsets.to_numpy()
            a = 0
            while a < len(column):  # about a million ids at a time
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), "right")) - 1)
                data, begin = decoded_bytes(column.values.to_numpy()[offsets[a] : offsets[b]], table)
                at = begin[offsets[a : b + 1] - offsets[a]].astype(np.int64)
                texts = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, texts], [*batch.schema.names, "decoded"])
                a = b
        give_back_memory()

    return run


def decode_ids(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded` (binary), the bytes of the column ids; null ids of tokens are not expected, an empty list is empty."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decoded(ranks_path), f"{fields}, decoded binary")
