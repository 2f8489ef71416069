"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become pieces of at most `capacity` tokens (only longer documents are cut; a cut document's first piece takes
the remainder, all others are full). A piece is placed where the sum, over residual gaps g, of N(g)^2 becomes smallest,
N(g) being the number of open sequences with g free places; a new sequence is one of the choices. Of equal choices the
one that leaves the smallest gap is taken, and of sequences with equal gaps the one that got its last piece last.

The rule looks at one piece at a time, so Spark deals the pieces by a hash into shards of a bounded number of pieces
and every shard runs the rule on its own. Sequences that a shard leaves with more than `slack` free places are
opened again and their pieces go to the next round, where the far fewer pieces meet in fewer shards. The hash is that of
a row number, so repeated rows and hot keys make no hot task.

Packing in the order of a mix takes stretches of consecutive pieces for shards, in one round, so that no piece leaves
its stretch.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_blocks, give_back_memory, staged, text_blocks
from .mixing import mix_sources

#: A space between two characters that no tokenizer takes for white space: the pre-tokenizer always splits before it.
_BETWEEN = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
#: A text without a match is split before every space: it has no white space beyond single spaces and line feeds.
_ODD = "[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  |\n \n|\n $"
#: The pre-tokenizer also splits between a letter and one of these.
_WORD_END = "([A-Za-zÀ-ÖØ-öø-ÿ])([!-@\\[-`{-~\n])"
#: Chunks remembered by a worker.
_CACHE_LIMIT = 300_000
#: Bytes of text that are split into chunks at once; a longer text goes in parts cut between words.
_BLOCK = 1 << 20


def _byte_length(token: str | None) -> int:
    """Bytes of a byte-level token: each of its characters stands for one byte (special tokens are never looked up)."""
    return len(token or "")


class _Chunks:
    """Ids of chunks, one after another in an array; each distinct chunk is encoded once, up to a bounded number."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.token_bytes = np.array([_byte_length(tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.number), self.used
        while n + len(chunks) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while m + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[m : m + len(ids)] = ids
        self.start[n : n + len(chunks)] = m + np.cumsum(sizes) - sizes
        self.size[n : n + len(chunks)] = sizes
        self.number.update(zip(chunks, range(n, n + len(chunks))))
        self.used += len(ids)

    def _learn(self, chunks: list[str]) -> None:
        joins = lambda c: len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace()
        spaced = [c for c in chunks if joins(c)]
        # Many chunks in one call, one after another as in a text; tokens' and chunks' lengths in bytes tell them apart.
        for i in range(0, len(spaced), 2000):
            part = spaced[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            self._keep(part, ids, np.diff(cut, prepend=0))
        if alone := [c for c in chunks if not joins(c)]:
            coded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            self._keep(alone, np.concatenate(coded), np.array([len(c) for c in coded]))

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and size, in ids, of each chunk."""
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.number]
        if len(self.number) + len(new) > _CACHE_LIMIT:
            self._forget()
            new = distinct
        self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        return self.start[at], self.size[at]


class ChunkEncoder:
    """Token ids of whole texts, those of the `tokenizers` library's plain call.

    A byte-level BPE never merges across the places where its pre-tokenizer splits. Such are the space in front of a word
    and the end of a word before punctuation, so a text's ids are those of its chunks between these places, one after
    another. Arrow splits the texts and finds the distinct chunks; numpy gathers the ids. Control strings of the tokenizer in a text become their own ids, as in the plain call.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.tokenizer)
        control = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.control_ids = {c: np.array([i], np.uint32) for c, i in control.items()}
        self.control = re.compile("(" + "|".join(map(re.escape, control)) + ")") if control else None

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that hold no control string, each by its chunks."""
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring_regex(column.filter(pa.array(~odd)), _WORD_END, "\\1\0\\2"), " ", "\0 ")
        by_hand = [_BETWEEN.split(t) for t, o in zip(texts, odd) if o]
        out: list = [None] * len(texts)
        for rows, lists in ((np.flatnonzero(~odd), pc.split_pattern(marked, "\0")), (np.flatnonzero(odd), pa.array([[c[0], *(" " + x for x in c[1:])] for c in by_hand], pa.list_(pa.string())))):
            if not len(rows):
                continue
            start, size = self.chunks.of(lists.flatten())
            before = np.concatenate([[0], np.cumsum(size)])
            ids = self.chunks.ids[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
            offsets = lists.offsets.to_numpy()
            ends = before[offsets - offsets[0]]
            for row, a, b in zip(rows.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                out[row] = ids[a:b]
        return out

    def _parts(self, text: str) -> list[str]:
        """A very long text in parts, cut between words where the pre-tokenizer always splits."""
        parts, at = [], 0
        while len(text) - at > _BLOCK and (found := _BETWEEN.search(text, at + _BLOCK)):
            parts.append(text[at : found.start()])
            at = found.start()
        return [*parts, text[at:]]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text (unsigned 32-bit), in order."""
        for a, b in byte_blocks(texts, _BLOCK):
            flat: list[str] = []
            layout: list[list[int | np.ndarray]] = []
            for t in texts[a:b]:
                own: list[int | np.ndarray] = []
                for piece in self.control.split(t) if self.control and self.control.search(t) else (t,):
                    if piece in self.control_ids:
                        own.append(self.control_ids[piece])
                        continue
                    for part in self._parts(piece):
                        own.append(len(flat))
                        flat.append(part)
                layout.append(own)
            if b - a == 1 and len(flat) > 1:
                coded = [self._split([x])[0] for x in flat]
            else:
                coded = self._split(flat)
            for own in layout:
                found = [coded[x] if isinstance(x, int) else x for x in own]
                yield found[0] if len(found) == 1 else np.concatenate(found)


_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieced(tokenizer: str, capacity: int, end_id: int):
    """Rows of document_pieces, for about _BLOCK bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        for batch, (a, b, texts) in ((batch, block) for batch in batches for block in text_blocks(batch, _BLOCK)):
            ids, sources = (batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in ("doc_id", "source"))
            ends, out = [0], ([], [], [], [])
            for coded in encoder.encode([t.decode() for t in texts]):
                coded = coded.astype("<u4", copy=False)
                n = len(coded) + 1
                first = (n - 1) % capacity + 1
                for piece, (start, end) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                    crc = zlib.crc32(np.ascontiguousarray(coded[start:end]))
                    for to, x in zip(out, (piece, start, end - start, zlib.crc32(tail, crc) if end == n else crc)):
                        to.append(x)
                ends.append(len(out[0]))
            items = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECE)], fields=list(_PIECE))
            yield pa.RecordBatch.from_arrays([ids, sources, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["doc_id", "source", "pieces"])
        # Workers live on: the next stage's may need the memory.
        del encoder
        give_back_memory()

    return run


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """One row per document: doc_id, source, pieces (an array of piece, start, length, ids_crc32).

    Null text counts as empty (its only token is end_id). Null ids and sources stay null; repeated rows stay. Other columns
    are ignored. An empty table gives an empty result. Without source_col all sources are null.
    """

    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(_pieced(tokenizer, capacity, end_id), "doc_id long, source string, pieces array<struct<piece: int, start: long, length: long, ids_crc32: long>>")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, with the cases of document_pieces."""
    return document_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, None).select("doc_id", F.inline("pieces"))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places pieces in the order given; returns (bin of each piece, its offset there, free places of each bin)."""
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gap_of: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            bins[i], offsets[i] = len(gap_of), 0
            gap_of.append(0)
            continue
        # Choice j leaves the gap j in a bin that had j + s; the change of the sum is 2 (N(j) - N(j + s) + 1).
        change = count[: capacity - s + 1] - count[s:] + 1.0
        change[count[s:] == 0] = np.inf
        change[0] -= 0.5  # a bin that becomes full is closed: it adds no square
        change[-1] = count[capacity - s] + 0.5  # a new bin removes no square
        left = int(change.argmin())
        if left == capacity - s:
            b = len(gap_of)
            gap_of.append(capacity)
        else:
            b = open_bins[left + s].pop()
            count[left + s] -= 1
        bins[i], offsets[i] = b, capacity - (left + s)
        gap_of[b] = left
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets, np.array(gap_of, np.int64)


def _placer(capacity: int, slack: int, round_no: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        # Large pieces first, equal ones by id: the same rows give the same packing, whatever their order was.
        pdf = pdf.sort_values(["length", "no_id", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True, True], kind="stable")
        bins, offsets, gaps = sum_of_squares(pdf["length"].to_numpy(), capacity)
        again = (gaps[bins] > slack) & (slack >= 0)
        return pdf.drop(columns="shard").assign(sequence_id=np.where(again, -1, (round_no * 2**24 + shard) * 2**32 + bins), offset=np.where(again, -1, offsets))

    return place


def pack_pieces(pieces: DataFrame, capacity: int = 1024, shard_pieces: int = 4096, slack: int = 8, rounds: int = 3) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, start, length, ids_crc32 and row, a number of its document's row).

    A sequence's pieces fill it from offset 0 without gaps. Sequence ids are unique, not dense. Every piece is kept; row
    only deals them to shards and is dropped.
    """
    fields = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long"
    n = pieces.count()
    # pandas would turn ids with nulls among them into floating point numbers.
    pieces = pieces.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "piece", "start", "length", "ids_crc32", "row")
    done = None
    for r in range(rounds):
        shards = max(1, -(-n // shard_pieces))
        last = r == rounds - 1 or shards == 1

        key = F.pmod(F.xxhash64("row", "piece", F.lit(r)), F.lit(shards)).cast("int")
        placed = staged(pieces.withColumn("shard", key).groupBy("shard").applyInPandas(_placer(capacity, -1 if last else slack, r), fields), f"packed{r}")
        kept = placed.filter("sequence_id >= 0").select(F.expr("if(no_id, null, doc_id)").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        pieces = placed.filter("sequence_id < 0").drop("sequence_id", "offset")
        n = pieces.count()
        if not n:
            return done
    raise ValueError("rounds must be 1 or more")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = 4096) -> DataFrame:
    """Tokenizes, cuts and packs documents. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text, null ids, repeated rows and other columns as in document_pieces; an empty table gives an empty result.
    """
    cut = document_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, None)
    pieces = staged(cut.select("doc_id", F.monotonically_increasing_id().alias("row"), F.inline("pieces")), "pieces")
    return pack_pieces(pieces, capacity, shard_pieces)


def _stretch_placer(capacity: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        stretch = int(pdf["stretch"].iloc[0])
        pdf = pdf.sort_values(["length", "at"], ascending=[False, True])
        bins, offsets, gaps = sum_of_squares(pdf["length"].to_numpy(), capacity)
        first = np.full(len(gaps), np.iinfo(np.int64).max)
        np.minimum.at(first, bins, pdf["at"].to_numpy())
        return pdf.drop(columns=["stretch", "at"]).assign(sequence_id=stretch * 2**32 + first.argsort().argsort()[bins], offset=offsets)

    return place


def pack_in_order(pieces: DataFrame, capacity: int = 1024, stretch_pieces: int = 4096) -> DataFrame:
    """Packs pieces (columns of token_pieces, and slot and place of their document) in stretches of consecutive ones.

    Adds sequence_id and offset, drops slot and place. A stretch holds stretch_pieces pieces in the order (slot, place,
    piece), the last one what is left. Sequence ids grow with the stretch and, within it, with a sequence's first piece.
    Places are counted in ranges of 1024 slots, whose sizes are then added up.
    """
    ranged = pieces.withColumn("range", F.expr("slot div 1024"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("slot", "place", "piece")) - 1
    at = ranged.withColumn("nth", nth).join(ranges, "range").withColumn("at", F.col("before") + F.col("nth"))
    fields = ["piece", "start", "length", "ids_crc32"]
    # pandas would turn ids with nulls among them into floating point numbers.
    named = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), *fields]
    stretched = at.select(*named, "at", F.expr(f"at div {int(stretch_pieces)}").alias("stretch"))
    packed = stretched.groupBy("stretch").applyInPandas(_stretch_placer(capacity), "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.select(F.expr("if(no_id, null, doc_id)").alias("doc_id"), *fields, "sequence_id", "offset")


def pack_mixed(docs: DataFrame, tokenizer: str, mix: dict, capacity: int = 1024, end_id: int = 2, stretch_pieces: int = 4096) -> DataFrame:
    """Tokenizes and cuts documents, puts them in the order of mix_sources(**mix) and packs that order in stretches.

    Only lengths and checksums are shuffled, no texts. Returns the columns of pack_documents.
    """
    mixed = mix_sources(staged(document_pieces(docs, tokenizer, capacity, end_id), "documents"), keep=True, **mix)
    pieces = mixed.select("slot", "place", F.col("row.doc_id").alias("doc_id"), F.inline("row.pieces"))
    return pack_in_order(staged(pieces, "pieces"), capacity, stretch_pieces)
