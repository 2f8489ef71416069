"""Chat formatting by columnar byte assembly, and its exact reading back.

A batch of turns becomes one preallocated Arrow buffer: numpy computes each segment's length, the cumulative offsets and
the scatter indices, and headers and contents are copied to their places at once. The template is
`<|im_start|>role LF content <|im_end|> LF` per turn. A text's `<` followed by k pipes gets k + 1 pipes, so no text can
hold a control string, and reading takes one pipe away again. A role's backslashes and line feeds are written as
`\\\\` and `\\n`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_PIPES = re.compile(r"<\|(\|+)")
_ROLE = re.compile(r"\\(.)", re.S)
#: Bytes of text that are assembled at once; one longer turn is a block of its own.
_BLOCK = 1 << 21


def unescaped(text: str) -> str:
    return _PIPES.sub(r"<\1", text)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and its offsets in them (rows + 1)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of the turns one after another, where each turn starts (turns + 1), and where its content lies (turns x 2)."""
    role, role_at = _flat(roles)
    text, text_at = _flat(texts)
    n, role_len, text_len = len(roles), np.diff(role_at), np.diff(text_at)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(len(START) + role_len + 1 + text_len + len(END), out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)
    out[at[:-1, None] + np.arange(len(START))] = np.frombuffer(START, np.uint8)
    role_to = at[:-1] + len(START)
    out[np.arange(len(role)) + np.repeat(role_to - role_at[:-1], role_len)] = role
    text_to = role_to + role_len + 1
    out[text_to - 1] = 10
    out[np.arange(len(text)) + np.repeat(text_to - text_at[:-1], text_len)] = text
    out[(text_to + text_len)[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    return out, at, np.stack([text_to, text_to + text_len], 1)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, part = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        loss = pc.equal(batch.column(1), "assistant").to_numpy(zero_copy_only=False)
        roles = pc.replace_substring(pc.replace_substring(batch.column(1), "\\", "\\\\"), "\n", "\\n")
        roles, texts = (pc.replace_substring_regex(c, r"<(\|+)", r"<|\1") for c in (roles, batch.column(2)))
        ids = conv.to_pylist()
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        # Cut where a block is full, and between conversations.
        cut = [0, *(i for i in range(1, len(ids)) if sizes[i] // _BLOCK != sizes[i - 1] // _BLOCK), len(ids)]
        for a, b in zip(cut, cut[1:]):
            data, at, content = assemble(roles.slice(a, b - a), texts.slice(a, b - a))
            first = [a, *(i for i in range(a + 1, b) if ids[i] != ids[i - 1])]
            edge = np.array([*first, b]) - a
            parts, spans = [], []
            for f, s, e in zip(first, edge[:-1], edge[1:]):
                part = part + 1 if before == (ids[f],) else 0
                before = (ids[f],)
                parts.append(part)
                spans.append((content[s:e][loss[a + s : a + e]] - at[s]))
            offsets = at[edge].astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(parts, pa.int32()), text.cast(pa.string()), *(pa.array([x[:, k] for x in spans], pa.list_(pa.int64())) for k in (0, 1))], ["conv_id", "part", "formatted", "loss_begin", "loss_end"])


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formats conversations: conv_id, part, formatted, loss_begin, loss_end (arrays of byte offsets in formatted).

    Turns are ordered by number (null first); ties by role, then text; repeated rows stay. Null role or text: empty. Rows
    without a conv_id form one conversation with a null id. The loss mask covers the contents of assistant turns. A
    conversation of more than 2 MB comes in several parts, numbered from 0, to be read one after another; the parts of
    one conversation are neighbours in one partition. Other columns are ignored. An empty table gives an empty result.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_formatted, "conv_id long, part int, formatted string, loss_begin array<long>, loss_end array<long>")


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: list[int], end: list[int]) -> None:
        at = 0
        for m in _TURN.finditer(formatted):
            if m.start() != at:
                break
            at = m.end()
            role = _ROLE.sub(lambda x: "\n" if x[1] == "n" else x[1], unescaped(m[1]))
            self.text.update(f"{role}\n{unescaped(m[2])}\n".encode())
            self.turns += 1
        if at != len(formatted):
            raise ValueError(f"conversation {self.conv} cannot be read at {at}")
        raw = formatted.encode()
        for b, e in zip(begin, end):
            text = unescaped(raw[b:e].decode())
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
    now: _Digest | None = None
    for batch in batches:
        out = []
        for conv, part, text, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                if now:
                    out.append(now.row())
                now = _Digest(conv)
            now.add(text, begin, end)
        if out:
            yield give(out)
    if now:
        yield give([now.row()])


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Reads the result of format_chat back: n_turns, digests of all turns and of the text under the loss mask, lengths in characters."""
    return formatted.select("conv_id", "part", "formatted", "loss_begin", "loss_end").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
