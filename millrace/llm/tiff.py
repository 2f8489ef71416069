"""TIFF media: writing byte payloads as pages of 8-bit samples, and decoding files page by page.

The decoder walks the chain of image directories (either byte order), decodes PackBits, LZW or deflate strips and tiles,
undoes horizontal differencing and gives one row per page. The encoder is there to store payloads and for tests.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, PAGE_ROWS = 64, 1024


def packbits_encode(rows: np.ndarray) -> bytes:
    """PackBits of a matrix of samples; each row is packed by itself."""
    height, width = rows.shape
    runs = np.zeros(height, bool)
    if width > 2:
        runs = ((rows[:, 2:] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, :-2])).any(1)
    if not runs.any() and width <= 128:
        return np.concatenate([np.full((height, 1), width - 1, np.uint8), rows], 1).tobytes()
    out = bytearray()
    for row in rows:
        change = np.flatnonzero(np.diff(row)) + 1
        data = row.tobytes()
        starts = [0, *change.tolist(), width]
        literal = 0
        for a, b in zip(starts, starts[1:]):
            if b - a < 3:
                continue
            for i in range(literal, a, 128):
                part = data[i : min(a, i + 128)]
                out += bytes([len(part) - 1]) + part
            for i in range(a, b, 128):
                n = min(128, b - i)
                out += bytes([257 - n if n > 1 else 0, data[i]])
            literal = b
        for i in range(literal, width, 128):
            part = data[i : i + 128]
            out += bytes([len(part) - 1]) + part
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    parts, at, have = [], 0, 0
    while have < size:
        n = data[at]
        if n < 128:
            parts.append(data[at + 1 : at + 2 + n])
            at += n + 2
            have += n + 1
        elif n > 128:
            parts.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
            have += 257 - n
        else:
            at += 1
    return b"".join(parts)[:size]


def _code_width(n: int) -> int:
    """Bits of the next code once the table has n entries."""
    return 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12


def lzw_encode(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    codes, widths = [256], [9]
    table: dict[int, int] = {}
    free, width = 258, 9
    now = data[0] if data else None
    for b in data[1:]:
        key = now << 8 | b
        known = table.get(key)
        if known is not None:
            now = known
            continue
        codes.append(now)
        widths.append(width)
        table[key] = free
        free += 1
        if free == 4094:
            codes.append(256)
            widths.append(12)
            table.clear()
            free, width = 258, 9
        elif not free & (free - 1):
            width = _code_width(free)
        now = b
    if now is not None:
        codes.append(now)
        widths.append(width)
        width = _code_width(free + 1)
    codes.append(257)
    widths.append(width)
    code, wide = np.array(codes, np.int64), np.array(widths, np.int64)
    first = np.cumsum(wide) - wide
    shifted = code << (24 - wide - (first & 7))  # a code lies in three bytes at most
    total = int(first[-1] + wide[-1] + 7) // 8
    out = np.zeros(total + 3)
    for k in range(3):
        out[: total + 2] += np.bincount((first >> 3) + k, (shifted >> (16 - 8 * k)) & 255, total + 2)
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(base)
    out, have, at, bits, held = [], 0, 0, 0, 0
    last = None
    width = 9
    while have < size:
        while bits < width:
            if at >= len(data):
                raise ValueError("LZW data ends early")
            held = (held << 8 | data[at]) & 0xFFFFFFFF
            at += 1
            bits += 8
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            table, last, width = list(base), None, 9
            continue
        if code == 257:
            break
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        have += len(entry)
        last = entry
        width = _code_width(len(table) + 1)
    return b"".join(out)[:size]


def _packed(rows: np.ndarray, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(rows)
    data = rows.tobytes()
    return lzw_encode(data) if compression == LZW else zlib.compress(data, 1) if compression in (DEFLATE, OLD_DEFLATE) else data


def encode_tiff(payload: bytes, compression: int, predictor: int, tiled: bool) -> bytes:
    """A little-endian TIFF with the payload's bytes (a positive multiple of 64) as rows of 64 samples, 1024 rows a page."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    pages = -(-len(image) // PAGE_ROWS)
    for page in range(pages):
        rows = image[page * PAGE_ROWS : (page + 1) * PAGE_ROWS]
        height, step = len(rows), 64 if tiled else 256
        spots, sizes = [], []
        for i in range(0, height, step):
            part = rows[i : i + step]
            if tiled and len(part) < step:
                part = np.concatenate([part, np.zeros((step - len(part), WIDTH), np.uint8)])
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1)
            packed = _packed(part, compression)
            spots.append(len(out))
            sizes.append(len(packed))
            out += packed
        out += b"\0" * (len(out) & 1)
        lists = len(out)
        if len(spots) > 1:
            out += struct.pack(f"<{2 * len(spots)}I", *spots, *sizes)
        many = len(spots) > 1
        place, length = (lists, lists + 4 * len(spots)) if many else (spots[0], sizes[0])
        tags = [(256, 4, 1, WIDTH), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (297, 3, 2, min(page, 65535) | min(pages, 65535) << 16), (317, 3, 1, predictor)]
        tags += [(322, 4, 1, WIDTH), (323, 4, 1, step), (324, 4, len(spots), place), (325, 4, len(spots), length)] if tiled else [(273, 4, len(spots), place), (278, 4, 1, step), (279, 4, len(spots), length)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag in sorted(tags):
            out += struct.pack("<HHII", *tag)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_TYPE = {1: "B", 3: "H", 4: "I"}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """Integer fields of the image directory at a place, and the next directory's place."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in _TYPE:
            form = f"{order}{count}{_TYPE[kind]}"
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            fields[tag] = struct.unpack_from(form, data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_tiff(data: bytes) -> Iterator[tuple[dict[str, int], bytes]]:
    """Pages of a TIFF: width, height, samples, compression, predictor; and the samples' bytes, row by row."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a ring")
        seen.add(at)
        f, at = _directory(data, at, order)
        one = lambda tag, usual, f=f: f.get(tag, (usual,))[0]
        width, height, samples, compression, predictor = one(256, 0), one(257, 0), one(277, 1), one(259, NONE), one(317, 1)
        if set(f.get(258, (1,))) != {8} or one(284, 1) != 1:
            raise ValueError("only interleaved 8-bit samples are supported")
        tiled = 322 in f
        wide, high = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
        page = np.empty((height, width, samples), np.uint8)
        across = -(-width // wide)
        for i, (start, size) in enumerate(zip(f[324 if tiled else 273], f[325 if tiled else 279])):
            y, x = i // across * high, i % across * wide
            rows = high if tiled else min(high, height - y)
            raw, want = data[start : start + size], rows * wide * samples
            if compression == PACKBITS:
                raw = packbits_decode(raw, want)
            elif compression == LZW:
                raw = lzw_decode(raw, want)
            elif compression in (DEFLATE, OLD_DEFLATE):
                raw = zlib.decompress(raw)
            elif compression != NONE:
                raise ValueError(f"compression {compression} is not supported")
            if len(raw) < want:
                raise ValueError("a strip or tile is short")
            part = np.frombuffer(raw, np.uint8, want).reshape(rows, wide, samples)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            elif predictor != 1:
                raise ValueError(f"predictor {predictor} is not supported")
            page[y : y + rows, x : x + wide] = part[: height - y, : width - x]
        yield {"width": width, "height": height, "samples_per_pixel": samples, "compression": compression, "predictor": predictor}, page.tobytes()


#: Compressions and their shares in 64: each comes with and without differencing, in strips and in tiles.
_SHARES = ((LZW, 8), (PACKBITS, 16), (DEFLATE, 40))


def _form(payload: bytes) -> tuple[int, int, bool]:
    """Compression, predictor and layout by the payload's checksum, so that equal payloads are stored alike and a corpus uses all of them."""
    n = zlib.crc32(payload)
    place = n % 64
    for compression, share in _SHARES:
        if place < share:
            break
        place -= share
    return compression, 1 + n // 64 % 2, n // 128 % 2 == 1


def tiff_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a TIFF: doc_id, n_bytes, media.

    Null text counts as empty; null ids and repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = rows_of(batch, "doc_id"), rows_of(batch, "text")
            for at in range(0, len(ids), 512):
                raw = [(t or "").encode() for t in texts[at : at + 512]]
                media = []
                for t in raw:
                    payload = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
                    media.append(encode_tiff(payload, *_form(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 512], pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_PAGE = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples_per_pixel": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "samples": pa.binary()}


def tiff_pages(files: DataFrame) -> DataFrame:
    """One row per page of the files in `media` (columns doc_id, n_bytes, media), in order: size, form and decoded samples.

    The pages of a file are neighbours, counted from 0. Null media gives no rows; a broken file is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                doc, n, media = (batch.column(k)[i].as_py() for k in range(3))
                if media is None:
                    continue
                digest = hashlib.sha256(media).hexdigest()
                for page, (about, samples) in enumerate(decode_tiff(media)):
                    out.append((doc, n, len(media), digest, page, *about.values(), samples))
                    size += len(samples)
                    if size > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PAGE.values())], list(_PAGE))
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PAGE.values())], list(_PAGE))

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, width int, height int, samples_per_pixel int, compression int, predictor int, samples binary")


class _File:
    def __init__(self, doc: int | None, n: int, size: int, digest: str):
        self.head = (doc, n, size, digest)
        self.bytes, self.sha, self.tail, self.histogram = 0, hashlib.sha256(), b"", np.zeros(256, np.int64)

    def add(self, samples: bytes) -> None:
        self.bytes += len(samples)
        self.sha.update(samples)
        self.tail = (self.tail + samples)[-64:]
        self.histogram += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)

    def row(self) -> tuple:
        doc, n, size, digest = self.head
        h, value = self.histogram, np.arange(256)
        feature = f"sum={int((h * value).sum())};squares={int((h * value * value).sum())};distinct={int((h > 0).sum())};mode={int(h.argmax())}"
        return doc, n, self.bytes, self.sha.hexdigest(), zlib.crc32(self.tail), size, digest, feature


def page_digests(pages: DataFrame) -> DataFrame:
    """Puts the pages of each file (as tiff_pages gives them) together again: lengths, digests and sample statistics."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
        now: _File | None = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc, n, size, digest, page, samples = (batch.column(k)[i].as_py() for k in range(6))
                if page == 0:
                    if now:
                        out.append(now.row())
                    now = _File(doc, n, size, digest)
                now.add(samples)
            if out:
                yield give(out)
        if now:
            yield give([now.row()])

    return pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "samples").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
