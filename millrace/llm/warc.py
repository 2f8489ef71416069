"""WARC archives: writing with de-duplication and segmentation, and reassembly on reading.

Spark writes the archives: one row is one WARC record, and the text sink puts the CR LF that ends a record after each
(gzip over the whole file). A block longer than `segment_bytes` is cut into a first record and continuation records.
Reading takes whole files of bounded size (`records_per_file`), groups the records by their origin's identifier, orders
them by segment number, checks that numbers and total length are complete, and decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, staged, work_dir

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are dropped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(parts)
        at = end + 2
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(body[at : at + n])
        at += n + 2


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n"


def _records(page: int | None, url: str | None, payload: bytes, target: int | None, chunk_bytes: int, segment_bytes: int) -> Iterator[bytes]:
    own = f"<urn:uuid:{uuid.uuid4()}>"
    about = {"WARC-Record-ID": own, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Page-ID": page, "WARC-Payload-Digest": "sha1:" + sha1_base32(payload)}
    kind = {"Content-Type": "application/http;msgtype=response"}
    if target is not None:
        yield _record({"WARC-Type": "revisit", **about, "WARC-Profile": _PROFILE, "WARC-Refers-To-Page-ID": target, "WARC-Payload-Length": len(payload), **kind}, b"HTTP/1.1 304 Not Modified\r\n\r\n")
        return
    block = _HTTP + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record({"WARC-Type": "response", **about, **kind}, block)
        return
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[at : at + segment_bytes]
        if n == 1:
            yield _record({"WARC-Type": "response", **about, **kind, "WARC-Segment-Number": 1}, part)
        else:
            last = len(block) if at + segment_bytes >= len(block) else None
            yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": about["WARC-Date"], "WARC-Segment-Number": n, "WARC-Segment-Origin-ID": own, "WARC-Segment-Total-Length": last}, part)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, chunk_bytes: int = 4096, segment_bytes: int = 16384, records_per_file: int = 1000) -> None:
    """Write one record per row (continuations aside). Null html: an empty payload; null url: an empty target.

    Of rows with equal payloads of min_bytes bytes or more, that with the largest id is a response and the others are
    revisits of it; shorter payloads and rows with a null id are responses. Rows that repeat the largest id are
    responses too. Other columns are ignored. An empty table gives archives without records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    # Most payloads are alone: only the digests of several rows take part in the join.
    shared = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page").alias("target"), F.count("page").alias("n")).filter("n > 1").select("digest", "target")
    marked = rows.join(shared, "digest", "left").select("page", "url", "payload", F.expr("if(page < target, target, null)").alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            out, size = [], 0
            for i in range(batch.num_rows):
                page, url, payload, target = (c[i].as_py() for c in columns)
                for r in _records(page, url, payload, target, chunk_bytes, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # The sink copies the bytes of the string as they are, so a cut inside a character is kept.
    marked.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records (lower-case header fields, block) of an archive's bytes."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data, data.index(b"\r\n", at) + 2, end + 2)}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, block
        at = end + 8 + n


_SEGMENT = "origin string, segment int, total long, type string, page long, refers_to long, url string, digest string, full_bytes long, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in _SEGMENT.split(",")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(0)[i].as_py()
            data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
            out: list[tuple] = []
            for f, block in parse_warc(data):
                out.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f["warc-type"], number(f.get("warc-page-id")), number(f.get("warc-refers-to-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:"), number(f.get("warc-payload-length")), block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)


def _assembled(with_payload: bool):
    def record(parts: list[tuple]) -> tuple:
        head = parts[0]
        if head[3] == "revisit":
            return head[4], head[6], head[8], head[7], "revisit", head[5], None
        if len(parts) > 1 or head[1] is not None:
            numbers, block = [p[1] for p in parts], b"".join(p[9] for p in parts)
            if numbers != list(range(1, len(parts) + 1)) or parts[-1][2] != len(block):
                raise ValueError(f"segments of {head[0]} are missing: {numbers}, {len(block)} of {parts[-1][2]} bytes")
        else:
            block = head[9]
        head_end = block.index(b"\r\n\r\n") + 4
        body = block[head_end:]
        payload = dechunked(body) if b"transfer-encoding: chunked" in block[:head_end].lower() else body
        if (digest := sha1_base32(payload)) != head[7]:
            raise ValueError(f"the payload of {head[0]} has the digest {digest}, not {head[7]}")
        return head[4], head[6], len(payload), digest, "response", None, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        parts: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in columns)
                if parts and parts[0][0] != row[0]:
                    out.append(record(parts))
                    parts = []
                parts.append(row)
            if out:
                yield give(out)
                out = []
        if parts:
            yield give([record(parts)])

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit has the digest and length of the payload it refers to, but no payload. Missing, repeated or short
    segments and wrong digests are errors.
    """
    segments = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, _SEGMENT)
    ordered = segments.repartition("origin").sortWithinPartitions("origin", F.coalesce("segment", F.lit(1)))
    return ordered.mapInArrow(_assembled(with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each target that revisits name must be there as a response with the digest and length they give.
    """
    spark = pages.sparkSession
    path = f"{work_dir(spark)}/millrace-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_bytes=min_bytes)
    found = staged(read_warc(spark, path, with_payload=False).drop("url", "payload"), "warc-index")
    named = found.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    lost = named.join(found.filter("record_type = 'response'"), ["page_id", "payload_digest", "payload_bytes"], "left_anti").limit(1).count()
    if lost:
        raise ValueError("a revisit names a response that is not in the archives")
    return found
