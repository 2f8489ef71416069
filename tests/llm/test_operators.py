"""Edge cases and brute force for the training-data operators."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from millrace.llm import chat, ego_join, langid, mixing, ngram_jaccard, oracles, packing, quality, tiff, toxicity, warc
from millrace.llm import queries as Q
from millrace.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, piece string, key string, class string, row string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "p", "k", "c", "r") for i, t, lang, s in rows], SCHEMA)


def edge_rows():
    word = "the quick brown fox jumps over the lazy dog and runs away from here today "
    return [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "one two", "en", "b"), (5, "One TWO", "de", "b"),
        (6, word * 3, "en", "a"), (7, word * 3, "en", "a"), (7, word * 3, "en", "a"), (None, word * 3, "en", "a"), (8, word * 2000, None, "a"),
        (9, "!!! $$$ 123", "en", None), (12, "a <|endoftext|> b<|endoftext|>", "en", "a"), (10, "é ü ñ 漢字 \U0001f600", "fr", "c"), (11, "x" * 50_000, "en", "c"),
    ]


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(Q.queries()[name](spark, SMALL), duck, oracles.SQL[name])


# packing


def check_packing(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        pieces = {(r.piece, r.start, r.length, r.ids_crc32) for r in mine}
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        assert pieces == {(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    total = sum(r.length for r in rows)
    return len(by_seq), -(-total // capacity)


def test_packing_edges(spark):
    rows = edge_rows()
    got = packing.pack_documents(docs(spark, rows), TOKENIZER).collect()
    check_packing(got, [(i, t) for i, t, _, _ in rows])
    assert packing.pack_documents(docs(spark, []), TOKENIZER).count() == 0


def test_packing_is_tight(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    used, least = check_packing(Q.op1_pack(spark, "/root/testdata/sf0.01").collect(), texts)
    assert used <= 1.03 * least + 3


def test_chunks_encode_as_whole_texts():
    e = packing.ChunkEncoder(TOKENIZER)
    r = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "　", "!", "\xa0", "foo", "\r\n", "<|endoftext|>", "\n ", "\x85", "word.", "\0"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t, coded in zip(texts, e.encode(texts)):
        assert e.tokenizer.encode(t, add_special_tokens=False).ids == coded.tolist(), repr(t)


def test_very_long_texts_encode_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "_BLOCK", 40)
    e = packing.ChunkEncoder(TOKENIZER)
    for t in ("hello world,  foo\n x <|endoftext|> é " * 30, "x" * 300, " " * 200, "a b " * 100):
        (coded,) = e.encode([t])
        assert e.tokenizer.encode(t, add_special_tokens=False).ids == coded.tolist()


def test_repeated_rows_make_no_hot_shard(spark):
    pieces = packing.document_pieces(docs(spark, [(None, "same text", "en", "a")] * 500), TOKENIZER).select("doc_id", F.monotonically_increasing_id().alias("row"), F.inline("pieces"))
    keys = pieces.select(F.pmod(F.xxhash64("row", "piece", F.lit(0)), F.lit(8)).alias("k")).groupBy("k").count().collect()
    assert len(keys) == 8 and max(r["count"] for r in keys) < 120
    assert packing.pack_documents(docs(spark, [(None, "same text", "en", "a"), (2**60 + 1, "x", "en", "a")] * 50), TOKENIZER, shard_pieces=8).filter(f"doc_id = {2**60 + 1}").count() == 50


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    lengths, capacity = rng.integers(1, 21, 200), 20
    bins, offsets, gaps = packing.sum_of_squares(lengths, capacity)
    free = {}
    for s, b, o in zip(lengths, bins, offsets):
        count = np.bincount([g for g in free.values() if g], minlength=capacity + 1)
        square = lambda c: int((c.astype(int) ** 2).sum())

        def after(gap):
            c = count.copy()
            if gap < capacity:
                c[gap] -= 1
            if gap - s > 0:
                c[gap - s] += 1
            return square(c)

        choices = [after(g) for g in range(s, capacity) if count[g]] + [after(capacity)]
        assert after(capacity - o) == min(choices)
        free[b] = capacity - o - s
    assert [free[b] for b in range(len(gaps))] == gaps.tolist()


# WARC


def test_warc_edges(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "é", "ü" * 60_000), (6, "u", "same"), (6, "u", "same"), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, target string")
    warc.write_warc(pages, str(tmp_path / "w"), segment_bytes=1000, chunk_bytes=300, records_per_file=3)
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (1, "revisit", 6), (2, "revisit", 6), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None), (6, "response", None), (7, "response", None)]
    whole = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert whole[5] == "ü" * 60_000 and whole[7] == "WARC/1.1\r\n\r\n0\r\n\r\n" and whole[4] == ""
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_missing_segment_is_an_error(spark, tmp_path):
    from pyspark.errors import PythonException

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha1:x\r\nWARC-Segment-Number: 1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x").write_bytes(record)
    with pytest.raises(PythonException, match="missing"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_chunk_framing():
    for size in (1, 7, 4096):
        for payload in (b"", b"a", b"\r\n" * 50, bytes(range(256)) * 40):
            assert warc.dechunked(warc.chunked(payload, size)) == payload
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


# n-gram Jaccard


def by_force(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split(" ") if t else []
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_ngram_jaccard_edges(spark):
    rows = edge_rows()
    got = ngram_jaccard.ngram_jaccard_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = by_force([(i, t) for i, t, _, _ in rows if i is not None])
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (15, None)), r
    assert ngram_jaccard.ngram_jaccard_groups(docs(spark, [])).count() == 0


def test_ngram_jaccard_large_groups(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base, passage = [r.choice(vocabulary) for _ in range(60)], [r.choice(vocabulary) for _ in range(25)]
    rows = []
    for i in range(220):  # one group of near copies, at the edge of the threshold
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(300, 420):  # a passage that many documents share, which are not alike
        rows.append((i, " ".join([*(r.choice(vocabulary) for _ in range(r.randint(4, 12))), *passage])))
    for i in range(500, 560):
        rows.append((i, " ".join(r.choice(vocabulary[:3]) for _ in range(r.randint(1, 7)))))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.ngram_jaccard_groups(docs(spark, [(i, t, "en", "a") for i, t in rows]), frequent_from=4).collect()}
    assert got == by_force(rows)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (12, 10), (7, 7), (8, None)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys((10, 11, 12), 10), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 261), 200)}


# quality


def test_quality_edges(spark):
    rows = edge_rows()
    got = quality.score_quality(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.keep for r in got}[2] is False
    assert quality.score_quality(docs(spark, [])).count() == 0


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = quality.score_quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    counts = {(r.quality, r.keep): r["count"] for r in got.groupBy("quality", "keep").count().collect()}
    good, bad = counts.get((1, True), 0) / (counts.get((1, True), 0) + counts.get((1, False), 0)), counts.get((0, False), 0) / (counts.get((0, True), 0) + counts.get((0, False), 0))
    assert good >= 0.995 and bad >= 0.9


def noisy_votes():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    return truth, np.stack([np.where(rng.random(20_000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) * (rng.random(20_000) < 0.8) for a in (0.95, 0.8, 0.7)], 1)


def test_label_model_finds_accuracies():
    """At production parameters."""
    truth, votes = noisy_votes()
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, table = quality.label_model(patterns, counts.astype(float))
    assert ((good[inverse.ravel()] >= 0.5) == truth).mean() > 0.9
    for k, accuracy in enumerate((0.95, 0.8, 0.7)):
        assert abs(table[k, 1, 2] / (table[k, 1, 2] + table[k, 1, 0]) - accuracy) < 0.05


def em_by_document(votes, steps=200, strength=10.0):
    """The label model without pattern counts: plain loops over documents."""
    share, table = [0.2, 0.8], [quality.PRIOR.copy() for _ in range(votes.shape[1])]
    for _ in range(steps):
        like = np.array([[share[c] * np.prod([table[k][c][v + 1] for k, v in enumerate(row)]) for c in (0, 1)] for row in votes])
        good = like[:, 1] / like.sum(1)
        new = [quality.PRIOR * strength * np.array(share)[:, None] for _ in table]
        for row, g in zip(votes, good):
            for k, v in enumerate(row):
                new[k][0][v + 1] += 1 - g
                new[k][1][v + 1] += g
        table = [t / t.sum(1, keepdims=True) for t in new]
        share = [(len(votes) - good.sum() + 1) / (len(votes) + 2), (good.sum() + 1) / (len(votes) + 2)]
    return good


def votes_by_hand(text):
    words = re.split("[\x20\x09-\x0d]+", text)
    words = [w for w in words if w]
    if not words:
        return [0] * 8
    n, raw = len(words), [w.encode() for w in words]
    symbols = set("!$%&*#@^~|<>=+_{}[]\\/")
    count = lambda w: sum(c in symbols for c in w)
    upper, letters, size = sum("A" <= c <= "Z" for w in words for c in w), sum(c.isascii() and c.isalpha() for w in words for c in w), sum(map(len, raw))
    mean, ends = size / n, sum(w[-1] == "." for w in words) / n
    return [
        -(sum(count(w) > 0 for w in words) / n > 0.2),
        -(upper / max(1, letters) > 0.5 and letters > 20),
        -(sum(a == b for a, b in zip(words, words[1:])) / n > 0.2),
        -(n >= 20 and len(set(words)) / n < 0.2),
        -1 if mean > 15 or mean < 2 else int(3 < mean < 10),
        -1 if n >= 20 and ends < 0.005 else int(0.02 < ends < 0.6),
        -(sum(map(count, words)) / size > 0.04),
        -(sum(w[-1] in symbols for w in words) / n > 0.15),
    ]


def test_quality_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in Q.op4_quality(spark, SMALL).collect()}
    votes = np.array([votes_by_hand(t or "") for _, t in rows])
    texts = [(t or "").encode() for _, t in rows]
    assert (quality.voted(texts) == votes).all()
    weak = em_by_document(votes)
    assert all(abs(got[i].weak_label - g) < 1e-6 for (i, _), g in zip(rows, weak))
    # The scorer, from the same examples, bucket by bucket.
    once = sorted({t: g for (_, t), g in zip(rows, weak) if t}.items())
    w = quality.train_scorer([t.encode() for t, _ in once], np.array([g for _, g in once]))
    for (i, _), text in zip(rows, texts):
        _, bucket, value = quality.hashed([text])
        score = 1 / (1 + np.exp(-(sum(v * w[b] for b, v in zip(bucket, value)) + w[-1]))) if len(bucket) else 0
        assert abs(got[i].score - score) < 1e-6 and got[i].keep == (got[i].score >= 0.5)


def test_quality_features_by_hand():
    text = "The the the dog. #1 ÉCOLE $$ A"
    words = text.split()
    _, bucket, value = quality.hashed([b"other words", text.encode()])
    of, bucket, value = quality.hashed([text.encode()])
    assert set(of) == {0} and abs((value[bucket >= quality.SHAPES] ** 2).sum() - 1) < 1e-9
    assert len(bucket[bucket >= quality.SHAPES]) == len(set(words))
    assert sorted(np.round(value[bucket >= quality.SHAPES] ** 2 * len(words)).astype(int)) == sorted(words.count(w) for w in set(words))


# TIFF


def test_codecs():
    assert tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = packed and tiff.packbits_decode(packed, 24)
    assert plain.hex().upper() == "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"
    assert tiff.packbits_encode(np.frombuffer(plain, np.uint8).reshape(1, 24)) == packed
    rng = np.random.default_rng(1)
    for n in (1, 2, 4094, 50_000):
        for top in (2, 256):
            d = rng.integers(0, top, n, dtype=np.uint8).tobytes()
            assert tiff.lzw_decode(tiff.lzw_encode(d), n) == d


def test_tiff_forms():
    rng = np.random.default_rng(2)
    for n in (64, 64 * 1024, 64 * 1025, 64 * 2500):
        d = rng.integers(0, 40, n, dtype=np.uint8).tobytes()
        for compression in (1, 5, 8, 32773, 32946):
            for predictor in (1, 2):
                for tiled in (True, False):
                    pages = list(tiff.decode_tiff(tiff.encode_tiff(d, compression, predictor, tiled)))
                    assert b"".join(x for _, x in pages) == d
                    assert len(pages) == -(-n // (64 * 1024)) and pages[0][0]["compression"] == compression


def test_a_corpus_uses_all_forms():
    forms = {tiff._form(str(i).encode()) for i in range(3000)}
    assert forms == {(c, p, t) for c in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE) for p in (1, 2) for t in (True, False)}


def test_big_endian_colour_tiff():
    import struct

    samples = bytes(range(2 * 3 * 3))
    tags = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 3, 100), (259, 3, 1, 1 << 16), (273, 4, 1, 110), (277, 3, 1, 3 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, len(samples))]
    head = b"MM\0*" + struct.pack(">I", 200)
    body = head.ljust(100, b"\0") + struct.pack(">HHH", 8, 8, 8)
    body = body.ljust(110, b"\0") + samples
    body = body.ljust(200, b"\0") + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *x) for x in tags) + b"\0\0\0\0"
    ((about, got),) = tiff.decode_tiff(body)
    assert got == samples and about["samples_per_pixel"] == 3


def test_tiff_edges(spark):
    rows = edge_rows()
    got = tiff.page_digests(tiff.tiff_pages(tiff.tiff_of_texts(docs(spark, rows)))).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _, _ in rows}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (6, 7, None)}) == 1
    assert tiff.page_digests(tiff.tiff_pages(tiff.tiff_of_texts(docs(spark, [])))).count() == 0


# mixing


def test_mixing_edges(spark):
    rows = edge_rows()
    got = mixing.mix_sources(docs(spark, rows), block_docs=2, keep=True).collect()
    assert len(got) == len(rows) and {r.source for r in got} == {"a", "b", "c", "(none)"}
    assert sorted(r.row.doc_id or 0 for r in got) == sorted(i or 0 for i, *_ in rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    given = mixing.mix_sources(docs(spark, rows), weights={"a": 3.0, "b": 1.0, "c": 0.0}, block_docs=1).collect()
    assert len(given) == len(rows) == len({(r.slot, r.place) for r in given})
    last = max(r.slot for r in given if r.source in "ab")
    assert all(r.slot > last for r in given if r.source not in "ab")
    assert len({(r.slot, r.place) for r in mixing.mix_sources(docs(spark, rows), weights={}).collect()}) == len(rows)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs(spark, rows), weights={"a": bad})


def deviation(slots, weights):
    """The largest distance from weight x slots, over all sources and numbers of slots; slots hold (source, block)."""
    done, worst = dict.fromkeys(weights, 0), 0
    for t, (source, nth) in enumerate(slots, 1):
        assert nth == done[source]
        done[source] += 1
        worst = max(worst, max(abs(done[s] - w * t) for s, w in weights.items()))
    return worst


@pytest.mark.parametrize("counts", [[70_000, 20_000, 9_000, 1_000], [1, 2, 3, 5, 8, 13, 21, 34, 55], [10**6, *range(100, 120)]])
def test_deviation_stays_under_one_block(spark, counts):
    """Over 10^5 slots, so over many chunks: strictly from the weights as scheduled, from irrational ones up to their rounding."""
    root = np.sqrt(counts)
    scaled = [(f"s{i:02d}", int(round(x)), 100_000) for i, x in enumerate(root / root.sum() * mixing.SCALE)]
    got = mixing.pfair_schedule(spark.createDataFrame(scaled, "source string, m long, slots long")).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and len(got) >= 100_000
    slots, total = [(r.source, r.nth) for r in got[:100_000]], sum(m for _, m, _ in scaled)
    assert deviation(slots, {s: m / total for s, m, _ in scaled}) < 1
    assert deviation(slots, {s: x / root.sum() for (s, _, _), x in zip(scaled, root)}) < 1 + 100_000 / mixing.SCALE


def test_documents_follow_the_schedule(spark):
    sizes = {"a": 3500, "b": 1000, "c": 450, "d": 51}
    rows = [(k, "x", "en", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix_sources(docs(spark, rows), temperature=1.0, block_docs=1).collect()
    assert sorted(r.slot for r in got) == list(range(5001))
    assert deviation([(r.source, r.block) for r in sorted(got, key=lambda r: r.slot)], {s: n / 5001 for s, n in sizes.items()}) < 1
    for s in sizes:
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.block)
        assert [r.doc_id for r in mine] == sorted((r.doc_id for r in mine), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


def test_equal_deadlines_go_by_name(spark):
    got = mixing.mix_sources(docs(spark, [(i, "x", "en", s) for i, s in enumerate("cabcab")]), block_docs=1).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.slot)] == list("abcabc")


# embeddings


def test_ego_join_by_force(spark):
    rng = np.random.default_rng(0)
    x = []
    for b in rng.standard_normal((120, 16)):
        x.append(b)
        x += [b + rng.standard_normal(16) * rng.uniform(0.05, 0.4) for _ in range(rng.integers(0, 6))]
    x = np.array([*x, *[x[0]] * 40], np.float32)
    rng.shuffle(x)
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (None, [1.0] * 16), (5004, []), (5005, [None] * 16), *[(6000 + k, [1.0, 0.1 * (k // 2), 0.0]) for k in range(12)]]
    df = spark.createDataFrame([(*r, "z", 1) for r in [*enumerate(x.tolist()), *odd]], "vec_id long, embedding array<float>, digest string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.ego_join_groups(df, block_vectors=24, leaf=5).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(y))
    while (new := np.array([min([label[i], *label[near[i]]]) for i in range(len(y))])).tolist() != label.tolist():
        label = new
    for i in range(len(y)):
        assert got[i] == (near[i].sum(), label[i], label[i] == i)
    assert got[5000] == (0, 5000, True) and got[5003] == (0, 5003, True) and got[None] == (0, None, None)
    short = np.array([[1.0, 0.1 * (k // 2), 0.0] for k in range(12)])
    short /= np.linalg.norm(short, axis=1)[:, None]
    assert [got[6000 + k] for k in range(12)] == [((short @ short[k] >= 0.9).sum() - 1, 6000, k == 0) for k in range(12)]
    assert ego_join.ego_join_groups(df.limit(0)).count() == 0
    assert ego_join.ego_join_groups(df.filter("vec_id = 5000")).count() == 1
    alone = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.ego_join_groups(df).collect()}
    assert alone == got


def test_ego_join_orders_tables_of_every_size_by_grid(spark):
    for folder, many in ((SMALL, 500), ("/root/testdata/sf0.1", 2000)):
        v = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        classes = v.mapInArrow(ego_join._parsed, "vec_id long, digest binary, raw binary, dim int").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("dim").alias("dim"))
        lengths = classes.groupBy("dim").count()
        eps = float(np.sqrt(0.2))
        axes = ego_join._fitted_axes(classes, lengths, 1000)
        blocks = ego_join.grid_blocks(classes, lengths, axes, "<f8", eps, 16_384, 8).orderBy("block").collect()
        assert [b.block for b in blocks] == list(range(8)) and axes.keys() == {64}
        assert sum(len(b.ids) // 8 for b in blocks) == classes.count() <= many
        cells = [tuple(c) for b in blocks for c in np.floor(ego_join._unit([b.vectors], 64) @ axes[64] / eps)[:, :8].tolist()]
        assert cells == sorted(cells)


def test_ego_join_of_many_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(1 + i % 40).tolist()) for i in range(600)]
    got = {r.vec_id: r.n_links for r in ego_join.ego_join_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    assert got == {i: sum(j != i and len(unit[j]) == len(unit[i]) and unit[j] @ unit[i] >= 0.9 for j in range(600)) for i in range(600)}


def test_leaf_pairs_skip_only_what_is_apart():
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 10, (300, 1)), 0) + rng.uniform(0, 0.1, (300, 3)) * [[0, 1, 1]]
    for same, y in ((True, x), (False, x + [[3, 0, 0]])):
        pairs = set(ego_join._leaf_pairs(x, y, same, 0.5, 16))
        close = {(i // 16, j // 16) for i, j in zip(*np.nonzero(np.linalg.norm(x[:, None] - y[None], axis=2) <= 0.5)) if not same or i <= j}
        assert close <= pairs and len(pairs) < 120


# languages


def test_language_edges(spark):
    rows = edge_rows()
    got = langid.identify_language(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].lang_pred == by[2].lang_pred == by[9].lang_pred == "und"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert langid.identify_language(docs(spark, [])).count() == 0


def test_language_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = langid.identify_language(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r.a > 0.98


def test_backoff_uses_longest_known_gram():
    gram = lambda *gs: (np.sort(np.array([langid.grams_of([g.strip("^$")], len(g))[0][0 if g[0] == "^" else 1] for g in gs])), None)
    grams = {n: (hashes, np.array([[v, 0.0]])) for n, (hashes, _), v in ((5, gram("^catt"), 2.0), (2, gram("do"), 3.0), (1, gram("o"), 4.0))}
    m = langid.Model(["a", "b"], {"cat": 0}, np.array([[1.0, 0]]), grams)
    assert m.backed_off(["cattle", "dodo", "xox", "zzz"])[:, 0].tolist() == [2, 3, 4, 0]
    assert m.totals(["cat Cattle", ""])[0][:, 0].tolist() == [3, 0]


def language_by_hand(rows, least=2):
    """Counters of whole words and n-grams as strings, word by word."""
    from collections import Counter

    words_in = lambda t: ["".join(g) for letter, g in itertools.groupby((t or "").lower(), str.isalpha) if letter]
    pieces = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    learn = {(t, lang) for i, t, lang, _ in rows if t is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)}
    languages = sorted({lang for _, lang in learn})
    tables = {}
    for n in range(6):
        count = {lang: Counter(u for t, own in learn if own == lang for w in words_in(t) for u in ([w] if n == 0 else pieces(w, n))) for lang in languages}
        known = [u for u, c in sum(count.values(), Counter()).items() if c >= least]
        size = {lang: sum(count[lang][u] for u in known) + 0.5 * len(known) for lang in languages}
        tables[n] = {u: np.array([np.log((count[lang][u] + 0.5) / size[lang]) for lang in languages]) for u in known}

    def word_score(w):
        if w in tables[0]:
            return tables[0][w]
        for n in (5, 4, 3, 2, 1):
            if found := [tables[n][g] for g in pieces(w, n) if g in tables[n]]:
                return np.mean(found, 0)
        return np.zeros(len(languages))

    out = []
    for i, t, _, _ in rows:
        words = words_in(t)
        total = sum(map(word_score, words), np.zeros(len(languages)))
        p = np.exp(total - total.max())
        out.append((i, languages[int(p.argmax())] if words else "und", p.max() / p.sum() if words else 0.0))
    return out


def test_language_query_by_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, None) for r in table.collect()]
    rows += [(10**6, "Straße zzqx 漢字 x²y_z", "de", None), (None, "the cat", "en", None), (10**6 + 1, "½ ² _", "fr", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for i, lang, score in language_by_hand(rows):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6, i


# chat


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n<|im_start|>x"), (1, 1, "assistant", "<"), (1, 2, "assistant", "|im_end|>"), (2, 0, None, None), (None, 0, "user", "n"), (3, None, "a\\n\nb", "<||<|||>"), (3, 1, "assistant", "é" * 3_000_000), (3, 2, "assistant", "tail"), (4, 0, "user", "t"), (4, 0, "user", "t"), (4, 0, "assistant", "t")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chat(df)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(chat.format_chat(df.limit(0))).count() == 0


# toxicity


def test_toxicity_edges(spark):
    rows = edge_rows()
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, None), (None, 1), (10, 0), (9, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs(spark, rows), labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].score == by[2].score == 0 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.score_toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.score_toxicity(docs(spark, rows), labels.limit(0)).filter("score > 0").count() == 0


def small_network(rng):
    net = toxicity.Network(toxicity.Inputs(np.empty(0, np.uint64), np.empty(0, np.uint64), rng), rng)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    return net


def test_toxicity_gradients():
    rng = np.random.default_rng(4)
    net = small_network(rng)
    x, ids = rng.standard_normal((20, toxicity.INPUTS)), rng.integers(0, 20, (5, toxicity.WINDOW))
    mask = np.arange(toxicity.WINDOW) < np.array([32, 3, 10, 1, 20])[:, None]
    y = np.array([1.0, 0, 1, 0, 1])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, ids, mask).astype(float)))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = net.gradients(x, ids, mask, y)
    for k, values in {**net.p, "x": x}.items():
        flat = values.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[k].reshape(-1)[i]) < 2e-3, k


def test_toxicity_scores_by_brute_force():
    """Window by window and word by word, with dictionaries and plain loops."""
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("lo", "wei", "qu", "é", "toxi") for b in ("na", "rem", "c", "schen", "x")]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 31, 32, 33, 49, 200]))) + r.choice(["", ".", " ,, "]) for _ in range(60)]
    net = toxicity.train(texts, np.array([int("toxi" in t[:40]) for t in texts]), steps=10)
    inputs, p, H = net.inputs, net.p, toxicity.HIDDEN
    row, gram_row = {int(h): i for i, h in enumerate(inputs.words)}, {int(h): i for i, h in enumerate(inputs.grams)}
    sig = lambda v: 1 / (1 + np.exp(-v))

    def vector(word):
        h, _, data, begin, end = toxicity.words_of([word])
        grams, _ = toxicity.grams_of(data, begin, end)
        own = inputs.word_table[row.get(int(h[0]), -1)]
        return np.concatenate([own, sum((inputs.gram_table[gram_row[int(g)]] for g in grams if int(g) in gram_row), np.zeros(toxicity.SIZE))])

    def window(x):
        states = np.zeros((len(x), 2 * H))
        for k, side in enumerate("fb"):
            h = np.zeros(H)
            for t in range(len(x)) if side == "f" else reversed(range(len(x))):
                gate, hu = x[t] @ p["W" + side] + p["b" + side], h @ p["U" + side]
                z, q = sig(gate[:H] + hu[:H]), sig(gate[H : 2 * H] + hu[H : 2 * H])
                h = (1 - z) * np.tanh(gate[2 * H :] + q * hu[2 * H :]) + z * h
                states[t, k * H : (k + 1) * H] = h
        a = np.exp(states @ p["va"] - (states @ p["va"]).max())
        return (a / a.sum()) @ states @ p["wo"] + p["bo"][0]

    for text, score in zip(texts, net.scores(texts)):
        x = [vector(w) for w in text.lower().replace(".", " ").replace(",", " ").split()]
        starts = range(0, max(1, len(x) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if x else []
        want = max((window(np.array(x[a : a + toxicity.WINDOW])) for a in starts), default=-np.inf)
        assert score == want or abs(score - want) < 1e-3, text


def test_windows_cover_whole_texts():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        doc, first, size = toxicity.windows_of(np.array([n, 5]))
        covered = set()
        for d, f, s in zip(doc, first, size):
            if d == 0:
                covered |= set(range(f, f + s))
        assert covered == set(range(n)) and (size > 0).all()


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = Q.op10_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    c = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert c[(1, 1)] / (c[(1, 1)] + c.get((1, 0), 0)) > 0.85 and c.get((0, 1), 0) / (c[(0, 0)] + c.get((0, 1), 0)) < 0.02
