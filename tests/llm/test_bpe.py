"""Byte-level BPE against the tiktoken library and a plain search for the lowest rank."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe
from millrace.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "é", "é", "漢", "\U0001f600", "1", "23", "!", "'s", "'ll", "ing", " an", "\r\n", "<|endoftext|>"]), max_size=30).map("".join))
def test_same_as_library(text):
    assert bpe.BytePairs(RANKS, public_tokenizers.PATTERN).encode(text).tolist() == KNOWN.encode_ordinary(text)


def test_all_code_points(coder):
    for c in range(0, sys.maxunicode + 1, 1):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)} 1"
            assert coder.encode(text).tolist() == KNOWN.encode_ordinary(text), hex(c)


def test_long_pre_tokens(coder):
    rng = random.Random(5)
    for text in ("a" * 60_000, "ab" * 30_000, "".join(rng.choices("abcdefghij", k=50_000)), "漢字" * 9000, " " * 5000 + "x"):
        assert coder.encode(text).tolist() == KNOWN.encode_ordinary(text)


def test_ranks_in_any_order():
    # A merge may make a pair of a lower rank than its own, ties go from the left, and pre-tokens do not disturb one another.
    def plain(piece, ranks):
        parts = [bytes([b]) for b in piece]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    for _ in range(200):
        words = {bytes([c]) for c in b"\0abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(rng.randint(1, 20))}
        order = rng.sample(range(500_000), len(words))
        ranks = dict(zip(sorted(words), order))
        coder = bpe.BytePairs(ranks, r"\S+")
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(1, 25))) for _ in range(10)]
        assert coder.merged(pieces) == [plain(p, ranks) for p in pieces]
        assert not any(coder.low)


def test_generations(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 40)
    monkeypatch.setattr(bpe, "_AT_ONCE", 7)
    rng, coder = random.Random(4), bpe.BytePairs(RANKS, public_tokenizers.PATTERN)
    for _ in range(60):
        texts = [" ".join("".join(rng.choices("aeioutnsr", k=rng.randint(1, 9))) for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in coder.encode_all([*texts, ""])] == [*map(KNOWN.encode_ordinary, texts), []]
        assert len(coder.old_chunks) < 200 and len(coder.old_pieces) < 200


def expected(doc_id, text):
    ids = KNOWN.encode_ordinary(text or "")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())


def test_edges(spark):
    texts = [None, "", " \n ", "x" * 300_000, "the fox " * 100_000, "same", "same", "a\x00b", "<|endoftext|>", "Ünï 漢字 \U0001f600"]
    rows = [(None if t == "same" else i, t, i, "p", "d", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, ids string, decoded string, n_tokens int")
    ids = bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN)
    got = bpe.decode_ids(ids, PATH).collect()
    assert sorted((r.doc_id or -1, list(r.ids), bytes(r.decoded)) for r in got) == sorted((i or -1, KNOWN.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert bpe.decode_ids(bpe.encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, Q.op13_bpe(spark, folder).collect())) == sorted(expected(*d) for d in docs)
