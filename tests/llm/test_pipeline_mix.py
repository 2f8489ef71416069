"""The mix reaches the pipeline's sequences."""

import corpus_pipeline
import pytest

from millrace.llm import mixing, packing
from millrace.llm.queries import TOKENIZER

SMALL = "/root/testdata/sf0.001"


def test_weights_change_the_result(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("sequence_id", "offset", "doc_id", "piece").collect()))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = min(r.source for r in docs.select("source").distinct().collect())
    before = rows()
    monkeypatch.setattr(corpus_pipeline, "MIX", {**corpus_pipeline.MIX, "weights": {first: 1.0}})
    after = rows()
    assert after != before
    assert sorted(x[2:] for x in after) == sorted(x[2:] for x in before)


@pytest.mark.parametrize("stretch", [7, 64])
def test_stretches_follow_the_mix_by_brute_force(spark, stretch):
    mix = {"weights": {"a": 3.0, "b": 1.0}, "block_docs": 2}
    words = "the quick brown fox jumps over a lazy dog ".split()
    data = [(i, " ".join(words[(i + j) % 9] for j in range(i * 7 % 90)), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(data + [(60, None, None)], "doc_id long, text string, source string")
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mix_sources(docs, **mix).collect()}
    got = packing.pack_mixed(docs, TOKENIZER, mix, 32, 2, stretch).collect()
    cut = packing.token_pieces(docs, TOKENIZER, 32, 2).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(map(tuple, cut))
    order = sorted((*place[r.doc_id], r.piece, r.doc_id) for r in cut)
    at = {(d, p): i for i, (_, _, p, d) in enumerate(order)}
    sequences = {}
    for r in got:
        assert r.sequence_id >> 32 == at[r.doc_id, r.piece] // stretch
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, at[r.doc_id, r.piece]))
    firsts = []
    for _, items in sorted(sequences.items()):
        items.sort()
        assert [o for o, _, _ in items] == [sum(n for _, n, _ in items[:i]) for i in range(len(items))]
        assert sum(n for _, n, _ in items) <= 32
        firsts.append(min(x for _, _, x in items))
    assert firsts == sorted(firsts)


def test_repeated_and_null_ids_stay(spark):
    rows = [(None, "one two", "a"), (None, "three", "a"), (1, "four", None), (1, "four", None), (1, "five six", "b"), (2, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack_mixed(docs, TOKENIZER, corpus_pipeline.MIX).collect()
    assert sorted((r.doc_id or 0, r.length, r.ids_crc32) for r in got) == sorted((r.doc_id or 0, r.length, r.ids_crc32) for r in packing.token_pieces(docs, TOKENIZER).collect())
    assert packing.pack_mixed(docs.limit(0), TOKENIZER, corpus_pipeline.MIX).count() == 0
