"""What trains on the driver holds a bounded part of the samples' words at a time, and gives its memory back."""

import tracemalloc

import numpy as np

from millrace.llm import quality, toxicity


def _peak(run, *args):
    tracemalloc.start()
    try:
        return run(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _texts(rng, texts, words, vocabulary):
    names = np.array([f"w{i:05d}" for i in range(vocabulary)])
    return [" ".join(names[rng.integers(0, vocabulary, words)]) for _ in range(texts)]


def test_toxicity_words_in_parts():
    texts = ["One two, two three.", None, "", "two " * 300_000, "é " * 3 + "four", "  "]
    hashes, ids, counts, documents, data, begin, end = toxicity.words_in_parts(texts)
    words = ["one", "two", "two", "three", *["two"] * 300_000, *"ééé", "four"]
    assert counts.tolist() == [4, 0, 0, 300_000, 4, 0] and (np.diff(hashes.astype(object)) > 0).all()
    named = [bytes(data[a:b]).decode() for a, b in zip(begin, end)]
    assert [named[i] for i in ids] == words
    assert dict(zip(named, documents.tolist())) == {"one": 1, "two": 2, "three": 1, "é": 1, "four": 1}
    assert [x.tolist() for x in toxicity.words_in_parts([None, ""])] == [[], [], [0, 0], [], [], [], []]


def test_toxicity_words_need_few_bytes_each():
    texts = _texts(np.random.default_rng(1), 1000, 2500, 3000)
    toxicity.words_of(texts[:100])  # makes tables that are kept
    _, peak = _peak(toxicity.words_in_parts, texts)
    assert peak < 20 * 1000 * 2500


def test_quality_training_needs_few_bytes_a_word():
    rng = np.random.default_rng(2)
    texts = [t.encode() for t in _texts(rng, 400, 2500, 30_000)]
    target = rng.random(400)
    w, peak = _peak(quality.train_scorer, texts, target, 3)
    assert peak < 35 * 400 * 2500
    # The same sums in the same order as over all buckets at once.
    row, column, value = quality.hashed(texts)
    one = np.zeros(quality.BUCKETS + 1)
    m, v = one.copy(), one.copy()
    for t in range(1, 4):
        d = (1 / (1 + np.exp(-np.clip(np.bincount(row, value * one[column], 400) + one[-1], -30, 30))) - target) / 400
        g = np.append(np.bincount(column, value * d[row], quality.BUCKETS), d.sum()) + 1e-4 * one
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        one -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    assert (w == one).all()


def test_quality_gives_memory_back_after_training(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(quality, "train_scorer", lambda *a: calls.append("trained") or np.zeros(quality.BUCKETS + 1))
    monkeypatch.setattr(quality, "give_back_memory", lambda: calls.append("given back"))
    quality.score_quality(spark.createDataFrame([(i, f"Some words of a text, number {i}.") for i in range(9)], "doc_id long, text string"))
    assert calls[-2:] == ["trained", "given back"]
