"""The last step of the Jaccard join: copies that are too far apart to be linked make few candidates."""

from __future__ import annotations

import numpy as np

from millrace.llm import ngram_jaccard as J


def test_map_differs_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(3)
    for size, changed in ((0, 0), (1, 1), (145, 20), (145, 60), (5000, 900)):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
        x, y = J.parity_map(a).tolist(), J.parity_map(b).tolist()
        assert len(x) == len(y) == J._MAP_WORDS
        assert sum((p ^ q).bit_count() if p ^ q >= 0 else 64 - (~(p ^ q)).bit_count() for p, q in zip(x, y)) <= len(np.setxor1d(a, b))


def test_far_copies_make_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for j, at in enumerate(rng.choice(28, 3, replace=False) * 5 + 7):
            words[at] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[i][1] + " end") for i in range(5)]
    seen = {}
    plain = J.staged
    monkeypatch.setattr(J, "staged", lambda df, label: seen.setdefault(label, plain(df, label)) if label == "pairs-rest" else plain(df, label))
    found = {r.doc_id: r.component_id for r in J.ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    least = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    assert found == least
    # Some 7000 pairs share most of their keys.
    assert seen["pairs-rest"].count() <= 100 + 2 * len(linked)
