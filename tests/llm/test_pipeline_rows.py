"""The pipeline's stages judge rows, not ids: null and repeated ids, an id with two texts, copies."""

import random
from collections import Counter

import corpus_pipeline as P

from millrace.llm import quality, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def given(spark):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*P.COLUMNS).collect()]


def with_edges(rows, bad):
    """Rows and, of new ids, a bad and a good text: under a null id, under one id, and each repeated."""
    text = {r[0]: r[1] for r in rows}
    b, g = text[min(bad)], text[min(set(text) - bad)]
    row = lambda i, t: (i, t, "en", None, 5)
    return rows + [row(None, b), row(None, g), row(10**9, b), row(10**9, g), row(10**9 + 1, b), row(10**9 + 1, b), row(10**9 + 2, g), row(10**9 + 2, g)]


def kept(stage, spark, rows):
    return Counter(map(tuple, stage(spark, frame(spark, rows).repartition(3), SMALL).select(*P.COLUMNS).collect()))


def test_toxicity_by_row(spark):
    rows = given(spark)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score_toxicity(frame(spark, rows), labels).filter("predicted = 1").collect()}
    out = {r[1] for r in rows if r[0] in bad}
    rows = with_edges(rows, bad)
    assert kept(P.toxicity_stage, spark, rows) == Counter(r for r in rows if r[1] not in out)
    assert kept(P.toxicity_stage, spark, []) == Counter()


def test_quality_by_row(spark):
    first = given(spark)
    bad = {r.doc_id for r in quality.score_quality(frame(spark, first)).filter("not keep").collect()}
    rows = with_edges(first, bad)
    again = {r.doc_id for r in quality.score_quality(frame(spark, rows).repartition(3)).filter("not keep").collect()}
    out = {r[1] for r in first if r[0] in again}
    assert kept(P.quality_stage, spark, rows) == Counter(r for r in rows if r[1] not in out)
    assert kept(P.quality_stage, spark, []) == Counter()


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    near = lambda t, k: " ".join(t[:k] + ["x"] + t[k + 1 :])
    rows = []
    for k, t in enumerate(texts):
        ids = [None, k, k, k + 100, 200]  # 200: one id with all the texts
        rows += [(rng.choice(ids), rng.choice([" ".join(t), near(t, 39), near(t, 0)]), rng.choice(["en", None]), rng.choice(["a", None]), 1) for _ in range(9)]
    rows += [(300, " ".join(texts[0]), "en", "a", 1)] * 3 + [(None, "only null ids here one two", "en", "a", 1)] * 3 + [(400, "a b c", "en", "a", 1)] * 2
    rows += [(5, None, "en", "a", 0), (5, "en", None, "a", 0), (6, "", "en", "a", 0), (7, " ", "en", "a", 0), (7, " ", "en", "a", 0)]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i] == rows[j] or (sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    group = {}
    for i, r in enumerate(rows):
        group.setdefault(find(i), []).append(r)
    of = {r: g for g, members in group.items() for r in members}
    got = kept(P.near_duplicate_stage, spark, rows)
    assert Counter(of[r] for r in got.elements()) == Counter(dict.fromkeys(group, 1))
    for r in got:
        assert (r[0] is None, r[0] or 0) == min((x[0] is None, x[0] or 0) for x in group[of[r]])
    assert kept(P.near_duplicate_stage, spark, []) == Counter()
