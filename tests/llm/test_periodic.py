"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib

import pytest

from millrace.llm import periodic
from millrace.llm import queries as Q
from millrace.llm.common import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w):
    """(start, length, period) of all runs."""
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(24, 3 * q) and all(s[:-d] != s[d:] for d in range(1, q)):
                out.add((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng, pieces=6):
    out, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for _ in range(rng.randint(1, pieces)):
        of = letters[: rng.choice([1, 2, 3, 26])]
        if rng.random() < 0.5:
            out += rng.choices(of, k=rng.randint(0, 60))
        else:
            out += (rng.choices(of, k=rng.randint(1, rng.choice([3, 10, 60]))) * 300)[: rng.randint(1, 330)]
    return out


def by_tiles(texts):
    codes, owner, _, _ = word_hashes([t.encode() for t in texts])
    found = {}
    for d, low, high, base, words, at in periodic.tiles_of(codes, owner):
        for q, a, b in periodic.fragments_of(words.tolist(), at.tolist(), low, high):
            found.setdefault((d, q), set()).update(range(base + a, base + b))
    runs = {}
    for (d, q), places in found.items():
        for a in sorted(p for p in places if p - 1 not in places):
            b = a
            while b in places:
                b += 1
            if b - a + q >= max(24, 3 * q):
                runs[d, a, b - a + q] = min(q, runs.get((d, a, b - a + q), q))
    return [sorted((a, n, q) for (e, a, n), q in runs.items() if e == d) for d in range(len(texts))]


def test_tiles(monkeypatch):
    rng = random.Random(4)
    for span in (16, 64, 4096):
        monkeypatch.setattr(periodic, "_SPAN", span)
        for _ in range(40):
            many = [some_words(rng) for _ in range(5)]
            assert by_tiles([" ".join(w) for w in many]) == [plain(w) for w in many]


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = rng.choices([1, 2], k=rng.randint(1, 40))
        z = periodic.z_function(s, len(s))
        assert z[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


def test_stitched(spark):
    rows = [(1, 0, 5), (1, 5, 9), (1, 10, 12), (1, 3, 4), (2, 2, 3), (None, 1, 2), (None, 2, 8)]
    got = periodic.stitched(spark.createDataFrame(rows, "k int, first long, stop long"), ["k"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 0, 9), (1, 10, 12), (2, 2, 3), (None, 1, 8)], key=repr)


def edge_texts():
    rng = random.Random(8)
    return [
        None, "", " \n\t", "a " * 23, "a " * 24, "\x0ba\x0c" * 40, "x y " * 12, " ".join(map(str, range(3000))) + " u v w" * 2000, "same words here " * 30, "same words here " * 30,
        " ".join(map(str, range(7000))) * 1 + (" " + " ".join(map(str, range(900)))) * 4, "é ü é\xa0 " * 50, *(" ".join(some_words(rng)) for _ in range(20)),
    ]


def test_edges(spark):
    rows = [(None if i in (8, 9) else i, t, 1, "r", "c", i) for i, t in enumerate(edge_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key int, runs string, collapsed string, spread int")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        runs = plain(w) if len(w) < 5000 else {7: [(3000, 6000, 3)], 10: None}[i]
        if runs is None:
            runs = [x for x in got if x[0] == i][0][1]
            assert [(a, n, q) for a, n, q in runs if q == 900] == [(7000, 3600, 900)]
        want.append((i, runs, collapsed(w, runs)))
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = plain(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *figures, digest("".join(f"{a},{m},{q}\n" for a, m, q in runs)), digest(collapsed(w, runs))))
    assert sorted(map(tuple, Q.op11_periodic_runs(spark, folder).collect())) == sorted(want)
    assert sum(x[1] > 0 for x in want) > 5
