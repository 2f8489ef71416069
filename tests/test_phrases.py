"""The phrase automaton by brute force, and both ways of replacing."""

import pickle
import random
import re

import pytest

from millrace.functions import phrases as P


def brute(text, terms):
    """Greedy from the left: at each word the longest phrase that stands there."""
    words = list(re.finditer(P.WORD, text))
    out, at, i = [], 0, 0
    while i < len(words):
        for n in range(max(map(len, terms), default=0), 0, -1):
            part = words[i : i + n]
            gaps = [text[a.end() : b.start()] for a, b in zip(part, part[1:])]
            if tuple(m[0].lower() for m in part) in terms and all(re.fullmatch(P.GLUE, g) for g in gaps):
                out += [text[at : part[0].start()], terms[tuple(m[0].lower() for m in part)]]
                at = part[-1].end()
                i += n
                break
        else:
            i += 1
    return "".join(out) + text[at:]


def samples(seed, n):
    rng = random.Random(seed)
    gap = lambda: rng.choice([" ", " ", " ", "-", " & ", " / ", "  ", ", ", "\n"])
    terms = {tuple(rng.choices("abcd", k=rng.randint(1, 4))): f"<{i}>" for i in range(rng.randint(0, 12))}
    texts = ["".join(w + gap() for w in rng.choices(["a", "B", "c", "d", "zz"], k=rng.randint(0, 25))) for _ in range(n)]
    return terms, texts


def test_longest_from_the_left():
    for seed in range(300):
        terms, texts = samples(seed, 3)
        keys = list(terms)
        automaton = pickle.loads(pickle.dumps(P.PhraseAutomaton([" ".join(k) for k in keys])))
        for t in texts:
            assert P._spliced(t, [(a, b, terms[keys[p]]) for a, b, p in automaton.longest(t)]) == brute(t, terms)


def test_all_matches():
    rng = random.Random(3)
    for _ in range(200):
        phrases = sorted({" ".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(6)})
        text = " ".join(rng.choices("abx", k=20))
        words = text.split()
        got = sorted((f, e, P.PhraseAutomaton(phrases).phrases[p]) for f, e, _, _, p in P.PhraseAutomaton(phrases).matches(text))
        assert got == sorted((i, i + len(p.split()), p) for p in phrases for i in range(20) if words[i : i + len(p.split())] == p.split())


@pytest.mark.parametrize("limit", [P.BROADCAST_BYTES, 0])
def test_replaced(spark, limit):
    terms, texts = samples(5, 60)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:5], None, ""])], "id int, t string")
    dictionary = spark.createDataFrame([(" ".join(k), v) for k, v in terms.items()] + [("", "empty"), (None, "x"), ("q", None)], "p string, r string")
    got = {r.id: r.out for r in P.replaced(rows, "t", dictionary, "p", "r", "out", broadcast_bytes=limit).collect()}
    assert got == {r.id: None if r.t is None else brute(r.t, terms) for r in rows.collect()}
    assert [r.out for r in P.replaced(rows.limit(1), "t", dictionary.limit(0), "p", "r", "out", limit).collect()] == [texts[0]]
