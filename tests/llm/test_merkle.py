"""The Merkle manifest against a plain recursion over levels."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx long, n long, digest string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    for level in levels[:-1]:
        yield level[i ^ 1] if i ^ 1 < len(level) else None, i & 1
        i >>= 1


def plain(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text); all results in any order."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels_of([leaf(r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            node = leaf(r if not tampered(r) or r[3] is None else (*r[:3], r[3] + 1, r[4]))
            for beside, right in path:
                node = h(node) if beside is None else h(beside, node) if right else h(node, beside)
            yield (r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(b for b, _ in path if b)), node, node == top[-1][0])


def result(spark, rows, tampered=lambda c: F.lit(False), levels=merkle.LEVELS):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA)
    changed = F.when(tampered(F.col("doc_id")), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claimed = merkle.digest_of([changed if c == "n_chars" else c for c in COLUMNS])
    return sorted((tuple(r) for r in merkle.merkle_manifest(docs, COLUMNS, claimed=claimed, levels=levels).collect()), key=repr)


def some_rows(n, langs, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), f"s{i % 3}", langs[int(rng.integers(len(langs)))], int(rng.integers(9)), "wörd " * int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_same_as_plain_recursion(spark, levels):
    # Small builders give many rounds; the groups then end in different rounds.
    rows = [*some_rows(37, ["en", "de", None, "en", "en", "fr", "a", "b", "c"], levels), (900, None, "one", None, None), (901, "", "", 0, "")]
    assert result(spark, rows, lambda c: c % 3 == 0, levels) == sorted(plain(rows, lambda r: r[0] % 3 == 0), key=repr)


def test_edges(spark):
    long = "word " * 200_000
    rows = [(None, "a", "en", 1, "t"), (None, None, None, None, None), (3, "a", "en", 5, long), (3, "a", "en", 5, long), (3, "a", "en", 6, "other"), (4, "a", None, None, "x"), (7, "", "", 0, "")]
    assert result(spark, rows, lambda c: c == 4) == sorted(plain(rows, lambda r: r[0] == 4), key=repr)
    assert result(spark, []) == []
    assert result(spark, rows[:1])[0][1:4] == (leaf(rows[0]),) * 3


def test_postorder_places():
    for n in range(1, 70):
        levels = levels_of([h(str(i)) for i in range(n)])
        log = merkle.append_nodes([d.encode() for d in levels[0]], merkle.tree_height(n))
        assert len(log) == sum(map(len, levels))
        for k, level in enumerate(levels):
            places = merkle.postorder_place(np.full(len(level), k), np.arange(len(level)), n)
            assert [log[p].decode() for p in places] == level


@pytest.mark.parametrize("levels", [3, 10])
def test_log_is_one_postorder(spark, levels):
    rows = some_rows(2500 if levels == 10 else 70, ["en", "en", "de"], 3)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    nodes = merkle.log_nodes(merkle.append_log(merkle.group_leaves(docs, COLUMNS, "lang", "doc_id"), ["id"], levels), levels).collect()
    for g in {r.grp for r in nodes}:
        own = sorted((r for r in nodes if r.grp == g), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        levels = levels_of([leaf(r) for r in rows if f"={r[2]}" == g])
        assert {(r.level, r.idx): r.digest for r in own} == {(k, i): d for k, level in enumerate(levels) for i, d in enumerate(level)}
