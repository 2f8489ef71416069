"""Tree tours and layouts against recursion."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from millrace.operators import layout as L


def plain(rows):
    below = {}
    for i, p, s in rows:
        below.setdefault(p, []).append((s, i))
    out, leaf = {}, [0]

    def walk(i, depth):
        first = leaf[0]
        kids = [walk(c, depth + 1) for _, c in sorted(below.get(i, []))]
        if not kids:
            leaf[0] += 1
        x = (kids[0] + kids[-1]) / 2 if kids else float(first)
        out[i] = (depth, first, leaf[0] - first, x)
        return x

    sys.setrecursionlimit(10_000)
    for _, r in sorted(below.get(None, [])):
        walk(r, 0)
    return out


def tree(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long, s int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    rows = [(i, None if i < 2 else rng.randrange(max(0, i - 9), i), rng.randrange(5)) for i in range(80)]
    rows += [(200, 201, 0), (201, 200, 0), (300, 999, 0)]  # a ring, and an unknown parent
    found = L.toured(tree(spark, rows), ["s"], {"n": F.lit(1), "odd": F.col("id") % 2}).collect()
    want = plain(rows)
    assert {r.id: (r.depth, r.leaf_at, r.leaves) for r in found} == {i: v[:3] for i, v in want.items()}

    def under(i):
        return [i, *(x for c, p, _ in rows if p == i for x in under(c))]

    assert {r.id: (r.n, r.odd) for r in found} == {i: (len(under(i)), sum(x % 2 for x in under(i))) for i in want}
    drawn = {r.id: (r.x, r.y) for r in L.tidy_layout(tree(spark, rows), ["s"]).collect()}
    assert drawn == {i: (pytest.approx(240 * v[3]), 150.0 * v[0]) for i, v in want.items()}


def test_chain_and_star(spark):
    n = 10_000
    chain = [(i, i - 1 if i else None, 0) for i in range(n)]
    star = [(n, None, 1), *((n + 1 + i, n, i) for i in range(100_000))]
    # A comb: every node of a chain has a leaf beside it.
    comb = [(500_000, None, 2), *(x for i in range(1, 2000) for x in ((500_000 + i, 499_999 + i, 0), (600_000 + i, 499_999 + i, 1)))]
    drawn = L.tidy_layout(tree(spark, [*chain, *star, *comb]), ["s"])
    got = {r.id: (r.x, r.y) for r in drawn.filter(F.col("id").isin(0, n - 1, n, n + 1, n + 100_000, 500_000, 501_999)).collect()}
    assert got[0] == (0.0, 0.0) and got[n - 1] == (0.0, 150.0 * (n - 1))
    assert got[n] == (240.0 * (1 + 99_999 / 2), 0.0) and got[n + 1] == (240.0, 150.0) and got[n + 100_000] == (240.0 * 100_000, 150.0)
    assert got[501_999] == (240.0 * 100_001, 150.0 * 1999)
    x = 0.0
    for i in range(1999, 0, -1):  # the deepest comb node is leaf 0, its neighbours follow outwards
        x = (x + 2000 - i) / 2
    assert got[500_000][0] == pytest.approx(240.0 * (100_001 + x))


def test_empty(spark):
    assert L.tidy_layout(tree(spark, []), ["s"]).count() == 0
