"""Functions that SQL does not check: HTML, streams and tests by brute force."""

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import evaluation as E
from millrace.operators import filters as L
from millrace.operators import hierarchy as H
from millrace.operators import retrieval as S
from millrace.sources import files
from millrace.streaming import stateful as T

SMALL = "/root/testdata/sf0.001"


def test_flat_text():
    assert X.flat_text('<p>a <b>b</b></p><script>var t="</p>";</script><table><tr><td>1</td><td>2</td></tr></table>') == "a b\n\n1 | 2"
    assert X.flat_text("&amp; &lt;x&gt;") == "& <x>"
    assert X.flat_text("") == ""
    assert X.flat_text(None) is None


def test_sanitized(spark):
    rows = spark.createDataFrame([('<p onclick="x">a<span>b</span><a href="java\tscript:x">l</a><a href="/ok">k</a><script>1</script></p>',), (None,)], "h string")
    assert [r[0] for r in rows.select(X.sanitized_html("h")).collect()] == ['<p>ab<a>l</a><a href="/ok">k</a></p>', None]


def test_rate_limit_by_brute_force(spark):
    rows = T.table_stream(spark, SMALL, "events").withColumn("t", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double"))
    got = {r.event_id: r.accepted for r in T.drained(T.rate_limited(rows, "user_id", 2, 86400.0), "append", "t").collect()}
    events = sorted((r.user_id, r.t, r.event_id) for r in spark.read.parquet(f"{SMALL}/events.parquet").withColumn("t", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double")).collect())
    held, want = {}, {}
    for user, t, i in events:
        kept = [x for x in held.get(user, []) if x >= t - 86400]
        want[i] = len(kept) < 2
        held[user] = [*kept, t] if want[i] else kept
    assert got == want


def test_two_proportions(spark):
    r = spark.range(1).select(E.two_proportions(F.lit(30), F.lit(100), F.lit(50), F.lit(100)).alias("p")).first()
    assert abs(r.p - 0.003892) < 1e-5


def test_permutation_test(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0)] * 12 + [("b", 1.0, 0.0), ("b", 0.0, 1.0)], "g string, x double, y double")
    got = {r.g: r.p for r in E.permutation_test(rows, "g", "x", "y", rounds=2000).collect()}
    assert got["a"] < 0.01 and got["b"] == 1.0


def test_weak_hits(spark):
    rows = spark.createDataFrame([(1, False, 0.5, 0.0), (1, False, 0.4, 1.0), (2, False, 0.6, 0.0), (3, True, 0.1, 0.0)], "query_id int, g boolean, s double, b double")
    assert sorted(r.query_id for r in L.weak_hits_removed(rows, "g", "s", "b").collect()) == [1, 2, 3]


def test_zip_bundles(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("2020 brand model/a.html", "hello")
        z.writestr("2020 brand model/b/c.html", "")
    got = sorted((r.bundle, r.top, r.member, r.size, bytes(r.content)) for r in files.read_zip_bundles(spark, str(tmp_path)).collect())
    assert got == [("x.zip", "2020 brand model", "2020 brand model/a.html", 5, b"hello"), ("x.zip", "2020 brand model", "2020 brand model/b/c.html", 0, b"")]


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,x\n2,\n".encode())
    assert sorted((r.id, r.name) for r in files.read_csv(spark, str(tmp_path), "id int, name string").collect()) == [(1, "x"), (2, None)]


def test_sanitised_attributes_stay_inside_their_quotes(spark):
    html = '<a href="x&quot; onmouseover=&quot;alert(1)">t</a><a href="java&#10;script:alert(1)">u</a><a href="/p?a=1&amp;b=2">v</a>'
    (row,) = spark.createDataFrame([(html,)], "h string").select(X.sanitized_html("h").alias("c")).collect()
    assert row.c == '<a href="x&quot; onmouseover=&quot;alert(1)">t</a><a>u</a><a href="/p?a=1&amp;b=2">v</a>'


def nearest_by_force(vectors, queries, k, others_only):
    import numpy as np

    fit = lambda v: v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)
    out = []
    for q, qv in queries:
        sims = [(-round(float(np.dot(v, qv) / np.linalg.norm(v) / np.linalg.norm(qv)), 9), i) for i, v in vectors if fit(v) and fit(qv) and len(v) == len(qv) and not (others_only and i == q)]
        out += [(q, i, round(-s, 5), r) for r, (s, i) in enumerate(sorted(sims)[:k], 1)]
    return sorted(out)


def test_nearest_by_force_with_ties_and_broken_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)] + [(100 + i, [1.0, 1.0, 0.0]) for i in range(9)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 0.0]), (203, [float("nan"), 1.0, 0.0]), (204, [1.0, 2.0]), (205, [1.0, 2.5]), (206, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 5 == 0 or r[0] > 100]
    queries = spark.createDataFrame(asked, "query_id long, qvec array<double>")
    for limit in (S._QUERY_BYTES, 200):  # the second takes several passes
        monkeypatch.setattr(S, "_QUERY_BYTES", limit)
        for others_only in (True, False):
            got = sorted(map(tuple, S.nearest(vectors, "vec_id", "v", queries, 4, others_only).collect()))
            assert got == nearest_by_force(rows, asked, 4, others_only)


def test_paths_of_deep_trees_and_rings(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"t{i}") for i in range(15)] + [("a", "b", "x"), ("b", "a", "y"), ("lost", "nowhere", "z")]
    got = {r.id: (r.ids, r.depth) for r in H.ancestor_paths(spark.createDataFrame(rows, "id string, parent_id string, title string")).collect()}
    assert got == {f"n{i}": ([f"n{k}" for k in range(i + 1)], i) for i in range(15)}
    assert H.ancestor_paths(spark.createDataFrame([], "id string, parent_id string, title string")).count() == 0
