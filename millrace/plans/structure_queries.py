"""Trees, graphs, retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import hierarchy as H
from ..operators import retrieval as S
from .inputs import Inputs
from .registry import query

_WALK = """WITH RECURSIVE walk AS (
  SELECT id, [title] AS path, [id] AS ids, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, list_append(w.path, n.title), list_append(w.ids, n.id), w.depth + 1 FROM walk w JOIN nodes n ON n.parent_id = w.id)
"""


@query("gr1_breadcrumbs", _WALK + "SELECT id, array_to_string(path, ' > ') AS breadcrumb, depth FROM walk")
def gr1(t: Inputs):
    return H.ancestor_paths(t.nodes).select("id", F.array_join("path", " > ").alias("breadcrumb"), "depth")


@query("gr2_subtree", _WALK + "SELECT id, array_to_string(path[list_position(ids, 'r1') + 1:], ' > ') AS below, (depth - list_position(ids, 'r1') + 1)::INT AS level FROM walk WHERE list_contains(ids, 'r1')")
def gr2(t: Inputs):
    return H.subtree(H.ancestor_paths(t.nodes), "r1")


@query("gr5_reach", _WALK + "SELECT a AS id, count(*) AS reach FROM (SELECT unnest(ids) AS a FROM walk) GROUP BY a")
def gr5(t: Inputs):
    return H.ancestor_paths(t.nodes).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("reach"))


@query("gr6_nearest_ancestor", _WALK + "SELECT w.id, (SELECT x.id FROM (SELECT unnest(w.ids[:-2]) AS id, generate_subscripts(w.ids[:-2], 1) AS k) x WHERE x.id[1:1] = 'r' OR substr(x.id, 2)::INT % 3 = 0 ORDER BY k DESC LIMIT 1) AS ancestor FROM walk w")
def gr6(t: Inputs):
    marked = t.nodes.filter("id like 'r%' or cast(substr(id, 2) as int) % 3 = 0")
    return H.nearest_marked_ancestor(H.ancestor_paths(t.nodes), marked)


@query("gr11_kept_with_ancestors", _WALK + "SELECT DISTINCT unnest(ids) AS id FROM walk WHERE id IN (SELECT id FROM nodes WHERE content = 'BUILDING')")
def gr11(t: Inputs):
    return H.kept_with_ancestors(H.ancestor_paths(t.nodes), t.nodes.filter("content = 'BUILDING'"))


@query("gr12_leaves", "SELECT id FROM nodes WHERE id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)")
def gr12(t: Inputs):
    return H.leaves(t.nodes).select("id")


@query("ord9_tree_order", _WALK + "SELECT w.id, array_to_string(list_transform(w.ids, lambda i: lpad(substr(i, 2), 8, '0')), '.') AS sort_key FROM walk w")
def ord9(t: Inputs):
    return H.tree_order_keys(H.ancestor_paths(t.nodes), t.nodes)


@query("gr13_one_hop", """
WITH b AS (SELECT src_blob, dst_blob, CASE relation WHEN 'labor' THEN 0 WHEN 'crosslink' THEN 1 ELSE 2 END AS priority, weight FROM edges),
d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src_blob, dst_blob ORDER BY priority, weight DESC) = 1)
SELECT * FROM (SELECT src_blob, dst_blob, priority, weight, row_number() OVER (PARTITION BY src_blob ORDER BY priority, weight DESC, dst_blob) AS rank FROM d) WHERE rank <= 4""")
def gr13(t: Inputs):
    return H.one_hop(t.edges, {"labor": 0, "crosslink": 1, "semantic": 2}, 4)


@query("gr14_neighbour_votes", """
WITH s AS (SELECT blob_id AS id FROM blobs WHERE size = 7),
top AS (SELECT dst_blob, weight FROM edges WHERE src_blob IN (SELECT id FROM s) QUALIFY row_number() OVER (PARTITION BY src_blob ORDER BY weight DESC, dst_blob, relation) <= 6)
SELECT dst_blob, round(sum(weight), 4) AS votes FROM top WHERE dst_blob NOT IN (SELECT id FROM s) GROUP BY 1 ORDER BY votes DESC, dst_blob LIMIT 20""")
def gr14(t: Inputs):
    return H.neighbour_votes(t.edges, t.blobs.filter("size = 7").select(F.col("blob_id").alias("id")), 6, 20)


BM25_TABLES = """WITH tok AS (SELECT blob_id, f, unnest(string_split(trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM (SELECT blob_id, 'title' AS f, title AS x FROM blobs UNION ALL SELECT blob_id, 'comp', component FROM blobs)),
tf AS (SELECT blob_id, term, count(*) FILTER (f = 'title') AS a, count(*) FILTER (f = 'comp') AS b FROM tok WHERE term <> '' GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), dl AS (SELECT blob_id, sum(a + b) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT DISTINCT query_id, unnest(string_split(trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM (SELECT p_partkey AS query_id, p_name || ' ' || p_type AS x FROM part WHERE p_partkey % 100 = 0))
"""


BM25_SQL = "SELECT query_id, blob_id, round(-sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (4 * a + 12 * b) * 2.2 / ((4 * a + 12 * b) + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (blob_id), st GROUP BY 1, 2"


@query("ret4_bm25", BM25_TABLES + BM25_SQL)
def ret4(t: Inputs):
    queries = t.part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return S.bm25_search(t.blobs, "blob_id", {"title": "title", "comp": "component"}, {"title": 4, "comp": 12}, queries)


@query("ret6_boolean", """WITH q AS (SELECT DISTINCT query_id, unnest(string_split(lower(x), ' ')) AS term FROM (SELECT p_partkey AS query_id, p_type AS x FROM part WHERE p_partkey % 100 = 0)),
h AS (SELECT DISTINCT p_partkey AS blob_id, unnest(string_split(lower(p_type), ' ')) AS term FROM part),
m AS (SELECT query_id, blob_id, count(*) AS matched FROM q JOIN h USING (term) GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1)
SELECT query_id, blob_id, matched, matched = need AS all_terms FROM m JOIN n USING (query_id) QUALIFY matched = need OR NOT max(matched = need) OVER (PARTITION BY query_id)""")
def ret6(t: Inputs):
    queries = t.part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("text"))
    return S.boolean_search(t.part.select(F.col("p_partkey").alias("blob_id"), F.col("p_type").alias("text")), "blob_id", "text", queries)


@query("ret1_nearest", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS sim FROM v q JOIN v ON q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(sim, 5) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def ret1(t: Inputs):
    queries = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return S.nearest(t.embeddings, "vec_id", "embedding", queries, 5)


@query("ret2_scoped_nearest", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS sim FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.label IN (1, 3))
SELECT query_id, vec_id, round(sim, 5) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def ret2(t: Inputs):
    queries = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return S.nearest(t.embeddings.filter("label in (1, 3)"), "vec_id", "embedding", queries, 3)


@query("scl8_quantized", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: greatest(-128, least(127, trunc(x::DOUBLE / (2 / 255.0::DOUBLE))::INT))))::BIGINT AS total FROM embeddings")
def scl8(t: Inputs):
    return t.embeddings.select("vec_id", F.aggregate(S.quantized(F.col("embedding")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("ret8_query_kind", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b[a-z][0-9][0-9a-f]{3}\\b') THEN 'code' WHEN w <= 3 THEN 'lexical' WHEN w >= 7 THEN 'semantic' ELSE 'mixed' END AS kind FROM (SELECT conv_id, turn, text, len(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM conversations)")
def ret8(t: Inputs):
    return t.conversations.select("conv_id", "turn", S.query_kind(F.col("text")).alias("kind"))


@query("ret10_calibrated", "SELECT l_orderkey, l_linenumber, round((l_tax * 0.30 + l_discount * 0.45 + l_quantity / 50 * 0.20 + 0.1 * 0.05) * CASE WHEN l_suppkey % 12 = 3 THEN 1.5 ELSE 1.0 END * 0.85, 8) AS score FROM lineitem")
def ret10(t: Inputs):
    boost = F.when(F.col("l_suppkey") % 12 == 3, 1.5).otherwise(1.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.calibrated(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 50, F.lit(0.1), boost, F.lit(0.85)), 8).alias("score"))


@query("ret11_chosen_occurrence", "SELECT blob_id, occ_id, car_stem, CASE tier WHEN 0 THEN 1.5 WHEN 1 THEN 1.1 ELSE 1.0 END AS boost FROM (SELECT *, CASE WHEN car_stem = 'car5' THEN 0 WHEN brand = 'brand1' THEN 1 ELSE 2 END AS tier FROM occurrences) QUALIFY row_number() OVER (PARTITION BY blob_id ORDER BY tier, occ_id) = 1")
def ret11(t: Inputs):
    return S.chosen_occurrence(t.occurrences, "car5", "brand1")


@query("ret15_confidence", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.75 AND l_tax * 3 >= 0.15 THEN 'high' WHEN l_discount * 10 >= 0.45 THEN 'medium' ELSE 'low' END AS band, CASE WHEN l_tax * 4 >= 0.20 AND l_discount * 10 >= 0.72 THEN 4 ELSE 8 END AS depth FROM lineitem")
def ret15(t: Inputs):
    sim = F.col("l_discount") * 10
    depth = S.adaptive_depth(F.col("l_tax") * 4, sim)
    return t.lineitem.select("l_orderkey", "l_linenumber", S.confidence_band(sim, F.col("l_tax") * 3).alias("band"), depth.alias("depth"))


_RANKED = "WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem), rel AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R') "


@query("evl_ranking_metrics", _RANKED + """, h AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN rel USING (query_id, item) WHERE rank <= 3 GROUP BY 1),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1)
SELECT query_id, coalesce(found, 0) AS found, (coalesce(found, 0) > 0)::INT AS hit, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(found / n_rel::DOUBLE, 0), 6) AS recall, round(coalesce(found / 3.0, 0), 6) AS "precision",
round(coalesce(dcg / list_sum(list_transform(range(1, least(n_rel, 3) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)""")
def evl(t: Inputs):
    from ..operators.ordered import top_k

    r = top_k(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 1 << 30).select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item"), "rank")
    rel = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item"))
    return E.ranking_metrics(r, rel, 3)


@query("evl10_wilson", "SELECT priority, n, h, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) AS low, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) AS high FROM (SELECT priority, count(*) AS n, count(*) FILTER (status = 'F') AS h, count(*) FILTER (status = 'F') / count(*)::DOUBLE AS p FROM ticket GROUP BY 1)")
def evl10(t: Inputs):
    low, high = E.wilson(F.col("h"), F.col("n"))
    return t.ticket.groupBy("priority").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("h")).select("priority", "n", "h", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("evl14_kappa", "WITH c AS (SELECT a, b, count(*) AS n FROM (SELECT l_returnflag = 'R' AS a, l_quantity > 25 AS b FROM lineitem) GROUP BY 1, 2), s AS (SELECT sum(n)::BIGINT AS t, sum(n) FILTER (a = b)::DOUBLE AS same FROM c), e AS (SELECT sum(r.n::DOUBLE * k.n) AS ch FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1) r JOIN (SELECT b, sum(n) AS n FROM c GROUP BY 1) k ON r.a = k.b) SELECT t AS n, round((same / t - ch / t / t) / (1 - ch / t / t), 6) AS kappa FROM s, e")
def evl14(t: Inputs):
    return E.cohen_kappa(t.lineitem.select((F.col("l_returnflag") == "R").alias("a"), (F.col("l_quantity") > 25).alias("b")), "a", "b")


@query("evl12_recall", _RANKED + "SELECT query_id, round(count(*) FILTER (a.item IS NOT NULL) / 3.0, 6) AS recall FROM (SELECT DISTINCT query_id, item FROM r WHERE rank <= 3) e LEFT JOIN (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS item FROM lineitem WHERE l_quantity > 20) a USING (query_id, item) GROUP BY 1")
def evl12(t: Inputs):
    from ..operators.ordered import top_k

    exact = top_k(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 3).select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item")).distinct()
    return E.recall_of(t.lineitem.filter("l_quantity > 20").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item")), exact, 3)


@query("evl11_permutation_test")
def evl11(t: Inputs):
    return E.permutation_test(t.lineitem, "l_returnflag", "l_discount", "l_tax")


@query("evl13_weight_grid", """WITH s AS (SELECT l_orderkey % 2 AS fold, l_orderkey AS query_id, l_linenumber AS item, l_discount AS a, l_tax AS b, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS target FROM lineitem),
w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w), b AS (SELECT fold, query_id, w, arg_max(target, (w * a + (1 - w) * b, item, target)) AS t FROM s, w GROUP BY 1, 2, 3), m AS (SELECT fold, w, round(avg(t), 6) AS mean FROM b GROUP BY 1, 2)
SELECT m.fold, m.w::DOUBLE AS w, m.mean FROM (SELECT 1 - fold AS fold, w FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mean DESC, w) = 1) c JOIN m ON m.fold = c.fold AND m.w = c.w""")
def evl13(t: Inputs):
    s = t.lineitem.select((F.col("l_orderkey") % 2).alias("fold"), F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("item"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("target"))
    return E.weight_grid(s, "a", "b", "target", "fold", [0.0, 0.25, 0.5, 0.75, 1.0])
