"""Rules in full that shorter queries only touch: nested secrets, path prefixes, catching up, constrained neighbours, links to nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.redaction import redacted
from ..operators import components as C
from ..operators import evaluation as E
from ..operators import hierarchy as H
from ..operators import records as R
from ..operators import retrieval as S
from ..operators.aggregates import tokens
from ..operators.ordered import top_k
from ..sources.files import caught_up, work_path
from .inputs import Inputs
from .registry import query

_R = "***redacted***"


@query("txt40_nested_secrets", f"""SELECT event_id, '{{"user":' || user_id || ',"api_key":"{_R}","at":[{{"Session-Id":"{_R}","kind":"' || event_type || '"}},"token={_R} x' || event_id || '","Bearer {_R}"],"deep":{{"a":{{"b":{{"c":{{"d":{{"e":{{"f":"<max-depth>"}}}}}}}}}}}}}}' AS detail FROM events""")
def txt40(t: Inputs):
    text = F.concat(F.lit('{"user": '), "user_id", F.lit(', "api_key": ["k", "'), "event_id", F.lit('"], "at": [{"Session-Id": 1, "kind": "'), "event_type", F.lit('"}, "token=abc'), "event_id", F.lit(" x"), "event_id", F.lit('", "Bearer abcdefgh'), "event_id", F.lit('"], "deep": {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}}'))
    return t.events.select("event_id", redacted(text).alias("detail"))


_PATHS = "SELECT r.title AS path FROM nodes r WHERE r.parent_id IS NULL UNION ALL SELECT concat(r.title, '/', n.title) FROM nodes n JOIN nodes r ON r.id = n.parent_id WHERE r.parent_id IS NULL UNION ALL SELECT concat(r.title, '/', n.title, '/', c.title) FROM nodes c JOIN nodes n ON n.id = c.parent_id JOIN nodes r ON r.id = n.parent_id"


@query("gr3_path_prefix_counts", f"WITH p AS ({_PATHS}) SELECT a.path, count(*) AS n FROM (SELECT DISTINCT path FROM p) a JOIN p b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY 1")
def gr3(t: Inputs):
    paths = H.ancestor_paths(t.nodes).select(F.array_join("path", "/").alias("path"))
    return H.path_counts(paths, "path")


@query("src16_caught_up_copy", "SELECT max(o_orderkey) FILTER (o_orderkey < (SELECT max(o_orderkey) // 2 FROM orders)) AS mark, count(*) FILTER (o_orderkey >= (SELECT max(o_orderkey) // 2 FROM orders)) AS copied, count(*) AS rows_source, max(o_orderkey) AS max_source, count(*) AS rows_copy, max(o_orderkey) AS max_copy, true AS same FROM orders")
def src16(t: Inputs):
    """The first half is copied first; the second call takes what came since."""
    path = work_path(t._spark, "copy")
    half = t.orders.agg(F.max("o_orderkey")).first()[0] // 2
    caught_up(t.orders.filter(F.col("o_orderkey") < half), path, "o_orderkey")
    return caught_up(t.orders, path, "o_orderkey")


_SIM = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings), c AS (SELECT DISTINCT l_partkey - 1 AS vec_id, l_suppkey % 12 AS car FROM lineitem), s AS (SELECT q.vec_id AS src, v.vec_id AS dst, round(list_cosine_similarity(q.e, v.e), 5) AS sim FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label AND q.vec_id % 3 <> (v.vec_id + 1) % 3 AND q.vec_id % 7 <> v.vec_id % 7)"


@query("jn12_similar_under_rules", _SIM + " SELECT src, dst, sim FROM s WHERE sim >= 0.1 AND EXISTS (SELECT 1 FROM c a JOIN c b USING (car) WHERE a.vec_id = src AND b.vec_id = dst) QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 12")
def jn12(t: Inputs):
    """Neighbours of the same kind with a fitting verb class, another component and a vehicle in common: the twelve most similar."""
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    pairs = S.similar_pairs(t.embeddings, "vec_id", "embedding", asked, 0.1).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "sim")
    kind = t.embeddings.select("vec_id", "label")
    fit = pairs.join(kind.select(F.col("vec_id").alias("src"), F.col("label").alias("a")), "src").join(kind.select(F.col("vec_id").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b and src % 3 <> (dst + 1) % 3 and src % 7 <> dst % 7")
    cars = t.lineitem.groupBy((F.col("l_partkey") - 1).alias("vec_id")).agg(F.collect_set(F.col("l_suppkey") % 12).alias("cars"))
    shared = fit.join(cars.select(F.col("vec_id").alias("src"), F.col("cars").alias("ca")), "src").join(cars.select(F.col("vec_id").alias("dst"), F.col("cars").alias("cb")), "dst").filter(F.arrays_overlap("ca", "cb"))
    return top_k(shared, ["src"], [F.desc("sim"), F.col("dst")], 12).select("src", "dst", "sim")


@query("jn13_links_to_blobs", """WITH n AS (SELECT c_custkey AS id, 'car' || (c_nationkey % 3) AS car, 'page' || (c_custkey // 2) || '.html' AS base FROM customer),
f AS (SELECT car, base, min(id) AS node FROM n GROUP BY 1, 2), l AS (SELECT id AS src, car, unnest(['page' || (id // 2 + 1) || '.html', 'page' || (id // 3) || '.html']) AS base FROM n)
SELECT DISTINCT l.src, l.car, f.node AS dst, f.node % 50 AS blob FROM l JOIN f USING (car, base) WHERE f.node <> l.src""")
def jn13(t: Inputs):
    """Links of a vehicle's pages to the first node of that file name in the same vehicle, and that node's blob."""
    page = lambda x: F.concat(F.lit("page"), F.floor(x).cast("long"), F.lit(".html"))
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("car"), F.col("c_nationkey") % 3).alias("car"), page(F.col("c_custkey") / 2).alias("base"))
    html = F.concat(F.lit('<p><a href="../x/'), page(F.col("c_custkey") / 2 + 1), F.lit('#top">a</a> <a name="here">b</a> <a href="'), F.upper(page(F.col("c_custkey") / 3)), F.lit('?v=1">c</a></p>'))
    pages = t.customer.select(F.col("c_custkey").alias("src"), F.concat(F.lit("car"), F.col("c_nationkey") % 3).alias("car"), html.alias("html"))
    base = F.lower(F.regexp_extract("href", "([^/?#]+)(?:[?#].*)?$", 1))
    links = M.anchors(pages, "html").filter("href is not null").select("src", "car", base.alias("base"))
    first = nodes.groupBy("car", "base").agg(F.min("id").alias("dst"))
    return links.join(first, ["car", "base"]).filter("dst <> src").select("src", "car", "dst", (F.col("dst") % 50).alias("blob")).distinct()


#: Breadcrumbs of parts: system, side, component with its kind, action, page kind.
_CRUMB = "concat('Engine › ', split_part(p_type, ' ', 1), CASE p_partkey % 3 WHEN 0 THEN ' Front' WHEN 1 THEN ' Rear' ELSE '' END, ' › ', p_name, ' ', {kind}, ' Assembly › ', {verb}, CASE WHEN p_partkey % 2 = 0 THEN ' › Procedure' ELSE '' END)"
_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'Sensor' WHEN 1 THEN 'Oil Pump' WHEN 2 THEN 'Hose Switch' ELSE 'Part' END"
_VERB = "CASE p_partkey % 6 WHEN 0 THEN 'Removal' WHEN 1 THEN 'Overhaul' WHEN 2 THEN 'Bleeding' WHEN 3 THEN 'Inspection' WHEN 4 THEN 'Calibration' ELSE 'Parts Location' END"


def _crumbs(t: Inputs):
    sql = _CRUMB.format(kind=_KIND, verb=_VERB).replace("split_part(p_type, ' ', 1)", "split(p_type, ' ')[0]")
    return t.part.select("p_partkey", "p_type", "p_name", "p_brand", F.expr(sql).alias("crumb"))


@query("txt30_component_words", f"SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || {_KIND}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 2))) AS words, CASE p_partkey % 4 WHEN 0 THEN 'sensor' WHEN 1 THEN 'pump' WHEN 2 THEN 'switch' END AS kind FROM part")
def txt30(t: Inputs):
    return _crumbs(t).select("p_partkey", C.component_words(F.col("crumb")).alias("words"), C.part_kind(F.col("crumb")).alias("kind"))


@query("txt31_fitting_actions", f"WITH a AS (SELECT p_partkey, p_brand, CASE p_partkey % 6 WHEN 0 THEN 'replace' WHEN 1 THEN 'overhaul' WHEN 2 THEN 'bleed' WHEN 3 THEN 'inspect' WHEN 4 THEN 'adjust' END AS class FROM part), c AS (SELECT DISTINCT p_brand, class FROM a) SELECT a.p_partkey, a.class, count(c.class) FILTER (a.class = c.class OR (a.class, c.class) IN (('replace', 'overhaul'), ('overhaul', 'replace')))::BIGINT AS fitting FROM a LEFT JOIN c USING (p_brand) GROUP BY 1, 2")
def txt31(t: Inputs):
    a = _crumbs(t).select("p_partkey", "p_brand", C.action_class(F.element_at(F.split(F.regexp_replace("crumb", " › Procedure$", ""), " › "), -1)).alias("class"))
    classes = a.select("p_brand", F.col("class").alias("other")).distinct()
    return a.join(classes, "p_brand").groupBy("p_partkey", "class").agg(F.count_if(C.actions_fit(F.col("class"), F.col("other"))).alias("fitting"))


@query("txt42_topics", f"SELECT p_partkey, 'Engine' AS system, p_name || ' ' || {_KIND} || ' Assembly' AS component, lower({_VERB}) AS action FROM part WHERE p_partkey % 6 IN (0, 3, 5)")
def txt42(t: Inputs):
    found = _crumbs(t).select("p_partkey", C.topic(F.col("crumb")).alias("t")).filter("t is not null")
    return found.select("p_partkey", "t.system", "t.component", "t.action")


_ERFC = "(SELECT t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) FROM (SELECT x, 1 / (1 + 0.3275911 * x) AS t FROM (SELECT abs(z) / sqrt(2.0) AS x)))"
_METRICS = {"grounded": ("grounded", "true"), "degraded": ("degraded", "true"), "rephrased": ("id % 11 = 0", "true"), "copied": ("id % 13 = 0", "true"), "with_source_click": ("id % 4 = 0", "true"), "up": ("feedback = 1", "feedback <> 0")}


@query("anl7_all_tests", "WITH r AS (SELECT *, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS arm FROM chat), m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, arm, count(*) FILTER ({h} AND {c})::DOUBLE AS x, nullif(count(*) FILTER ({c}), 0)::DOUBLE AS n FROM r WHERE arm IS NOT NULL GROUP BY arm" for m, (h, c) in _METRICS.items()) + f"), p AS (SELECT a.metric, a.x / a.n AS on_rate, b.x / b.n AS off_rate, (a.x / a.n - b.x / b.n) / nullif(sqrt((a.x + b.x) / (a.n + b.n) * (1 - (a.x + b.x) / (a.n + b.n)) * (1 / a.n + 1 / b.n)), 0) AS z FROM m a JOIN m b USING (metric) WHERE a.arm AND NOT b.arm), c AS (SELECT count(*) FILTER (arm) AS answers_on, count(*) FILTER (NOT arm) AS answers_off, count(*) FILTER (arm IS NULL) AS untagged FROM r) SELECT metric, round(on_rate, 6) AS on_rate, round(off_rate, 6) AS off_rate, round({_ERFC}, 4) AS p_value, answers_on, answers_off, untagged, least(answers_on, answers_off) >= 100 AS enough_data FROM p, c")
def anl7(t: Inputs):
    rows = t.chat.withColumn("arm", F.expr("case user_id % 4 when 0 then true when 1 then false when 2 then false end"))
    return E.experiment_tests(rows, "arm", {m: (F.expr(h), F.expr(c)) for m, (h, c) in _METRICS.items()})


_RULES = [("Automobile", "required"), ("Building", "electrified"), ("Furniture", "combustion"), ("Household", "optional"), ("Special", "optional"), ("Machinery", "required"), ("Wiring", "required")]


@query("dq2_section_gaps", "WITH v AS (SELECT n_nationkey AS k, n_name AS stem FROM nation), r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a.lower()}', '{b}')" for a, b in _RULES) + ") x(title, req)), s AS (SELECT c_nationkey AS k, lower(c_mktsegment) AS title, count(*) FILTER (c_custkey % 8 = 0) AS leaves FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1, 2), e AS (SELECT v.*, r.*, s.leaves FROM v CROSS JOIN r LEFT JOIN s ON s.k = v.k AND s.title = r.title WHERE (req <> 'electrified' OR v.k % 3 = 0) AND (req <> 'combustion' OR v.k % 9 > 0)) SELECT stem, coalesce(list(title ORDER BY title) FILTER (req <> 'optional' AND leaves IS NULL), []) AS missing, coalesce(list(title ORDER BY title) FILTER (req <> 'optional' AND leaves = 0), []) AS empty, coalesce(list(title ORDER BY title) FILTER (req = 'optional' AND leaves IS NULL), []) AS optional_missing FROM e GROUP BY stem")
def dq2(t: Inputs):
    vehicles = t.nation.select(F.col("n_name").alias("stem"), (F.col("n_nationkey") % 3 == 0).alias("electrified"), (F.col("n_nationkey") % 9 == 0).alias("pure_electric"))
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("stem"))
    sections = t.customer.filter("c_custkey % 3 > 0").join(names, "c_nationkey").groupBy("stem", F.col("c_mktsegment").alias("title")).agg(F.count_if(F.col("c_custkey") % 8 == 0).alias("leaves"))
    return R.section_gaps(vehicles, sections, t._spark.createDataFrame(_RULES, "title string, requirement string"))


@query("trm7_shared_and_even", r"""WITH w AS (SELECT p_partkey AS id, p_brand, list_filter(string_split(regexp_replace(lower(concat(p_type, ' ', p_name)), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM part),
d AS (SELECT id, ws, row_number() OVER (ORDER BY id) - 1 AS i FROM w WHERE id % 5 = 0), b AS (SELECT p_brand AS batch, list_distinct(flatten(list(ws))) AS ws FROM w WHERE id % 35 = 1 GROUP BY 1),
m AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY id) AS place FROM b JOIN d ON list_has_any(b.ws, d.ws) QUALIFY place <= 5),
s AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY id) AS place FROM b, d WHERE i % greatest(1, (SELECT count(*) FROM d) // 5) = 0 AND (batch, id) NOT IN (SELECT batch, id FROM m) QUALIFY place <= 5)
SELECT batch, id, 'matched' AS kind, place FROM m UNION ALL SELECT batch, id, 'stable', place FROM s""")
def trm7(t: Inputs):
    words = tokens(F.concat_ws(" ", "p_type", "p_name"))
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("batch"), words.alias("words"))
    return R.exemplars(rows.filter("id % 35 = 1").select("batch", "words"), rows.filter("id % 5 = 0").select("id", "words"))
