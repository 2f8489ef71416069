"""Records of work: access, help desk, data quality, reports and small rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import access as G
from ..operators import aggregates as A
from ..operators import evaluation as E
from ..operators import hierarchy as H
from ..operators import ordered as O
from ..operators import records as R
from ..operators import retrieval as S
from .inputs import Inputs
from .registry import query

_WALK = """WITH RECURSIVE walk AS (
  SELECT id, [title] AS path, [id] AS ids, 0 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, list_append(w.path, n.title), list_append(w.ids, n.id), w.depth + 1 FROM walk w JOIN nodes n ON n.parent_id = w.id)
"""


@query("gr7_supervisor", _WALK + """, p AS (SELECT id, (sort_order * 7 % 5)::INT AS rank, sort_order % 3 <> 0 AS active FROM nodes),
u AS (SELECT id, unnest(ids) AS above, unnest(range(len(ids))) AS at FROM walk),
m AS (SELECT u.id, arg_max(u.above, u.at) AS supervisor FROM u JOIN p a ON a.id = u.above AND a.active JOIN p o ON o.id = u.id WHERE u.above <> u.id AND a.rank < o.rank GROUP BY 1)
SELECT p.id, coalesce(m.supervisor, (SELECT x.id FROM p x WHERE x.active AND x.id <> p.id ORDER BY x.rank, x.id LIMIT 1)) AS supervisor, m.supervisor IS NULL AS fallback FROM p LEFT JOIN m USING (id)""")
def gr7(t: Inputs):
    people = t.nodes.select("id", (F.col("sort_order") * 7 % 5).cast("int").alias("rank"), (F.col("sort_order") % 3 != 0).alias("active"))
    return R.nearest_senior(H.ancestor_paths(t.nodes), people)


@query("gr17_new_edges", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
n AS (SELECT src, dst, round(sim, 5) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 4)
SELECT src, dst, max(sim) AS sim FROM (SELECT * FROM n UNION ALL SELECT dst, src, sim FROM n) GROUP BY 1, 2""")
def gr17(t: Inputs):
    new = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    near = S.nearest(t.embeddings, "vec_id", "embedding", new, 4, others_only=True).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "sim")
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
    return near.unionByName(back).groupBy("src", "dst").agg(F.max("sim").alias("sim"))


@query("gr19_root_order", "SELECT id, row_number() OVER (ORDER BY title, id) AS place FROM nodes WHERE parent_id IS NULL")
def gr19(t: Inputs):
    return t.nodes.filter("parent_id is null").select("id", F.row_number().over(Window.orderBy("title", "id")).alias("place"))


@query("jn22_zipped", """WITH a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS place, l_partkey AS x FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O')),
b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS place, l_suppkey AS y FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'))
SELECT k, place, x, y, bool_and(x IS NOT NULL AND y IS NOT NULL) OVER (PARTITION BY k) AS complete FROM a FULL JOIN b USING (k, place)""")
def jn22(t: Inputs):
    lines = lambda s, v, name: t.lineitem.filter(F.col("l_linestatus") == s).select("l_orderkey", "l_partkey", "l_suppkey").distinct().select(F.col("l_orderkey").alias("k"), F.struct("l_partkey", "l_suppkey").alias("o"), F.col(v).alias(name))
    return R.zipped(lines("O", "l_partkey", "x"), lines("F", "l_suppkey", "y"), "k", "o", ("x", "y"))


@query("jn29_snapshot_live", "WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderkey % 50 <> 0), b AS (SELECT o_orderkey AS k, o_orderstatus AS g, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 40 <> 1) SELECT coalesce(b.g, a.g) AS g, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v = b.v) AS equal, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v <> b.v) AS changed, count(*) FILTER (b.k IS NULL) AS gone, count(*) FILTER (a.k IS NULL) AS new FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def jn29(t: Inputs):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("v"))
    return R.reconciled_tables(o.filter("k % 50 <> 0"), o.filter("k % 40 <> 1").withColumn("v", F.expr("if(k % 17 = 0, v + 1, v)")), "k", "g", "v")


@query("win18_least_used", """WITH i AS (SELECT c_custkey AS item, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), h AS (SELECT n_name AS holder, (n_nationkey * 3 % 11)::BIGINT AS load FROM nation),
p AS (SELECT holder, unnest(range(load + 1, (SELECT max(load) FROM h) + (SELECT count(*) FROM i) + 1)) AS level FROM h), q AS (SELECT holder, level, row_number() OVER (ORDER BY level, holder) AS n FROM p)
SELECT item, holder, level FROM i JOIN q USING (n)""")
def win18(t: Inputs):
    return R.least_used(t.customer.select(F.col("c_custkey").alias("item")), t.nation.select(F.col("n_name").alias("holder"), (F.col("n_nationkey") * 3 % 11).cast("long").alias("load")))


@query("win19_weighted_progress", "SELECT l_orderkey, round(100 * sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / sum(l_quantity), 2) AS percent FROM lineitem GROUP BY 1")
def win19(t: Inputs):
    done = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(100 * done / F.sum("l_quantity"), 2).alias("percent"))


@query("ord11_random_sample", "SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey::VARCHAR) LIMIT 50")
def ord11(t: Inputs):
    return t.customer.orderBy(F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string")).cast("binary"))).limit(50).select("c_custkey")


@query("gov3_packages", "SELECT user_id, list_sort(list(DISTINCT app_url)) AS packages, bool_or(action = 'purchase') AS eligible FROM activity GROUP BY 1")
def gov3(t: Inputs):
    return t.activity.groupBy("user_id").agg(F.sort_array(F.collect_set("app_url")).alias("packages"), F.bool_or(F.col("action") == "purchase").alias("eligible"))


@query("gov4_delegated", "WITH own AS (SELECT company_id, app_url FROM activity WHERE action = 'purchase' GROUP BY ALL), asked AS (SELECT user_id, company_id, app_url FROM activity WHERE action = 'view' GROUP BY ALL) SELECT a.user_id, a.app_url, o.app_url IS NOT NULL AS granted FROM asked a LEFT JOIN own o ON o.company_id = a.company_id AND o.app_url = a.app_url")
def gov4(t: Inputs):
    own = t.activity.filter("action = 'purchase'").select("company_id", "app_url", F.lit(True).alias("_own")).distinct()
    asked = t.activity.filter("action = 'view'").select("user_id", "company_id", "app_url").distinct()
    return asked.join(own, ["company_id", "app_url"], "left").select("user_id", "app_url", F.col("_own").isNotNull().alias("granted"))


@query("gov5_expiry", "SELECT c.c_custkey, coalesce(CASE WHEN c.c_custkey % 4 = 0 THEN DATE '2025-01-01' + (c.c_custkey % 90)::INT END, r.until) AS until FROM customer c LEFT JOIN (SELECT c_nationkey, DATE '2024-01-01' + max(c_custkey % 365)::INT AS until FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) r ON r.c_nationkey = c.c_nationkey")
def gov5(t: Inputs):
    root = t.customer.filter("c_custkey % 3 = 0").groupBy("c_nationkey").agg(F.date_add(F.lit("2024-01-01").cast("date"), F.max(F.col("c_custkey") % 365).cast("int")).alias("_root"))
    own = F.when(F.col("c_custkey") % 4 == 0, F.date_add(F.lit("2025-01-01").cast("date"), (F.col("c_custkey") % 90).cast("int")))
    return t.customer.join(root, "c_nationkey", "left").select("c_custkey", F.coalesce(own, "_root").alias("until"))


@query("misc22_compiled", """WITH w AS (SELECT c_custkey AS seat, c_nationkey AS car, CASE WHEN c_custkey % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END AS documents FROM customer), h AS (SELECT c_custkey AS seat, c_nationkey AS car, CASE WHEN c_custkey % 3 = 0 THEN ['a', 'b', 'c'] ELSE ['a'] END AS documents, c_custkey % 5 <> 0 AS admin_granted FROM customer WHERE c_custkey % 7 <> 0)
SELECT seat, car, CASE WHEN coalesce(h.admin_granted AND list_has_all(h.documents, w.documents), false) THEN h.documents ELSE w.documents END AS documents, coalesce(h.admin_granted AND list_has_all(h.documents, w.documents), false) AS kept FROM w LEFT JOIN h USING (seat, car)""")
def misc22(t: Inputs):
    c = t.customer.select(F.col("c_custkey").alias("seat"), F.col("c_nationkey").alias("car"))
    pick = lambda test, a, b: F.when(F.expr(test), F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, b))).alias("documents")
    return R.kept_grants(c.select("seat", "car", pick("seat % 2 = 0", "ab", "b")), c.filter("seat % 7 <> 0").select("seat", "car", pick("seat % 3 = 0", "abc", "a"), F.expr("seat % 5 <> 0").alias("admin_granted")), ["seat", "car"])


@query("misc12_all_cars", "WITH c AS (SELECT DISTINCT car_stem FROM occurrences), g AS (SELECT DISTINCT c_nationkey AS company, 'car' || (c_custkey % 12)::VARCHAR AS car_stem FROM customer WHERE c_custkey % 2 = 0) SELECT n_nationkey AS company, car_stem FROM nation, c WHERE n_nationkey % 2 = 0 AND (n_nationkey, car_stem) NOT IN (SELECT company, car_stem FROM g)")
def misc12(t: Inputs):
    cars = t.occurrences.select(F.col("car_stem").alias("car_id")).distinct()
    companies = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("company_id"))
    granted = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("company_id"), F.concat(F.lit("car"), (F.col("c_custkey") % 12).cast("string")).alias("car_id"))
    return G.missing_grants(cars, companies, granted).select(F.col("company_id").alias("company"), F.col("car_id").alias("car_stem"))


@query("hlp6_deflection", "SELECT count(DISTINCT s) AS shown, count(DISTINCT s) FILTER (d) AS deflected, round(count(DISTINCT s) FILTER (d) / count(DISTINCT s)::DOUBLE, 6) AS rate FROM (SELECT coalesce(nullif(session_id, ''), 'row' || id::VARCHAR) AS s, bool_or(grounded) OVER (PARTITION BY coalesce(nullif(session_id, ''), 'row' || id::VARCHAR)) AS d FROM chat)")
def hlp6(t: Inputs):
    s = t.chat.groupBy(F.coalesce(F.nullif("session_id", F.lit("")), F.concat(F.lit("row"), F.col("id").cast("string"))).alias("s")).agg(F.bool_or("grounded").alias("d"))
    return s.agg(F.count("*").alias("shown"), F.count_if("d").alias("deflected"), F.round(A.ratio(F.count_if("d"), F.count("*")), 6).alias("rate"))


_LAST = "SELECT request_id, count(*) FILTER (NOT internal AND from_customer AND author_id % 5 = 0) AS unread, arg_max(from_customer, (created_at, id)) FILTER (NOT internal) AS last_customer, max(created_at) AS last_at FROM message GROUP BY 1"


def _last(t: Inputs):
    public = t.message.filter("not internal").groupBy("request_id").agg(F.max_by("from_customer", F.struct("created_at", "id")).alias("last_customer"))
    unread = t.message.groupBy("request_id").agg(F.count_if(F.expr("not internal and from_customer and author_id % 5 = 0")).alias("unread"), F.max("created_at").alias("last_at"))
    return unread.join(public, "request_id", "left")


@query("scl16_activity_state", f"SELECT t.id, CASE WHEN t.status = 'F' THEN 'closed' WHEN coalesce(m.unread, 0) > 0 THEN 'unread' WHEN coalesce(m.last_customer, true) THEN 'awaiting_us' ELSE 'awaiting_them' END AS state FROM ticket t LEFT JOIN ({_LAST}) m ON m.request_id = t.id")
def scl16(t: Inputs):
    j = t.ticket.join(_last(t).withColumnRenamed("request_id", "id"), "id", "left")
    return j.select("id", R.ticket_activity(F.col("status") == "F", F.coalesce("unread", F.lit(0)), F.coalesce("last_customer", F.lit(True))).alias("state"))


@query("hlp9_desk_list", f"SELECT t.id, coalesce(m.unread, 0) AS unread, coalesce(m.last_at, t.created_at) AS touched FROM ticket t LEFT JOIN ({_LAST}) m ON m.request_id = t.id WHERE t.status <> 'F' AND t.priority IN ('1-URGENT', '2-HIGH') ORDER BY touched DESC, t.id DESC LIMIT 51")
def hlp9(t: Inputs):
    open_ = t.ticket.filter("status <> 'F' and priority in ('1-URGENT', '2-HIGH')").join(_last(t).withColumnRenamed("request_id", "id"), "id", "left")
    rows = open_.select("id", F.coalesce("unread", F.lit(0)).alias("unread"), F.coalesce("last_at", "created_at").alias("touched"))
    return O.keyset_page(rows, "touched", "id", None, 50)


@query("hlp10_feedback", "SELECT app_url, count(*) FILTER (id % 5 = 0) AS up, count(*) FILTER (id % 7 = 0 AND id % 5 <> 0) AS down, count(*) AS n FROM activity GROUP BY 1")
def hlp10(t: Inputs):
    return t.activity.groupBy("app_url").agg(F.count_if(F.expr("id % 5 = 0")).alias("up"), F.count_if(F.expr("id % 7 = 0 and id % 5 <> 0")).alias("down"), F.count("*").alias("n"))


@query("dq4_fleet_summary", "SELECT count(*) AS cars, count(*) FILTER (n >= 5) AS complete, count(*) FILTER (empty > 0) AS with_empty, sum(n)::BIGINT AS nodes FROM (SELECT parent_id, count(*) AS n, count(*) FILTER (content IS NULL) AS empty FROM nodes WHERE parent_id LIKE 'n%' GROUP BY 1)")
def dq4(t: Inputs):
    cars = t.nodes.filter("parent_id like 'n%'").groupBy("parent_id").agg(F.count("*").alias("n"), F.count_if(F.col("content").isNull()).alias("empty"))
    return cars.agg(F.count("*").alias("cars"), F.count_if(F.col("n") >= 5).alias("complete"), F.count_if(F.col("empty") > 0).alias("with_empty"), F.sum("n").alias("nodes"))


@query("dq5_repointed", "SELECT DISTINCT o_custkey, CASE WHEN l_suppkey % 4 = 3 THEN l_suppkey - 1 ELSE l_suppkey END AS l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def dq5(t: Inputs):
    grants = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t.lineitem.select("l_orderkey", "l_suppkey"), "l_orderkey").select("o_custkey", "l_suppkey")
    moved = t.supplier.filter("s_suppkey % 4 = 3").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") - 1).alias("kept"))
    return R.repointed(grants, moved, "o_custkey", "l_suppkey")


@query("dq6_completeness", "SELECT id, round(100.0 * ((trim(coalesce(title, '')) <> '')::INT + (trim(coalesce(content, '')) <> '')::INT + (parent_id IS NOT NULL)::INT) / 3, 1)::DOUBLE AS percent FROM nodes")
def dq6(t: Inputs):
    return R.completeness(t.nodes, "id", ["title", "content", "parent_id"])


@query("dq7_valid_trees", "SELECT r.id, count(c.id) FILTER (c.content IS NOT NULL) > 0 AS valid FROM (SELECT id FROM nodes WHERE parent_id IS NULL) r LEFT JOIN nodes n ON n.parent_id = r.id LEFT JOIN nodes c ON c.parent_id = n.id GROUP BY 1")
def dq7(t: Inputs):
    """A tree may be taken over if it has a root and a leaf with content."""
    leaves = H.ancestor_paths(t.nodes).join(t.nodes.filter("content is not null").select("id"), "id", "left_semi").select(F.element_at("ids", 1).alias("id"), F.lit(True).alias("_leaf")).distinct()
    return t.nodes.filter("parent_id is null").select("id").join(leaves, "id", "left").select("id", F.col("_leaf").isNotNull().alias("valid"))


@query("dq8_stale", "SELECT o_orderkey AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN b.builder < 3 THEN 'older_builder' ELSE 'older_than_source' END AS why FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_shipdate) AS built_at, max(l_linenumber) AS builder FROM lineitem GROUP BY 1) b ON b.k = o_orderkey WHERE b.k IS NULL OR b.builder < 3 OR o_orderdate > b.built_at")
def dq8(t: Inputs):
    built = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("built_at"), F.max("l_linenumber").alias("builder"))
    return R.stale(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("changed_at")), built, "k", 3)


@query("scl15_duration", "SELECT l_orderkey, round(5 + 0.8 * count(*) + 0.05 * sum(l_quantity), 3) AS seconds, CASE WHEN round(5 + 0.8 * count(*) + 0.05 * sum(l_quantity), 3) < 60 THEN 'light' WHEN round(5 + 0.8 * count(*) + 0.05 * sum(l_quantity), 3) < 600 THEN 'medium' ELSE 'heavy' END AS band FROM lineitem GROUP BY 1")
def scl15(t: Inputs):
    cost = t.lineitem.groupBy("l_orderkey").agg(F.round(5 + 0.8 * F.count("*") + 0.05 * F.sum("l_quantity"), 3).alias("seconds"))
    return cost.withColumn("band", R.load_band(F.col("seconds")))


@query("mon4_login_rules", "SELECT date_trunc('hour', created_at) AS hour, count(*) FILTER (action = 'error' AND company_id = 0) AS admin_fails, count(*) FILTER (action = 'click' AND id % 11 = 0) AS without_2fa, count(*) FILTER (action = 'error') >= 5 AS sms_failing FROM activity GROUP BY 1 HAVING count(*) FILTER (action = 'error' AND company_id = 0) >= 2 OR count(*) FILTER (action = 'error') >= 5")
def mon4(t: Inputs):
    g = t.activity.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(F.count_if(F.expr("action = 'error' and company_id = 0")).alias("admin_fails"), F.count_if(F.expr("action = 'click' and id % 11 = 0")).alias("without_2fa"), F.count_if(F.col("action") == "error").alias("fails"))
    return g.filter("admin_fails >= 2 or fails >= 5").select("hour", "admin_fails", "without_2fa", (F.col("fails") >= 5).alias("sms_failing"))


@query("mon9_recorded_traffic", "SELECT bucket, endpoint, method, sum(requests)::BIGINT AS requests, sum(errors_4xx)::BIGINT AS errors_4xx, sum(errors_5xx)::BIGINT AS errors_5xx, sum(total_ms)::BIGINT AS total_ms, max(max_ms) AS max_ms FROM traffic GROUP BY 1, 2, 3")
def mon9(t: Inputs):
    sums = [F.sum(c).alias(c) for c in ("requests", "errors_4xx", "errors_5xx", "total_ms")]
    return t.traffic.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).groupBy("bucket", "endpoint", "method").agg(*sums, F.max("max_ms").alias("max_ms"))


@query("str13_attempts", "SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch_us(created_at) / 1000000)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS attempts, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch_us(created_at) / 1000000)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) > 3 AS refused FROM activity WHERE action = 'error'")
def str13(t: Inputs):
    n = F.count("*").over(Window.partitionBy("user_id").orderBy(O.seconds("created_at")).rangeBetween(-86400, 0))
    return t.activity.filter("action = 'error'").select("id", n.alias("attempts"), (n > 3).alias("refused"))


@query("rec2_focus_areas", "WITH f AS (SELECT user_id, action, count(*) AS n FROM activity GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, action) <= 2), p AS (SELECT action, app_url, count(*) AS m FROM activity GROUP BY 1, 2), s AS (SELECT DISTINCT user_id, action, app_url FROM activity) SELECT f.user_id, f.action, p.app_url, p.m FROM f JOIN p USING (action) WHERE (f.user_id, f.action, p.app_url) NOT IN (SELECT user_id, action, app_url FROM s) QUALIFY row_number() OVER (PARTITION BY f.user_id ORDER BY p.m DESC, f.action, p.app_url) <= 3")
def rec2(t: Inputs):
    areas = O.top_k(t.activity.groupBy("user_id", "action").agg(F.count("*").alias("n")), ["user_id"], [F.desc("n"), F.col("action")], 2).select("user_id", "action")
    popular = t.activity.groupBy("action", "app_url").agg(F.count("*").alias("m"))
    unseen = areas.join(popular, "action").join(t.activity.select("user_id", "action", "app_url"), ["user_id", "action", "app_url"], "left_anti")
    return O.top_k(unseen, ["user_id"], [F.desc("m"), F.col("action"), F.col("app_url")], 3).select("user_id", "action", "app_url", "m")


@query("rec7_first_hint", "SELECT user_id, arg_min(hint, place) AS hint FROM (SELECT DISTINCT user_id, CASE action WHEN 'view' THEN 'search' WHEN 'click' THEN 'save' WHEN 'purchase' THEN 'share' END AS hint, CASE action WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS place, count(*) AS n FROM activity WHERE action IN ('view', 'click', 'purchase') GROUP BY user_id, action HAVING count(*) < 40) GROUP BY 1")
def rec7(t: Inputs):
    rules = [("view", "search"), ("click", "save"), ("purchase", "share")]
    shown = t.activity.groupBy("user_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a, _ in rules])
    hint = F.coalesce(*[F.when(F.col(a).between(1, 39), h) for a, h in rules])
    return shown.select("user_id", hint.alias("hint")).filter("hint is not null")


@query("anl2_platform", "SELECT created_at::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT company_id) AS companies, count(*) FILTER (category = 'system') AS system FROM activity GROUP BY 1")
def anl2(t: Inputs):
    return t.activity.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("company_id").alias("companies"), F.count_if(F.col("category") == "system").alias("system"))


@query("anl12_activity_listing", "SELECT id, user_id, action FROM activity WHERE company_id = 3 AND category = 'content' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50")
def anl12(t: Inputs):
    return t.activity.filter("company_id = 3 and category = 'content'").orderBy(F.desc("created_at"), F.desc("id")).offset(50).limit(50).select("id", "user_id", "action")


@query("anl13_chips", "SELECT user_id, lower(action) AS label FROM activity GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(id)) <= 4")
def anl13(t: Inputs):
    labels = t.activity.groupBy("user_id", F.lower("action").alias("label")).agg(F.min("id").alias("first"))
    return O.top_k(labels, ["user_id"], [F.col("first")], 4).select("user_id", "label")


@query("prt4_page_status", "SELECT page_id, CASE WHEN html IS NULL THEN 'no_page' WHEN trim(html) = '' THEN 'empty' WHEN contains(lower(html), 'just a moment') THEN 'blocked' WHEN NOT contains(lower(html), '<p') THEN 'no_content' ELSE 'ok' END AS status FROM pages")
def prt4(t: Inputs):
    h = F.lower("html")
    return t.pages.select("page_id", F.when(F.col("html").isNull(), "no_page").when(F.trim("html") == "", "empty").when(F.contains(h, F.lit("just a moment")), "blocked").when(~F.contains(h, F.lit("<p")), "no_content").otherwise("ok").alias("status"))


@query("prt2_to_parse", "SELECT p_partkey AS k, CASE WHEN s.k IS NULL THEN 'new' ELSE 'changed' END AS why FROM part LEFT JOIN (SELECT p_partkey AS k, p_size AS size, p_partkey % 9 AS mtime FROM part WHERE p_partkey % 6 <> 0) s ON s.k = p_partkey WHERE s.k IS NULL OR s.size <> p_size OR s.mtime <> p_partkey % 8")
def prt2(t: Inputs):
    now = t.part.select(F.col("p_partkey").alias("k"), "p_size", (F.col("p_partkey") % 8).alias("mtime"))
    seen = t.part.filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("_size"), (F.col("p_partkey") % 9).alias("_mtime"))
    j = now.join(seen, "k", "left").withColumn("why", F.when(F.col("_size").isNull(), "new").when((F.col("p_size") != F.col("_size")) | (F.col("mtime") != F.col("_mtime")), "changed"))
    return j.filter("why is not null").select("k", "why")


@query("prt5_gates", "SELECT p_brand, count(*) AS rows, count(*) FILTER (p_size = 0) AS zero_sizes, count(*) - count(DISTINCT p_name) AS repeated, count(*) FILTER (p_retailprice <= 0) AS unpriced, count(*) FILTER (p_size = 0) = 0 AND count(*) FILTER (p_retailprice <= 0) = 0 AS passes FROM part GROUP BY 1")
def prt5(t: Inputs):
    zero, unpriced = F.count_if(F.col("p_size") == 0), F.count_if(F.col("p_retailprice") <= 0)
    return t.part.groupBy("p_brand").agg(F.count("*").alias("rows"), zero.alias("zero_sizes"), (F.count("*") - F.countDistinct("p_name")).alias("repeated"), unpriced.alias("unpriced"), ((zero == 0) & (unpriced == 0)).alias("passes"))


@query("trm3_dictionary_export", "SELECT term, translated FROM (SELECT lower(p_type) AS term, p_brand AS translated, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1 ORDER BY term")
def trm3(t: Inputs):
    best = O.top_k(t.part.withColumn("term", F.lower("p_type")), ["term"], [F.desc("p_size"), F.col("p_partkey")], 1)
    return best.select("term", F.col("p_brand").alias("translated")).orderBy("term")


@query("trm5_queue_states", "WITH q AS (SELECT DISTINCT lower(p_type) AS term FROM part WHERE p_size < 20), s AS (SELECT DISTINCT lower(p_type) AS term, 'done' AS state FROM part WHERE p_size > 40) SELECT coalesce(s.state, 'waiting') AS state, count(*) AS n FROM q FULL JOIN s USING (term) GROUP BY 1")
def trm5(t: Inputs):
    queue = t.part.filter("p_size < 20").select(F.lower("p_type").alias("term")).distinct()
    stored = t.part.filter("p_size > 40").select(F.lower("p_type").alias("term"), F.lit("done").alias("state")).distinct()
    return queue.join(stored, "term", "full_outer").groupBy(F.coalesce("state", F.lit("waiting")).alias("state")).agg(F.count("*").alias("n"))


@query("trm8_lexicon", "SELECT term, meaning FROM (SELECT lower(p_name) AS term, p_brand AS meaning, CASE WHEN p_size > 30 THEN 0 WHEN p_size > 15 THEN 1 ELSE 2 END AS source, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY term ORDER BY source, p_partkey) = 1")
def trm8(t: Inputs):
    source = F.when(F.col("p_size") > 30, 0).when(F.col("p_size") > 15, 1).otherwise(2)
    return O.top_k(t.part.withColumn("term", F.lower("p_name")), ["term"], [source, F.col("p_partkey")], 1).select("term", F.col("p_brand").alias("meaning"))


@query("pipe5_zip_ledger", "WITH n AS (SELECT o_orderkey AS k, o_totalprice AS size, o_orderdate AS at FROM orders), l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size, o_orderdate + INTERVAL (o_orderkey % 4) SECOND AS at FROM orders WHERE o_orderkey % 3 <> 0) SELECT n.k, l.k IS NOT NULL AND n.size = l.size AND abs(epoch(n.at) - epoch(l.at)) <= 1 AS known FROM n LEFT JOIN l USING (k)")
def pipe5(t: Inputs):
    now = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("size"), O.seconds("o_orderdate").alias("at"))
    ledger = t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.expr("if(o_orderkey % 10 = 0, o_totalprice + 1, o_totalprice)").alias("_size"), (O.seconds("o_orderdate") + F.col("o_orderkey") % 4).alias("_at"))
    same = (F.col("size") == F.col("_size")) & (F.abs(F.col("at") - F.col("_at")) <= 1)
    return now.join(ledger, "k", "left").select("k", F.coalesce(same, F.lit(False)).alias("known"))


@query("misc30_recent_events", "SELECT id, action FROM (SELECT id, action FROM activity ORDER BY id DESC LIMIT 40) ORDER BY id")
def misc30(t: Inputs):
    return t.activity.orderBy(F.desc("id")).limit(40).orderBy("id").select("id", "action")


@query("misc7_rollup", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS passed, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag = 'R') = 0 AS pass FROM lineitem GROUP BY 1")
def misc7(t: Inputs):
    passed, failed = F.count_if(F.col("l_returnflag") == "N"), F.count_if(F.col("l_returnflag") == "R")
    return t.lineitem.groupBy("l_suppkey").agg(passed.alias("passed"), failed.alias("failed"), ((passed > 0) & (failed == 0)).alias("pass"))


@query("misc10_log_check", "SELECT a.id, CASE WHEN g.app_url IS NULL THEN 'no_access' ELSE 'ok' END AS verdict FROM activity a LEFT JOIN (SELECT DISTINCT company_id, app_url FROM activity WHERE action = 'purchase') g USING (company_id, app_url)")
def misc10(t: Inputs):
    access = t.activity.filter("action = 'purchase'").select("company_id", "app_url", F.lit(True).alias("_ok")).distinct()
    return t.activity.join(access, ["company_id", "app_url"], "left").select("id", F.when(F.col("_ok"), "ok").otherwise("no_access").alias("verdict"))


@query("misc14_spec_block", "SELECT p_partkey, 'brand: ' || p_brand || chr(10) || 'type: ' || p_type || chr(10) || 'size: ' || p_size::VARCHAR AS block FROM part")
def misc14(t: Inputs):
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))
    lines = F.slice(F.array_compact(F.array(line("brand", "p_brand"), line("type", "p_type"), line("size", "p_size"))), 1, 15)
    return t.part.select("p_partkey", F.array_join(lines, "\n").alias("block"))


@query("misc15_spec_coverage", "SELECT count(*) AS cars, count(*) FILTER (content IS NOT NULL) AS with_content, count(*) FILTER (parent_id IS NOT NULL) AS with_parent, count(*) FILTER (content IS NULL AND parent_id IS NOT NULL) AS stale FROM nodes")
def misc15(t: Inputs):
    has = lambda c: F.col(c).isNotNull()
    return t.nodes.agg(F.count("*").alias("cars"), F.count_if(has("content")).alias("with_content"), F.count_if(has("parent_id")).alias("with_parent"), F.count_if(~has("content") & has("parent_id")).alias("stale"))


@query("misc34_freshness", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ok' WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'old' ELSE 'ok' END AS state FROM orders")
def misc34(t: Inputs):
    state = F.when(F.col("o_orderstatus") == "P", "ok").when(F.col("o_orderkey") % 13 == 0, "failed").when(F.col("o_orderdate") < F.expr("timestamp_ntz'1995-01-01 00:00:00'"), "old").otherwise("ok")
    return t.orders.select("o_orderkey", state.alias("state"))


@query("evl15_reviewers", "WITH a AS (SELECT l_orderkey AS item, max(l_returnflag = 'R') AS yes FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS item, max(l_linestatus = 'F') AS yes FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1) SELECT count(*) AS items, round(avg(a.yes::INT), 6) AS first, round(avg(b.yes::INT), 6) AS second, round(avg((a.yes = b.yes)::INT), 6) AS agree FROM a JOIN b USING (item)")
def evl15(t: Inputs):
    sheet = lambda rows, test, name: t.lineitem.filter(rows).groupBy(F.col("l_orderkey").alias("item")).agg(F.bool_or(F.expr(test)).cast("int").alias(name))
    both = sheet("l_linenumber <= 3", "l_returnflag = 'R'", "a").join(sheet("l_linenumber >= 2", "l_linestatus = 'F'", "b"), "item")
    return both.agg(F.count("*").alias("items"), F.round(F.avg("a"), 6).alias("first"), F.round(F.avg("b"), 6).alias("second"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("agree"))


@query("evl17_suite", "SELECT l_shipmode AS system, metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, unnest(['hit', 'price']) AS metric, unnest([CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0 END, l_discount::DOUBLE]) AS v FROM lineitem) GROUP BY 1, 2")
def evl17(t: Inputs):
    pairs = F.array(F.struct(F.lit("hit").alias("metric"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("v")), F.struct(F.lit("price").alias("metric"), F.col("l_discount").cast("double").alias("v")))
    return t.lineitem.select(F.col("l_returnflag").alias("system"), F.inline(pairs)).groupBy("system", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


@query("evl18_unsupported_numbers", "WITH a AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(text, '[0-9]+')))) AS said FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1), u AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(text, '[0-9]+')))) AS known FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1) SELECT conv_id, len(list_filter(said, lambda x: NOT list_contains(coalesce(known, []), x)))::INT AS unsupported FROM a LEFT JOIN u USING (conv_id)")
def evl18(t: Inputs):
    numbers = lambda role, name: t.conversations.filter((F.col("role") == role) & F.col("text").isNotNull()).select("conv_id", F.explode_outer(F.regexp_extract_all("text", F.lit("([0-9]+)"))).alias("x")).groupBy("conv_id").agg(F.collect_set("x").alias(name))
    j = numbers("assistant", "said").join(numbers("user", "known"), "conv_id", "left")
    return j.select("conv_id", F.size(F.array_except("said", F.coalesce("known", F.array().cast("array<string>")))).alias("unsupported"))


@query("evl20_click_gold", "SELECT lower(app_url) AS query, list_sort(list(DISTINCT user_id)) AS relevant FROM activity WHERE action = 'click' GROUP BY 1 HAVING count(DISTINCT user_id) >= 2")
def evl20(t: Inputs):
    return t.activity.filter("action = 'click'").groupBy(F.lower("app_url").alias("query")).agg(F.sort_array(F.collect_set("user_id")).alias("relevant")).filter(F.size("relevant") >= 2)


@query("txt46_jalali", """WITH d AS (SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01') + 2440588 - 2121445 AS days FROM orders),
c AS (SELECT o_orderkey, days, days // 1029983 AS cycle, days % 1029983 AS rest FROM d),
y AS (SELECT *, CASE WHEN rest = 1029982 THEN 2820 ELSE (2134 * (rest // 366) + 2816 * (rest % 366) + 2815) // 1028522 + rest // 366 + 1 END + 2820 * cycle + 474 AS year FROM c),
n AS (SELECT *, days - (((474 + (year - 474) % 2820) * 682 - 110) // 2816 + (474 + (year - 474) % 2820 - 1) * 365 + ((year - 474) // 2820) * 1029983 - 173125 + 0) AS yday FROM y)
SELECT o_orderkey, translate(year::VARCHAR || '/' || lpad((CASE WHEN yday <= 186 THEN (yday + 30) // 31 ELSE (yday - 6 + 29) // 30 END)::VARCHAR, 2, '0') || '/' || lpad((CASE WHEN yday <= 186 THEN (yday - 1) % 31 + 1 ELSE (yday - 187) % 30 + 1 END)::VARCHAR, 2, '0'), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS jalali FROM n""")
def txt46(t: Inputs):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01")) + 2440588 - 2121445
    c = t.orders.select("o_orderkey", days.cast("long").alias("days")).select("*", F.expr("days div 1029983").alias("cycle"), F.expr("days % 1029983").alias("rest"))
    y = c.withColumn("year", F.expr("if(rest = 1029982, 2820, (2134 * (rest div 366) + 2816 * (rest % 366) + 2815) div 1028522 + rest div 366 + 1) + 2820 * cycle + 474"))
    n = y.withColumn("yday", F.expr("days - (((474 + (year - 474) % 2820) * 682 - 110) div 2816 + (474 + (year - 474) % 2820 - 1) * 365 + ((year - 474) div 2820) * 1029983 - 173125)"))
    month, day = F.expr("if(yday <= 186, (yday + 30) div 31, (yday - 6 + 29) div 30)"), F.expr("if(yday <= 186, (yday - 1) % 31 + 1, (yday - 187) % 30 + 1)")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return n.select("o_orderkey", F.translate(F.concat_ws("/", F.col("year").cast("string"), two(month), two(day)), "0123456789", "۰۱۲۳۴۵۶۷۸۹").alias("jalali"))


@query("txt33_section_titles", "SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower('Body/' || p_type || ' and ' || p_brand), '/', '⁄'), '\\band\\b', '&', 'g'), '\\s+', ' ', 'g')) AS title FROM part")
def txt33(t: Inputs):
    raw = F.concat(F.lit("Body/"), "p_type", F.lit(" and "), "p_brand")
    return t.part.select("p_partkey", F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(raw), F.lit("/"), F.lit("⁄")), "\\band\\b", "&"), "\\s+", " ")).alias("title"))


@query("txt12_taxonomy", _WALK + "SELECT id, path[1] AS system, path[2] AS subsystem, CASE WHEN len(path) > 2 THEN path[len(path)] END AS component FROM walk")
def txt12(t: Inputs):
    at = lambda i: F.get("path", F.lit(i))
    return H.ancestor_paths(t.nodes).select("id", at(0).alias("system"), at(1).alias("subsystem"), F.when(F.size("path") > 2, F.element_at("path", -1)).alias("component"))


@query("txt43_ambiguity_roots", "WITH r AS (SELECT user_id, app_url, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, id) AS rank FROM activity) SELECT user_id, list_sort(list(DISTINCT app_url)) AS roots FROM r WHERE rank <= 4 GROUP BY 1 HAVING count(DISTINCT app_url) > 1")
def txt43(t: Inputs):
    top = O.top_k(t.activity, ["user_id"], [F.desc("value"), F.col("id")], 4)
    return top.groupBy("user_id").agg(F.sort_array(F.collect_set("app_url")).alias("roots")).filter(F.size("roots") > 1)


@query("evl8_bootstrap_interval")
def evl8(t: Inputs):
    return E.bootstrap(t.lineitem, "l_returnflag", F.col("l_discount")).drop("p")


@query("evl9_paired_bootstrap")
def evl9(t: Inputs):
    return E.bootstrap(t.lineitem, "l_returnflag", F.col("l_discount") - F.col("l_tax")).select("l_returnflag", "n", "mean", "p")
