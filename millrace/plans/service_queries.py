"""Helpdesk, product analytics, monitoring, governance, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import monitoring as M
from ..operators.chains import spaced
from ..operators.ordered import seconds, top_k
from ..sources import files
from ..streaming import stateful as T
from .inputs import Inputs
from .registry import query

_S = "floor(epoch_us({0}) / 1000000)::BIGINT"


@query("hlp1_awaiting_reply", "SELECT request_id, id FROM message WHERE NOT internal QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) = 1 AND from_customer")
def hlp1(t: Inputs):
    return top_k(t.message.filter("not internal"), ["request_id"], [F.desc("created_at"), F.desc("id")], 1).filter("from_customer").select("request_id", "id")


@query("hlp3_response_times", "SELECT priority, count(*) AS n, count(first_response_h) AS measured, round(avg(first_response_h), 4) AS mean_h, quantile_disc(first_response_h, 0.9) AS p90_h, count(resolved_h) AS resolved, round(avg(resolved_h), 4) AS resolved_mean_h, quantile_disc(resolved_h, 0.9) AS resolved_p90_h FROM ticket GROUP BY priority")
def hlp3(t: Inputs):
    block = lambda c, n, mean, p90: [F.count(c).alias(n), F.round(F.avg(c), 4).alias(mean), A.nearest_rank(c, 0.9).cast("long").alias(p90)]
    return t.ticket.groupBy("priority").agg(F.count("*").alias("n"), *block("first_response_h", "measured", "mean_h", "p90_h"), *block("resolved_h", "resolved", "resolved_mean_h", "resolved_p90_h"))


@query("hlp5_satisfaction", "SELECT s.csat, coalesce(n, 0) AS n FROM (SELECT unnest([1, 2, 3, 4, 5])::INT AS csat) s LEFT JOIN (SELECT csat, count(*) AS n FROM ticket WHERE csat IS NOT NULL GROUP BY csat) USING (csat)")
def hlp5(t: Inputs):
    scale = t.ticket.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("csat"))
    return A.zero_filled(t.ticket.filter("csat is not null"), scale, "csat")


@query("hlp4_compliance", "SELECT priority, count(*) FILTER (first_response_h <= 24) AS met, count(*) FILTER (first_response_h > 24) AS breached, round(count(*) FILTER (first_response_h <= 24) / nullif(count(first_response_h), 0)::DOUBLE, 6) AS compliance FROM ticket GROUP BY priority")
def hlp4(t: Inputs):
    met, late = F.count_if(F.col("first_response_h") <= 24), F.count_if(F.col("first_response_h") > 24)
    return t.ticket.groupBy("priority").agg(met.alias("met"), late.alias("breached"), F.round(A.ratio(met, met + late), 6).alias("compliance"))


@query("anl3_search_insights", "SELECT app_url, count(*) AS n, count(*) FILTER (value < 10) AS empty, round(count(*) FILTER (value < 10) / count(*)::DOUBLE, 6) AS empty_rate FROM activity WHERE action = 'view' GROUP BY app_url")
def anl3(t: Inputs):
    none = F.count_if(F.col("value") < 10)
    return t.activity.filter("action = 'view'").groupBy("app_url").agg(F.count("*").alias("n"), none.alias("empty"), F.round(A.ratio(none, F.count("*")), 6).alias("empty_rate"))


@query("anl4_funnel", "SELECT 1 AS stage, 'all' AS name, count(DISTINCT user_id) AS users FROM activity UNION ALL SELECT 2, 'signed up', count(DISTINCT user_id) FROM activity WHERE action = 'signup' UNION ALL SELECT 3, 'bought', count(DISTINCT user_id) FROM activity WHERE action = 'purchase' UNION ALL SELECT 4, 'back on three days', count(*) FROM (SELECT user_id FROM activity GROUP BY user_id HAVING count(DISTINCT created_at::DATE) >= 3)")
def anl4(t: Inputs):
    per_user = t.activity.groupBy("user_id").agg(F.bool_or(F.col("action") == "signup").alias("signup"), F.bool_or(F.col("action") == "purchase").alias("bought"), F.countDistinct(F.to_date("created_at")).alias("days"))
    one = per_user.agg(F.count("*").alias("a"), F.count_if("signup").alias("b"), F.count_if("bought").alias("c"), F.count_if(F.col("days") >= 3).alias("d"))
    return one.selectExpr("stack(4, 1, 'all', a, 2, 'signed up', b, 3, 'bought', c, 4, 'back on three days', d) as (stage, name, users)")


@query("anl9_traffic", "SELECT coalesce(a.day, b.day) AS day, requests, uniques FROM (SELECT bucket::DATE AS day, sum(requests)::BIGINT AS requests FROM traffic WHERE endpoint <> 'signup' GROUP BY 1) a FULL JOIN (SELECT created_at::DATE AS day, count(DISTINCT user_id) AS uniques FROM activity WHERE action = 'error' GROUP BY 1) b ON a.day = b.day")
def anl9(t: Inputs):
    a = t.traffic.filter("endpoint <> 'signup'").groupBy(F.to_date("bucket").alias("day")).agg(F.sum("requests").alias("requests"))
    b = t.activity.filter("action = 'error'").groupBy(F.to_date("created_at").alias("day")).agg(F.countDistinct("user_id").alias("uniques"))
    return a.join(b, "day", "full_outer")


@query("anl7_ab_arms", "SELECT arm, count(*) AS n, count(*) FILTER (liked) AS liked, round(count(*) FILTER (liked) / count(*)::DOUBLE, 6) AS rate FROM (SELECT CASE WHEN (('0x' || substr(sha256('arm:' || user_id), 1, 8))::BIGINT % 100) < 50 THEN 'a' ELSE 'b' END AS arm, feedback > 0 AS liked FROM chat) GROUP BY arm")
def anl7(t: Inputs):
    from ..functions.scalars import bucket

    rows = t.chat.select(F.when(bucket("arm", F.col("user_id")) < 50, "a").otherwise("b").alias("arm"), (F.col("feedback") > 0).alias("liked"))
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("liked").alias("liked"), F.round(A.ratio(F.count_if("liked"), F.count("*")), 6).alias("rate"))


@query("anl7_ab_test")
def anl7_test(t: Inputs):
    from ..operators.evaluation import two_proportions

    arms = anl7(t).groupBy().pivot("arm", ["a", "b"]).agg(F.first("liked").alias("x"), F.first("n").alias("n"))
    return arms.select(F.round(two_proportions(F.col("a_x"), F.col("a_n"), F.col("b_x"), F.col("b_n")), 4).alias("p"))


@query("rec3_popular_unseen", "WITH r AS (SELECT * FROM activity WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY), c AS (SELECT u.user_id, a.app_url, a.n FROM (SELECT DISTINCT user_id, company_id FROM activity) u JOIN (SELECT company_id, app_url, count(*) AS n FROM r WHERE action = 'view' GROUP BY 1, 2) a USING (company_id) WHERE NOT EXISTS (SELECT 1 FROM activity s WHERE s.user_id = u.user_id AND s.app_url = a.app_url)) SELECT user_id, app_url, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, app_url) AS rank FROM c) WHERE rank <= 5")
def rec3(t: Inputs):
    users = t.activity.select("user_id", "company_id").distinct()
    recent = t.activity.filter(F.col("created_at") >= F.expr("timestamp_ntz'2024-01-31 00:00:00' - interval 30 days"))
    popular = recent.filter("action = 'view'").groupBy("company_id", "app_url").agg(F.count("*").alias("n"))
    unseen = users.join(popular, "company_id").join(t.activity.select("user_id", "app_url"), ["user_id", "app_url"], "left_anti")
    return top_k(unseen, ["user_id"], [F.desc("n"), F.col("app_url")], 5).select("user_id", "app_url", "n", "rank")


@query("mon1_error_rate", "WITH g AS (SELECT endpoint, bucket::DATE AS day, sum(requests)::BIGINT AS n, sum(errors_5xx)::BIGINT AS e, sum(total_ms) / sum(requests)::DOUBLE AS mean_ms FROM traffic GROUP BY 1, 2) SELECT endpoint, day, 'errors' AS rule FROM g WHERE n >= 50 AND e / n::DOUBLE >= 0.05 UNION ALL SELECT endpoint, day, 'latency' FROM g WHERE n >= 10 AND mean_ms >= 500")
def mon1(t: Inputs):
    return M.service_rules(t.traffic.withColumn("day", F.to_date("bucket")), ["endpoint", "day"], latency_ms=500)


@query("mon3_bursts", f"SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY {_S.format('created_at')} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM activity) GROUP BY user_id HAVING max(n) >= 8")
def mon3(t: Inputs):
    return M.bursts(t.activity, "user_id", "created_at", 86400, 8)


@query("mon5_cost_spikes", "WITH d AS (SELECT created_at::DATE AS day, sum(value) AS cost FROM activity GROUP BY 1), w AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) / 7 AS before FROM d) SELECT day, round(cost, 4) AS cost, round(before, 4) AS before FROM w WHERE cost >= 1.05 * before AND cost >= 100")
def mon5(t: Inputs):
    return M.cost_spikes(t.activity, "created_at", "value", 1.05, 100.0)


@query("mon7_alert_states", "WITH f AS (SELECT DISTINCT 'u' || user_id AS key FROM activity WHERE action = 'error' AND created_at >= TIMESTAMP '2024-01-15'), o AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'u' ELSE 'x' END || user_id AS key FROM activity WHERE action = 'error' AND created_at < TIMESTAMP '2024-01-15') SELECT coalesce(f.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'opened' WHEN f.key IS NOT NULL THEN 'refreshed' WHEN starts_with(o.key, 'u') THEN 'resolved' ELSE 'kept' END AS state FROM f FULL JOIN o ON f.key = o.key")
def mon7(t: Inputs):
    errors = t.activity.filter("action = 'error'")
    f = errors.filter("created_at >= timestamp_ntz'2024-01-15'").select(F.concat(F.lit("u"), "user_id").alias("key")).distinct()
    o = errors.filter("created_at < timestamp_ntz'2024-01-15'").select(F.concat(F.when(F.col("user_id") % 2 == 0, "u").otherwise("x"), "user_id").alias("key")).distinct()
    return M.alert_states(f, o, "u")


#: The chain of rows that lie a gap after the last one of it, per key: the first row, then each time the first that is late enough.
_CHAIN = """WITH RECURSIVE e AS (SELECT id, {key} AS key, created_at, floor(epoch_us(created_at) / 1000000)::BIGINT AS t FROM activity WHERE {rows}),
c AS (SELECT id, key, t FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY t, id) = 1
  UNION ALL SELECT id, key, t FROM (SELECT e.id, e.key, e.t, row_number() OVER (PARTITION BY e.key ORDER BY e.t, e.id) AS k FROM c JOIN e ON e.key = c.key AND e.t - c.t {gap}) WHERE k = 1)
"""


@query("mon8_delivered", _CHAIN.format(key="user_id", rows="action = 'error'", gap=">= 21600") + "SELECT id FROM c")
def mon8(t: Inputs):
    return M.delivered(t.activity.filter("action = 'error'"), "user_id", "created_at", "id", 21600).select("id")


@query("misc1_suppressed_notices", _CHAIN.format(key="user_id || action", rows="true", gap="> 86400") + "SELECT id FROM activity WHERE id NOT IN (SELECT id FROM c)")
def misc1(t: Inputs):
    sent = spaced(t.activity, ["user_id", "action"], seconds("created_at"), "id", 86400)
    return t.activity.join(sent, "id", "left_anti").select("id")


@query("jn18_recorded_searches", _CHAIN.format(key="user_id || app_url", rows="true", gap="> 60") + "SELECT id FROM c")
def jn18(t: Inputs):
    return spaced(t.activity, ["user_id", "app_url"], seconds("created_at"), "id", 60)


@query("mon10_newest_kept", "SELECT id FROM activity ORDER BY id DESC LIMIT 20000")
def mon10(t: Inputs):
    return M.newest_kept(t.activity, "id", 20_000).select("id")


@query("str11_change_events", "SELECT id, action, before FROM (SELECT id, action, lag(action) OVER (PARTITION BY user_id ORDER BY created_at, id) AS before FROM activity) WHERE before <> action")
def str11(t: Inputs):
    return M.change_events(t.activity, "user_id", "created_at", "id", "action").select("id", "action", "before")


@query("str7_content_guard", f"SELECT id, CASE WHEN n > 5 THEN 'block' WHEN n = 5 THEN 'warn' ELSE 'pass' END AS state FROM (SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY {_S.format('created_at')} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM activity)")
def str7(t: Inputs):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("user_id").orderBy(seconds("created_at")).rangeBetween(-86400, 0))
    return t.activity.select("id", F.when(n > 5, "block").when(n == 5, "warn").otherwise("pass").alias("state"))


@query("str4_hourly_rollup", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str4(t: Inputs):
    rows = T.table_stream(t._spark, t._folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.drained(T.hourly_rollup(rows, "ts", ["event_type"]), "complete", "hourly").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("str5_daily_uniques", "SELECT DISTINCT ts::DATE AS day, user_id FROM events")
def str5(t: Inputs):
    return T.drained(T.daily_uniques(T.table_stream(t._spark, t._folder, "events"), "ts", "user_id"), "append", "uniques")


@query("str6_rate_limit")
def str6(t: Inputs):
    rows = T.table_stream(t._spark, t._folder, "events").withColumn("t", seconds("ts").cast("double"))
    return T.drained(T.rate_limited(rows, "user_id", 3, 86400.0), "append", "limited")


@query("str8_repeats_suppressed")
def str8(t: Inputs):
    rows = T.table_stream(t._spark, t._folder, "events").withColumn("t", seconds("ts").cast("double"))
    return T.drained(T.repeats_suppressed(rows, "user_id", 36000.0), "append", "suppressed")


@query("gov1_effective_documents", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ['manual', 'parts'] ELSE list_filter(['manual', 'wiring', 'parts'][1:(c_custkey % 4)::INT], lambda x: x IN ('manual', 'parts')) END AS documents FROM customer")
def gov1(t: Inputs):
    asked = F.slice(F.array(F.lit("manual"), F.lit("wiring"), F.lit("parts")), 1, (F.col("c_custkey") % 4).cast("int"))
    scope = F.array(F.lit("manual"), F.lit("parts"))
    return t.customer.select("c_custkey", F.when(F.size(asked) == 0, scope).otherwise(F.array_intersect(asked, scope)).alias("documents"))


@query("gov6_masked", "SELECT c_custkey, 'u' || substr(sha256(c_name), 1, 10) || '@example.invalid' AS mail, '0' || lpad((('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 1000000000)::VARCHAR, 9, '0') AS phone FROM customer")
def gov6(t: Inputs):
    digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    return t.customer.select("c_custkey", F.concat(F.lit("u"), F.substring(digest("c_name"), 1, 10), F.lit("@example.invalid")).alias("mail"), F.concat(F.lit("0"), F.lpad((F.conv(F.substring(digest("c_custkey"), 1, 8), 16, 10).cast("long") % 1000000000).cast("string"), 9, "0")).alias("phone"))


@query("set10_duplicate_names", "SELECT lower(p_type) || '/' || p_brand AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def set10_names(t: Inputs):
    return t.part.groupBy(F.concat(F.lower("p_type"), F.lit("/"), "p_brand").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@query("dq3_verdict", "WITH s AS (SELECT section, count(*) AS nodes, sum(length(content)) AS chars, md5(string_agg(md5(coalesce(content, '')), '' ORDER BY md5(coalesce(content, '')))) AS print FROM sections GROUP BY section), f AS (SELECT print, min(section) AS first FROM s GROUP BY 1) SELECT section, CASE WHEN coalesce(chars, 0) = 0 THEN 'corrupt' WHEN section <> first THEN 'duplicate' WHEN nodes < 10 THEN 'incomplete' ELSE 'complete' END AS verdict FROM s JOIN f USING (print)")
def dq3(t: Inputs):
    """The fingerprint is the sum of the contents' digests, so a large section is added up in parts and stays small."""
    h = F.md5(F.coalesce("content", F.lit("")).cast("binary"))
    g = t.sections.groupBy("section").agg(F.count("*").alias("nodes"), F.sum(F.length("content")).alias("chars"), F.struct(F.count("*"), F.sum(F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(20,0)"))).alias("print"))
    first = g.groupBy("print").agg(F.min("section").alias("first"))
    verdict = F.when(F.coalesce("chars", F.lit(0)) == 0, "corrupt").when(F.col("section") != F.col("first"), "duplicate").when(F.col("nodes") < 10, "incomplete").otherwise("complete")
    return g.join(first, "print").select("section", verdict.alias("verdict"))


@query("ml2_topic_split", "SELECT doc_id, CASE WHEN ('0x' || substr(md5(source), 1, 4))::INT % 10 = 0 THEN 'dev' ELSE 'train' END AS part FROM documents")
def ml2(t: Inputs):
    h = F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 4), 16, 10).cast("int")
    return t.documents.select("doc_id", F.when(h % 10 == 0, "dev").otherwise("train").alias("part"))


@query("misc4_one_live_request", "SELECT o_custkey, min(o_orderkey) AS first, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def misc4(t: Inputs):
    return t.orders.filter("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"))


@query("prt3_row_classes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'xref' WHEN l_quantity % 2 = 0 THEN 'counted' ELSE 'unknown' END AS kind FROM lineitem")
def prt3(t: Inputs):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(q < 5, "xref").when(q % 2 == 0, "counted").otherwise("unknown").alias("kind"))


@query("prt8_nested_payload", "SELECT n_name, n, total FROM (SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)")
def prt8(t: Inputs):
    nested = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("rows"))
    return nested.select("n_name", F.size("rows").cast("long").alias("n"), F.round(F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["c_acctbal"]), 2).alias("total"))


@query("trm2_best_display", "SELECT p_brand, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, length(p_type), p_type, p_partkey) = 1")
def trm2(t: Inputs):
    return top_k(t.part, ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.length("p_type"), F.col("p_type"), F.col("p_partkey")], 1).select("p_brand", "p_type")


@query("src13_exposition", "SELECT '# HELP events_total Events by kind' AS value UNION ALL SELECT '# TYPE events_total counter' UNION ALL SELECT 'events_total{action=\"' || action || '\",category=\"' || category || '\"} ' || round(count(*)::DOUBLE, 4)::DECIMAL(30, 4)::VARCHAR FROM activity GROUP BY action, category")
def src13(t: Inputs):
    return files.exposition_lines(A.count_by(t.activity, "category", "action"), "events_total", ["category", "action"], "n", "Events by kind", "counter")


@query("src10_json_lines", "SELECT doc_id, lang, source FROM documents")
def src10(t: Inputs):
    path = files.work_path(t._spark, "jsonl")
    files.json_lines(t.documents.select("doc_id", "lang", "source"), path)
    return files.read_json_lines(t._spark, path, "doc_id long, lang string, source string")


@query("src8_csv", "SELECT n_nationkey, n_name FROM nation")
def src8(t: Inputs):
    path = files.work_path(t._spark, "csv")
    files.write_csv_report(t.nation.select("n_nationkey", "n_name"), path)
    return files.read_csv(t._spark, path, "n_nationkey int, n_name string")


@query("src9_sql_dump", "SELECT p_name || '''s' AS first, p_type AS second FROM part")
def src9(t: Inputs):
    path = files.work_path(t._spark, "dump")
    files.sql_dump_lines(t.part.select(F.concat("p_name", F.lit("'s")).alias("a"), "p_type"), "terms", "a", "p_type").write.text(path)
    return files.read_sql_dump(t._spark, path, "terms")


@query("src6_first_by_basename", "SELECT min(url) AS path, basename FROM (SELECT url, string_split(url, '/')[-1] AS basename FROM pages) GROUP BY basename")
def src6(t: Inputs):
    return files.first_by_basename(t.pages, "url")


@query("src16_copy_check", "SELECT count(*) AS rows_before, max(o_orderkey) AS max_before, count(*) AS rows_after, max(o_orderkey) AS max_after, true AS same FROM orders")
def src16(t: Inputs):
    path = files.work_path(t._spark, "copy")
    t.orders.write.parquet(path)
    return files.table_counts(t.orders, t._spark.read.parquet(path), "o_orderkey")


@query("src18_snapshot", f"SELECT id, user_id, action, {_S.format('created_at')} AS at FROM activity")
def src18(t: Inputs):
    return t.activity.select("id", "user_id", "action", seconds("created_at").alias("at"))
