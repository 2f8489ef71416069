"""Filters, counts and other grouped results over the logs and tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as L
from .inputs import Inputs
from .registry import query

AS_OF = "2024-01-31 00:00:00"


@query("flt1_time_range", f"SELECT id, action, created_at FROM activity WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '{AS_OF}'")
def flt1(t: Inputs):
    return L.time_range(t.activity, "created_at", AS_OF, 7).select("id", "action", "created_at")


@query("flt2_optional_filters", "SELECT id, company_id, action FROM activity WHERE company_id = 3 AND category = 'content'")
def flt2(t: Inputs):
    return L.optional_equals(t.activity, {"action": {"view", "click"}}, company_id=3, category="content", user_id=None, action="unknown").select("id", "company_id", "action")


@query("flt3_not_blank", "SELECT id, session_id FROM chat WHERE session_id IS NOT NULL AND session_id <> '' AND NOT degraded")
def flt3(t: Inputs):
    return L.not_blank(t.chat, "session_id").filter(~F.col("degraded")).select("id", "session_id")


@query("flt4_prefix_in", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'PROMO') OR p_size IN (1, 5, 9)")
def flt4(t: Inputs):
    return t.part.filter(F.col("p_type").startswith("PROMO") | F.col("p_size").isin(1, 5, 9)).select("p_partkey", "p_name")


@query("flt5_literal_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion%') OR contains(lower(text), 'the and')")
def flt5(t: Inputs):
    return t.documents.filter(L.contains_literal(F.col("text"), "Tion%") | L.contains_literal(F.col("text"), "the and")).select("doc_id")


@query("flt6_search_with_children", "SELECT id FROM ticket WHERE contains(lower(priority), 'urgent') OR id IN (SELECT request_id FROM message WHERE author_id = 7)")
def flt6(t: Inputs):
    own = t.ticket.filter(L.contains_literal(F.col("priority"), "urgent")).select("id")
    return own.unionByName(t.message.filter("author_id = 7").select(F.col("request_id").alias("id"))).join(t.ticket.select("id"), "id", "left_semi").distinct()


@query("flt7_sla_breached", "SELECT id FROM ticket WHERE (24 < 30 AND first_response_h IS NULL) OR (100 < 90 AND resolved_h IS NULL) OR (priority LIKE '1%' AND 8 < 30 AND resolved_h IS NULL)")
def flt7(t: Inputs):
    first = F.col("priority").startswith("1")
    return t.ticket.filter(L.sla_breached(F.lit(24), F.col("first_response_h"), F.when(first, F.lit(8)).otherwise(F.lit(100)), F.col("resolved_h"), F.lit(30))).select("id")


@query("flt8_json_predicate", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def flt8(t: Inputs):
    return t.events.filter(L.json_equals(F.col("props"), "$.k", "69")).select("event_id")


@query("flt9_visible_events", "SELECT id FROM activity WHERE category = 'system' OR user_id = 12 OR (company_id = 2 AND category = 'account')")
def flt9(t: Inputs):
    return t.activity.filter((F.col("category") == "system") | (F.col("user_id") == 12) | ((F.col("company_id") == 2) & (F.col("category") == "account"))).select("id")


@query("flt11_dead_ends", """
WITH p AS (SELECT DISTINCT parent_id AS id FROM nodes WHERE parent_id IS NOT NULL),
alive AS (SELECT * FROM nodes WHERE content IS NOT NULL OR id IN (SELECT id FROM p)),
q AS (SELECT DISTINCT parent_id AS id FROM alive WHERE parent_id IS NOT NULL)
SELECT id, title FROM alive WHERE content IS NOT NULL OR id IN (SELECT id FROM q)""")
def flt11(t: Inputs):
    return L.hide_dead_ends(t.nodes).select("id", "title")


@query("flt13_nav_projection", "SELECT id, parent_id, title, content IS NOT NULL AS has_content FROM nodes")
def flt13(t: Inputs):
    return t.nodes.withColumn("has_content", F.col("content").isNotNull()).select("id", "parent_id", "title", "has_content")


@query("flt15_nul_guard", "SELECT count(*) AS n, count(*) FILTER (contains(text, chr(0))) AS with_nul FROM documents")
def flt15(t: Inputs):
    return t.documents.agg(F.count("*").alias("n"), F.count_if(F.instr("text", "\0") > 0).alias("with_nul"))


@query("agg1_count_by", "SELECT action, category, count(*) AS n FROM activity GROUP BY action, category")
def agg1(t: Inputs):
    return A.count_by(t.activity, "action", "category")


@query("agg2_top_counts", "SELECT app_url, count(*) AS n, count(DISTINCT user_id) AS users, max(created_at) AS last FROM activity GROUP BY app_url ORDER BY n DESC, app_url LIMIT 5")
def agg2(t: Inputs):
    return A.top_counts(t.activity, "app_url", "user_id", "created_at", 5)


@query("agg3_conditional_counts", "SELECT user_id, count(*) AS n, count(*) FILTER (grounded) AS grounded, count(*) FILTER (degraded) AS degraded, count(*) FILTER (feedback > 0) AS liked FROM chat GROUP BY user_id")
def agg3(t: Inputs):
    return t.chat.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("grounded").alias("grounded"), F.count_if("degraded").alias("degraded"), F.count_if(F.col("feedback") > 0).alias("liked"))


@query("agg4_endpoint_rollup", """
SELECT endpoint, sum(requests)::BIGINT AS requests, sum(errors_4xx)::BIGINT AS errors_4xx, sum(errors_5xx)::BIGINT AS errors_5xx, sum(total_ms)::BIGINT AS total_ms, max(max_ms) AS max_ms,
round(sum(total_ms)::DOUBLE / nullif(sum(requests)::DOUBLE, 0), 4) AS avg_ms, round(sum(errors_5xx)::DOUBLE / nullif(sum(requests)::DOUBLE, 0), 6) AS error_rate FROM traffic GROUP BY endpoint""")
def agg4(t: Inputs):
    return A.endpoint_rollup(t.traffic)


@query("agg5_daily", "SELECT created_at::DATE AS day, count(*) AS n FROM activity GROUP BY 1")
def agg5(t: Inputs):
    return A.daily(t.activity, "created_at")


@query("agg6_zero_filled", "SELECT r.r_name AS category, coalesce(n, 0) AS n FROM (SELECT r_name FROM region UNION SELECT DISTINCT category FROM activity) r LEFT JOIN (SELECT category, count(*) AS n FROM activity GROUP BY 1) a ON a.category = r.r_name")
def agg6(t: Inputs):
    dimension = t.region.select(F.col("r_name").alias("category")).union(t.activity.select("category")).distinct()
    return A.zero_filled(t.activity, dimension, "category")


@query("agg7_having", "SELECT user_id, count(*) AS n FROM activity WHERE action = 'error' GROUP BY user_id HAVING count(*) >= 5")
def agg7(t: Inputs):
    return A.count_by(t.activity.filter("action = 'error'"), "user_id").filter("n >= 5")


@query("agg8_active_days", "SELECT user_id, count(DISTINCT created_at::DATE) AS days FROM activity GROUP BY user_id HAVING count(DISTINCT created_at::DATE) >= 3")
def agg8(t: Inputs):
    return A.active_days(t.activity, "user_id", "created_at", 3)


@query("agg9_case_folded", "SELECT lower(l_shipmode) AS key, min(l_shipmode) AS display, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN upper(l_returnflag || l_linestatus) ELSE lower(l_returnflag || l_linestatus) END AS l_shipmode FROM lineitem) GROUP BY 1")
def agg9(t: Inputs):
    flag = F.concat("l_returnflag", "l_linestatus")
    return A.case_folded(t.lineitem.select(F.when(F.col("l_orderkey") % 2 == 0, F.upper(flag)).otherwise(F.lower(flag)).alias("q")), "q")


@query("agg10_distinct_concat", "SELECT car_stem, string_agg(b, ',' ORDER BY b) AS values FROM (SELECT DISTINCT car_stem, brand AS b FROM occurrences) GROUP BY car_stem")
def agg10(t: Inputs):
    return A.distinct_concat(t.occurrences, "car_stem", "brand")


@query("agg11_sessions", "SELECT user_id, count(DISTINCT nullif(session_id, '')) + count(*) FILTER (coalesce(session_id, '') = '') AS sessions FROM chat GROUP BY user_id")
def agg11(t: Inputs):
    return t.chat.groupBy("user_id").agg(A.sessions("session_id").alias("sessions"))


@query("agg12_percentiles", "SELECT user_id, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.9) AS p90 FROM chat GROUP BY user_id")
def agg12(t: Inputs):
    return t.chat.groupBy("user_id").agg(A.nearest_rank("latency_ms", 0.5).cast("long").alias("p50"), A.nearest_rank("latency_ms", 0.9).cast("long").alias("p90"))


@query("agg13_grouping_sets", "SELECT created_at::DATE AS day, company_id, action, count(*) AS n FROM activity GROUP BY GROUPING SETS ((created_at::DATE), (company_id), (action), ())")
def agg13(t: Inputs):
    days = t.activity.withColumn("day", F.to_date("created_at"))
    return days.groupingSets([["day"], ["company_id"], ["action"], []], "day", "company_id", "action").agg(F.count("*").alias("n"))


@query("agg14_decayed_votes", f"""
WITH w AS (SELECT id % 97 AS blob, feedback, pow(0.5, greatest(0.0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 1e6) / 86400.0) / 45.0) AS w FROM chat)
SELECT blob, round(coalesce(sum(w) FILTER (feedback > 0), 0), 6) AS up, round(coalesce(sum(w) FILTER (feedback < 0), 0), 6) AS down, count(*) FILTER (feedback <> 0) AS total FROM w GROUP BY blob""")
def agg14(t: Inputs):
    return A.decayed_votes(t.chat.withColumn("blob", F.col("id") % 97), "blob", "feedback", "created_at", AS_OF, 45)


@query("agg15_argmax", "SELECT company_id, min(id) FILTER (price = m) AS id, any_value(m) AS price FROM (SELECT *, max(price) OVER (PARTITION BY company_id) AS m FROM ticket) GROUP BY company_id")
def agg15(t: Inputs):
    return A.argmax(t.ticket, "company_id", "id", "price")


@query("agg16_merged_rollups", "SELECT endpoint, bucket, sum(requests)::BIGINT AS requests, max(max_ms) AS max_ms FROM traffic GROUP BY endpoint, bucket")
def agg16(t: Inputs):
    part = lambda c: t.traffic.filter(c).groupBy("endpoint", "bucket").agg(F.sum("requests").alias("requests"), F.max("max_ms").alias("max_ms"))
    return A.merged_rollups(part("user_id % 2 = 0"), part("user_id % 2 <> 0"), ["endpoint", "bucket"], ["requests"], ["max_ms"])


@query("agg17_first_non_blank", "SELECT user_id, arg_min(session_id, id) FILTER (session_id <> '') AS first_session, count(*) AS n FROM chat GROUP BY user_id")
def agg17(t: Inputs):
    return t.chat.groupBy("user_id").agg(F.min_by(F.nullif("session_id", F.lit("")), F.when(F.col("session_id") != "", F.col("id"))).alias("first_session"), F.count("*").alias("n"))


@query("agg18_fingerprint", """
WITH l AS (SELECT source, doc_id || '|' || length(text) AS line FROM documents),
p AS (SELECT source, sha1(line)[1:2] AS r, sha1(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM l GROUP BY 1, 2)
SELECT source, sha1(string_agg(digest, chr(10) ORDER BY r)) AS fingerprint, sum(n)::BIGINT AS n FROM p GROUP BY source""")
def agg18(t: Inputs):
    return A.fingerprint(t.documents, "source", "doc_id", F.length("text"))


@query("agg19_section_rollup", "SELECT section, count(*) AS nodes, count(*) FILTER (length(content) > 0) AS leaves, sum(length(content))::BIGINT AS chars FROM sections GROUP BY section")
def agg19(t: Inputs):
    return t.sections.groupBy("section").agg(F.count("*").alias("nodes"), F.count_if(F.length("content") > 0).alias("leaves"), F.sum(F.length("content")).alias("chars"))


@query("agg20_degree_centrality", "SELECT src_blob, count(*) AS degree, round(count(*) / (count(*) + 8)::DOUBLE, 6) AS centrality FROM edges GROUP BY src_blob")
def agg20(t: Inputs):
    return A.degree_centrality(t.edges, "src_blob")


@query("agg21_term_frequencies", """
WITH t AS (SELECT blob_id, 'title' AS f, unnest(string_split(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) AS term FROM blobs
UNION ALL SELECT blob_id, 'comp', unnest(string_split(trim(regexp_replace(lower(component), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')) FROM blobs)
SELECT blob_id, term, count(*) FILTER (f = 'title') AS tf_title, count(*) FILTER (f = 'comp') AS tf_comp FROM t WHERE term <> '' GROUP BY blob_id, term""")
def agg21(t: Inputs):
    return A.term_frequencies(t.blobs, "blob_id", {"title": "title", "comp": "component"})


@query("agg23_coverage_curve", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS rank, round(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS covered FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def agg23(t: Inputs):
    return A.coverage_curve(A.count_by(t.documents, "source"), "source", "n")


@query("agg24_safe_ratio", "SELECT company_id, round(count(csat) / nullif(count(*) FILTER (status = 'F'), 0)::DOUBLE, 6) AS rated_per_closed FROM ticket GROUP BY company_id")
def agg24(t: Inputs):
    return t.ticket.groupBy("company_id").agg(F.round(A.ratio(F.count("csat"), F.count_if(F.col("status") == "F")), 6).alias("rated_per_closed"))


@query("agg26_cohort_share", "SELECT priority, count(*) FILTER (status = 'F') AS closed, count(*) FILTER (status = 'F' AND csat IS NOT NULL) AS rated FROM ticket GROUP BY priority")
def agg26(t: Inputs):
    closed = F.col("status") == "F"
    return t.ticket.groupBy("priority").agg(F.count_if(closed).alias("closed"), F.count_if(closed & F.col("csat").isNotNull()).alias("rated"))


@query("agg27_totals", "SELECT action, count(*) AS n, count(DISTINCT user_id) AS users FROM activity GROUP BY GROUPING SETS ((action), ())")
def agg27(t: Inputs):
    return t.activity.rollup("action").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
