"""Diagnosis, access, recommendation, audit and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import access as G
from ..operators import aggregates as A
from ..operators import diagnosis as D
from ..operators.ordered import keep_first, seconds, top_k
from .inputs import Inputs
from .registry import query

_CODE = "('P' || lpad(({0} % 500)::VARCHAR, 4, '0'))"


@query("dia5_intents", f"""
WITH q AS (SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 THEN 'what is p ' || lpad((p_partkey % 500)::VARCHAR, 4, '0') WHEN p_partkey % 3 = 1 THEN 'replace ' || p_type ELSE 'noise from ' || p_name END AS text FROM part),
c AS (SELECT DISTINCT {_CODE.format('s_suppkey')} AS code FROM supplier),
e AS (SELECT question_id, text, CASE WHEN question_id % 3 = 0 THEN {_CODE.format('question_id')} END AS asked FROM q)
SELECT question_id, c.code, CASE WHEN c.code IS NOT NULL THEN 'code' WHEN asked IS NOT NULL THEN 'unknown_code' WHEN starts_with(text, 'replace') THEN 'repair' ELSE 'symptom' END AS intent FROM e LEFT JOIN c ON c.code = e.asked""")
def dia5(t: Inputs):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("what is p "), F.lpad((k % 500).cast("string"), 4, "0"))).when(k % 3 == 1, F.concat(F.lit("replace "), "p_type")).otherwise(F.concat(F.lit("noise from "), "p_name"))
    codes = t.supplier.select(F.concat(F.lit("P"), F.lpad((F.col("s_suppkey") % 500).cast("string"), 4, "0")).alias("code"))
    return D.intents(t.part.select(k.alias("question_id"), text.alias("text")), codes, "text").select("question_id", "code", "intent")


@query("dia8_candidates", """
WITH e AS (SELECT l_orderkey AS question_id, 'P' || (l_partkey % 40) AS code, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'direct' ELSE 'inherited' END AS source, l_discount * 10 AS strength FROM lineitem),
g AS (SELECT question_id, code, coalesce(max(strength) FILTER (source = 'table'), 0) AS t, coalesce(max(strength) FILTER (source = 'direct'), 0) AS d, coalesce(max(strength) FILTER (source = 'inherited'), 0) AS i FROM e GROUP BY 1, 2),
s AS (SELECT question_id, code, CASE WHEN t > 0 THEN 0 WHEN d > 0 THEN 1 ELSE 2 END AS tier, round(100 * t + 30 * d + i, 6) AS score FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY tier, score DESC, code) AS rank FROM s) WHERE rank <= 6""")
def dia8(t: Inputs):
    e = t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string")).alias("code"), F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "N", "direct").otherwise("inherited").alias("source"), (F.col("l_discount") * 10).alias("strength"))
    return D.code_candidates(e, 6)


@query("dia2_ordered_steps", "SELECT l_partkey AS code, l_orderkey AS position, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 99 END, l_orderkey) - 1 AS step_order FROM (SELECT l_partkey, l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)")
def dia2(t: Inputs):
    steps = t.lineitem.groupBy(F.col("l_partkey").alias("code"), F.col("l_orderkey").alias("position")).agg(F.min("l_returnflag").alias("aspect"))
    return D.ordered_steps(steps, {"R": 0, "A": 1}).select("code", "position", F.col("step_order").cast("long").alias("step_order"))


@query("dia13_coverage", """
WITH b AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem WHERE l_linenumber < 5 GROUP BY 1),
a AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem WHERE l_linenumber > 3 AND l_suppkey % 9 <> 0 GROUP BY 1)
SELECT * FROM (SELECT b.l_suppkey, CASE WHEN a.n IS NULL THEN 'missing' WHEN (b.n > 0 AND a.n = 0) OR (b.r > 0 AND a.r = 0) THEN 'emptied' WHEN a.n < b.n * 0.9 OR a.r < b.r * 0.9 THEN 'fell' END AS state FROM b LEFT JOIN a USING (l_suppkey)) WHERE state IS NOT NULL""")
def dia13(t: Inputs):
    g = lambda df: df.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return D.coverage_changes(g(t.lineitem.filter("l_linenumber < 5")), g(t.lineitem.filter("l_linenumber > 3 and l_suppkey % 9 <> 0")), "l_suppkey", ["n", "r"])


@query("fb3_common_queries", "SELECT lower(p_type) AS key, min(p_type) AS display, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3")
def fb3(t: Inputs):
    return A.case_folded(t.part, "p_type").filter("n >= 3")


@query("fb4_recent_downvotes", "SELECT id, user_id FROM chat WHERE feedback < 0 ORDER BY created_at DESC, id DESC LIMIT 25")
def fb4(t: Inputs):
    return t.chat.filter("feedback < 0").orderBy(F.desc("created_at"), F.desc("id")).limit(25).select("id", "user_id")


@query("rec1_continue_reading", "SELECT user_id, app_url FROM (SELECT user_id, app_url, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, i DESC) AS r FROM (SELECT user_id, app_url, max(created_at) AS t, max(id) AS i FROM activity WHERE category = 'content' GROUP BY 1, 2)) WHERE r <= 3")
def rec1(t: Inputs):
    last = t.activity.filter("category = 'content'").groupBy("user_id", "app_url").agg(F.max("created_at").alias("t"), F.max("id").alias("i"))
    return top_k(last, ["user_id"], [F.desc("t"), F.desc("i")], 3).select("user_id", "app_url")


@query("rec4_explore", "SELECT DISTINCT car_stem, brand FROM occurrences EXCEPT SELECT car_stem, brand FROM occurrences WHERE blob_id % 2 = 0 AND car_stem < 'car3'")
def rec4(t: Inputs):
    o = t.occurrences.select("car_stem", "brand", "blob_id")
    return o.select("car_stem", "brand").distinct().join(o.filter("blob_id % 2 = 0 and car_stem < 'car3'"), ["car_stem", "brand"], "left_anti")


@query("rec6_member_insights", "SELECT company_id, user_id, count(*) AS events, max(created_at) AS last, arg_min(category, (-c, category)) AS top_category FROM (SELECT *, count(*) OVER (PARTITION BY user_id, category) AS c FROM activity) GROUP BY 1, 2")
def rec6(t: Inputs):
    per = t.activity.groupBy("company_id", "user_id", "category").agg(F.count("*").alias("c"), F.max("created_at").alias("t"))
    return per.groupBy("company_id", "user_id").agg(F.sum("c").alias("events"), F.max("t").alias("last"), F.min_by("category", F.struct(-F.col("c"), F.col("category"))).alias("top_category"))


@query("anl1_team", "SELECT company_id, category, count(*) AS n, count(DISTINCT user_id) AS members, count(DISTINCT created_at::DATE) AS days FROM activity GROUP BY GROUPING SETS ((company_id, category), (company_id))")
def anl1(t: Inputs):
    rows = t.activity.withColumn("day", F.to_date("created_at"))
    return rows.groupingSets([["company_id", "category"], ["company_id"]], "company_id", "category").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("members"), F.countDistinct("day").alias("days"))


@query("anl5_cost", "SELECT company_id, created_at::DATE AS day, count(*) AS calls, round(sum(value), 4) AS cost, round(avg(value), 4) AS mean FROM activity WHERE value IS NOT NULL AND action <> 'error' GROUP BY 1, 2")
def anl5(t: Inputs):
    return t.activity.filter("value is not null and action <> 'error'").groupBy("company_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.avg("value"), 4).alias("mean"))


@query("anl6_behaviour", "SELECT created_at::DATE AS day, count(*) AS questions, count(DISTINCT nullif(session_id, '')) + count(*) FILTER (session_id = '') AS sessions, round(count(*) FILTER (grounded) / count(*)::DOUBLE, 6) AS grounded_rate FROM chat GROUP BY 1")
def anl6(t: Inputs):
    return t.chat.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("questions"), A.sessions("session_id").alias("sessions"), F.round(A.ratio(F.count_if("grounded"), F.count("*")), 6).alias("grounded_rate"))


@query("anl10_kpis", "SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (action = 'error') AS errors, count(DISTINCT created_at::DATE) AS days FROM activity")
def anl10(t: Inputs):
    return t.activity.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("action") == "error").alias("errors"), F.countDistinct(F.to_date("created_at")).alias("days"))


@query("anl11_page_of_log", "SELECT id, created_at, (SELECT count(*) FROM chat WHERE degraded) AS total FROM chat WHERE degraded ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def anl11(t: Inputs):
    rows = t.chat.filter("degraded")
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).offset(100).limit(50).withColumn("k", F.lit(1))
    return page.join(rows.agg(F.count("*").alias("total")).withColumn("k", F.lit(1)), "k").select("id", "created_at", "total")


@query("pipe1_pending", "SELECT DISTINCT car_stem FROM occurrences WHERE car_stem NOT IN (SELECT car_stem FROM occurrences WHERE brand = 'brand0')")
def pipe1(t: Inputs):
    return G.pending(t.occurrences, t.occurrences.filter("brand = 'brand0'"), "car_stem")


@query("pipe3_registrations", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'unrecognised' WHEN s.s_suppkey IS NULL THEN 'registered' WHEN p_size = s.s_suppkey % 50 THEN 'duplicate' ELSE 'refreshed' END AS state FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey AND p_partkey % 10 <> 0")
def pipe3(t: Inputs):
    packages = t.part.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_partkey").cast("string")).alias("stem"), F.col("p_size").cast("long").alias("signature"))
    known = t.supplier.select(F.col("s_suppkey").cast("string").alias("stem"), (F.col("s_suppkey") % 50).alias("signature"))
    return G.registrations(packages, known).select("p_partkey", "state")


@query("gov2_user_documents", """
WITH g AS (SELECT o_orderkey AS user_id, o_custkey AS car_id, o_custkey % 3 AS company_id, o_orderkey % 5 = 0 AS admin_granted, ['manual', 'wiring', 'parts'][1:(o_orderkey % 4)::INT] AS documents FROM orders),
c AS (SELECT c_custkey AS car_id, c_custkey % 3 AS company_id, ['manual', 'parts'] AS scope FROM customer WHERE c_custkey % 4 <> 0)
SELECT user_id, g.car_id, CASE WHEN admin_granted THEN documents WHEN scope IS NULL THEN NULL WHEN len(documents) = 0 THEN scope ELSE list_filter(documents, lambda x: list_contains(['manual', 'parts'], x)) END AS documents FROM g LEFT JOIN c USING (company_id, car_id)""")
def gov2(t: Inputs):
    docs = F.slice(F.array(F.lit("manual"), F.lit("wiring"), F.lit("parts")), 1, (F.col("o_orderkey") % 4).cast("int"))
    g = t.orders.select(F.col("o_orderkey").alias("user_id"), F.col("o_custkey").alias("car_id"), (F.col("o_custkey") % 3).alias("company_id"), (F.col("o_orderkey") % 5 == 0).alias("admin_granted"), docs.alias("documents"))
    c = t.customer.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("car_id"), (F.col("c_custkey") % 3).alias("company_id"), F.array(F.lit("manual"), F.lit("parts")).alias("scope"))
    return G.user_documents(g, c)


@query("gov8_missing_grants", "SELECT n_nationkey AS company_id, s_suppkey AS car_id FROM nation, supplier WHERE n_regionkey = 2 AND NOT (s_nationkey = n_nationkey)")
def gov8(t: Inputs):
    companies = t.nation.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("company_id"))
    granted = t.supplier.select(F.col("s_nationkey").alias("company_id"), F.col("s_suppkey").alias("car_id"))
    return G.missing_grants(t.supplier.select(F.col("s_suppkey").alias("car_id")), companies, granted)


@query("misc21_first_entry", "SELECT l_orderkey, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_partkey) AS r FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem)) WHERE r = 1")
def misc21(t: Inputs):
    return G.first_entry_wins(t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey").distinct(), ["l_orderkey", "l_suppkey"], "l_partkey")


@query("misc16_latest_finished", "SELECT priority, max(id) FILTER (status = 'F') AS finished, max(id) FILTER (status = 'O') AS running FROM ticket GROUP BY priority")
def misc16(t: Inputs):
    return t.ticket.groupBy("priority").agg(F.max(F.when(F.col("status") == "F", F.col("id"))).alias("finished"), F.max(F.when(F.col("status") == "O", F.col("id"))).alias("running"))


@query("misc17_children", "SELECT parent_id, string_agg(title, '|' ORDER BY sort_order, id) AS titles FROM nodes WHERE parent_id LIKE 'r%' GROUP BY parent_id")
def misc17(t: Inputs):
    rows = t.nodes.filter("parent_id like 'r%'").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", "title"))).alias("c"))
    return rows.select("parent_id", F.array_join(F.transform("c", lambda x: x["title"]), "|").alias("titles"))


@query("misc33_hysteresis", """
WITH s AS (SELECT id, company_id, created_at, CASE WHEN value < 5 THEN 1 WHEN value > 20 THEN 0 END AS turn FROM activity)
SELECT id, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 0)::INT AS open FROM s""")
def misc33(t: Inputs):
    turn = F.when(F.col("value") < 5, 1).when(F.col("value") > 20, 0)
    w = Window.partitionBy("company_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return t.activity.select("id", F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(0)).alias("open"))


@query("misc38_hits", "SELECT l_returnflag AS category, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS hit1, count(*) FILTER (l_linenumber <= 3) AS hit3 FROM lineitem GROUP BY 1")
def misc38(t: Inputs):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("hit1"), F.count_if(F.col("l_linenumber") <= 3).alias("hit3"))


@query("misc42_quota", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id, date_trunc('month', created_at) ORDER BY created_at, id) AS r FROM chat) WHERE r <= 20")
def misc42(t: Inputs):
    rows = t.chat.withColumn("month", F.date_trunc("month", "created_at"))
    return top_k(rows, ["user_id", "month"], [F.col("created_at"), F.col("id")], 20).select("id")


@query("misc43_latest_feedback", "SELECT user_id, session_id, arg_max(feedback, (created_at, id)) FILTER (feedback <> 0) AS vote, count(*) AS n FROM chat WHERE session_id <> '' GROUP BY 1, 2")
def misc43(t: Inputs):
    return t.chat.filter("session_id <> ''").groupBy("user_id", "session_id").agg(F.max_by("feedback", F.when(F.col("feedback") != 0, F.struct("created_at", "id"))).alias("vote"), F.count("*").alias("n"))


@query("dq1_profile", "SELECT car_stem, count(*) AS nodes, count(content) AS leaves, count(*) FILTER (length(content) = 0) AS empties, sum(length(content))::BIGINT AS chars, count(DISTINCT section) AS sections FROM sections GROUP BY 1")
def dq1(t: Inputs):
    return t.sections.groupBy("car_stem").agg(F.count("*").alias("nodes"), F.count("content").alias("leaves"), F.count_if(F.length("content") == 0).alias("empties"), F.sum(F.length("content")).alias("chars"), F.countDistinct("section").alias("sections"))


@query("dq2_missing_sections", "SELECT s.source AS car_stem, l.lang AS section FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l WHERE (s.source, l.lang) NOT IN (SELECT source, lang FROM documents WHERE lang IS NOT NULL AND doc_id % 3 = 0)")
def dq2(t: Inputs):
    required = t.documents.agg(F.collect_set("lang").alias("langs")).withColumn("k", F.lit(1))
    wanted = t.documents.select("source").distinct().withColumn("k", F.lit(1)).join(required, "k").select("source", F.explode("langs").alias("lang"))
    return wanted.join(t.documents.filter("doc_id % 3 = 0").select("source", "lang"), ["source", "lang"], "left_anti").select(F.col("source").alias("car_stem"), F.col("lang").alias("section"))


@query("set12_shared_content", "SELECT content_hash, n, sources FROM (SELECT sha1(text) AS content_hash, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1) WHERE n > 1")
def set12(t: Inputs):
    g = t.documents.groupBy(F.sha1(F.col("text").cast("binary")).alias("content_hash")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.filter("n > 1")


@query("txt20_query_terms", "SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'de', 'la')))) AS terms FROM conversations")
def txt20(t: Inputs):
    words = F.filter(A.tokens(F.col("text")), lambda x: (F.length(x) >= 2) & ~x.isin("the", "and", "de", "la"))
    return t.conversations.select("conv_id", "turn", F.array_sort(F.array_distinct(words)).alias("terms"))


@query("txt10_ascii_digits", "SELECT p_partkey, 'no ' || p_partkey AS label FROM part")
def txt10(t: Inputs):
    return t.part.select("p_partkey", X.ascii_digits(F.translate(F.concat(F.lit("no "), F.col("p_partkey").cast("string")), "0123456789", "۰۱۲۳۴۵۶۷۸۹")).alias("label"))


@query("agg22_display_variant", "SELECT key, arg_min(v, (CASE WHEN regexp_matches(v, '^[A-Z][a-z]') THEN 0 ELSE 1 END, length(v), v)) AS display, sum(n)::BIGINT AS n FROM (SELECT lower(v) AS key, v, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN lower(p_type) ELSE p_type END AS v FROM part) GROUP BY 1, 2) GROUP BY key")
def agg22(t: Inputs):
    v = F.when(F.col("p_size") % 3 == 0, F.upper("p_type")).when(F.col("p_size") % 3 == 1, F.lower("p_type")).otherwise(F.col("p_type"))
    n = t.part.select(v.alias("v")).groupBy(F.lower("v").alias("key"), "v").agg(F.count("*").alias("n"))
    rank = F.struct(F.when(F.col("v").rlike("^[A-Z][a-z]"), 0).otherwise(1), F.length("v"), F.col("v"))
    return n.groupBy("key").agg(F.min_by("v", rank).alias("display"), F.sum("n").alias("n"))


@query("gr15_elsewhere", "SELECT DISTINCT a.blob_id, b.car_stem FROM occurrences a JOIN occurrences b USING (blob_id) WHERE a.car_stem = 'car5' AND b.car_stem <> 'car5'")
def gr15(t: Inputs):
    own = t.occurrences.filter("car_stem = 'car5'").select("blob_id").distinct()
    return t.occurrences.filter("car_stem <> 'car5'").join(own, "blob_id", "left_semi").select("blob_id", "car_stem").distinct()


@query("str10_sessions", "SELECT coalesce(nullif(session_id, ''), 'own-' || id) AS session, count(*) AS n, min(created_at) AS first FROM chat GROUP BY 1")
def str10(t: Inputs):
    key = F.coalesce(F.nullif("session_id", F.lit("")), F.concat(F.lit("own-"), F.col("id").cast("string")))
    return t.chat.groupBy(key.alias("session")).agg(F.count("*").alias("n"), F.min("created_at").alias("first"))


@query("win7_recent_distinct", "SELECT company_id, priority, id FROM ticket QUALIFY row_number() OVER (PARTITION BY company_id, priority ORDER BY created_at DESC, id DESC) = 1")
def win7(t: Inputs):
    return keep_first(t.ticket, ["company_id", "priority"], [F.desc("created_at"), F.desc("id")]).select("company_id", "priority", "id")
