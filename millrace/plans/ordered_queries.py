"""Ranks, nearest rows, sessions, paging, and joins between relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import relations as R
from .inputs import Inputs
from .registry import query

_SECONDS = "floor(epoch_us({0}) / 1000000)::BIGINT"


@query("win1_reciprocal_ranks", "SELECT l_orderkey, l_partkey, row_number() OVER w AS rank, round(0.6 / (60 + row_number() OVER w), 8) AS rrf FROM (SELECT DISTINCT l_orderkey, l_partkey, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY s DESC, l_partkey)")
def win1(t: Inputs):
    best = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("s"))
    return O.reciprocal_ranks(best, ["l_orderkey"], "s", "l_partkey", 0.6).select("l_orderkey", "l_partkey", "rank", F.round("rrf", 8).alias("rrf"))


@query("win2_latest_per_group", "SELECT company_id, id, created_at FROM ticket QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, id DESC) = 1")
def win2(t: Inputs):
    return O.top_k(t.ticket, ["company_id"], [F.desc("created_at"), F.desc("id")], 1).select("company_id", "id", "created_at")


@query("win3_top_k", "SELECT src_blob, dst_blob, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_blob ORDER BY weight DESC, dst_blob, relation) AS rank FROM edges) WHERE rank <= 4")
def win3(t: Inputs):
    return O.top_k(t.edges, ["src_blob"], [F.desc("weight"), F.col("dst_blob"), F.col("relation")], 4).select("src_blob", "dst_blob", "weight", "rank")


@query("win4_min_max", "SELECT id, round((price - min(price) OVER w) / CASE WHEN max(price) OVER w = min(price) OVER w THEN 1 ELSE max(price) OVER w - min(price) OVER w END, 6) AS scaled FROM ticket WINDOW w AS (PARTITION BY company_id)")
def win4(t: Inputs):
    return t.ticket.select("id", F.round(O.min_max("price", ["company_id"]), 6).alias("scaled"))


@query("win5_z_score", "SELECT id, round((price - avg(price) OVER w) / CASE WHEN stddev_pop(price) OVER w = 0 THEN 1 ELSE stddev_pop(price) OVER w END, 4) + 0.0 AS z FROM ticket WINDOW w AS (PARTITION BY priority)")
def win5(t: Inputs):
    return t.ticket.select("id", (F.round(O.z_score("price", ["priority"]), 4) + 0.0).alias("z"))


@query("win6_lead_gap", "SELECT company_id, id, price, round((price - s) / price, 6) AS margin FROM (SELECT company_id, id, price, lead(price) OVER w AS s, row_number() OVER w AS r FROM ticket WINDOW w AS (PARTITION BY company_id ORDER BY price DESC, id)) WHERE r = 1")
def win6(t: Inputs):
    return O.lead_gap(t.ticket, ["company_id"], "price", "id")


@query("win7_keep_first", "SELECT user_id, app_url, id FROM activity QUALIFY row_number() OVER (PARTITION BY user_id, app_url ORDER BY created_at DESC, id DESC) = 1")
def win7(t: Inputs):
    return O.keep_first(t.activity, ["user_id", "app_url"], [F.desc("created_at"), F.desc("id")]).select("user_id", "app_url", "id")


@query("win8_collapse_runs", "SELECT user_id, id, action FROM (SELECT *, lag(action) OVER (PARTITION BY user_id ORDER BY created_at, id) AS b FROM activity) WHERE b IS NULL OR b <> action")
def win8(t: Inputs):
    return O.collapse_runs(t.activity, ["user_id"], ["created_at", "id"], "action").select("user_id", "id", "action")


@query("win9_sequence_numbers", "SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY id) - 1 AS step FROM message")
def win9(t: Inputs):
    return O.top_k(t.message, ["request_id"], [F.col("id")], 1 << 30).select("request_id", "id", (F.col("rank") - 1).cast("long").alias("step"))


@query("win11_session_spans", f"SELECT session_id, n, round(hi - lo + last_ms / 1000.0, 3) AS span_s FROM (SELECT session_id, count(*) AS n, min({_SECONDS.format('created_at')}) AS lo, max({_SECONDS.format('created_at')}) AS hi, arg_max(latency_ms, created_at) AS last_ms FROM chat WHERE coalesce(session_id, '') <> '' GROUP BY 1)")
def win11(t: Inputs):
    return O.session_spans(t.chat, "session_id", "created_at", "latency_ms", "id")


@query("win15_day_islands", "SELECT user_id, id, sum(n) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, CASE WHEN lag(created_at::DATE) OVER (PARTITION BY user_id ORDER BY created_at, id) = created_at::DATE THEN 0 ELSE 1 END AS n FROM chat)")
def win15(t: Inputs):
    return O.day_islands(t.chat, ["user_id"], "created_at", "id").select("user_id", "id", "island")


@query("win13_smoothed", "SELECT user_id, round(sum(CASE WHEN after = n - 1 THEN 1.0 ELSE 0.3 END * pow(0.7, after) * latency_ms), 6) AS smoothed FROM (SELECT user_id, latency_ms, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) - 1 AS after, count(*) OVER (PARTITION BY user_id) AS n FROM chat) GROUP BY 1")
def win13(t: Inputs):
    return O.smoothed(t.chat, ["user_id"], "created_at", "id", "latency_ms")


@query("win12_trailing_rate", f"""
WITH s AS (SELECT company_id, {_SECONDS.format('created_at')} AS t, id AS c FROM activity),
w AS (SELECT *, arg_min(c, (t, c)) OVER (PARTITION BY company_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS c0, min(t) OVER (PARTITION BY company_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS t0 FROM s)
SELECT company_id, c AS id, round((c - c0) / nullif((t - t0)::DOUBLE, 0), 6) AS rate FROM w""")
def win12(t: Inputs):
    return O.trailing_rate(t.activity, ["company_id"], "created_at", "id", 300).select("company_id", "id", "rate")


@query("win17_round_robin", "SELECT category, id, turn FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY md5(id::VARCHAR), id) AS turn FROM activity) ORDER BY turn, category LIMIT 60")
def win17(t: Inputs):
    return O.round_robin(t.activity, "category", F.md5(F.col("id").cast("string").cast("binary")), "id", 60).select("category", "id", "turn")


@query("ord2_keyset_page", "SELECT id, created_at FROM ticket WHERE created_at < TIMESTAMP '1996-01-01' OR (created_at = TIMESTAMP '1996-01-01' AND id < 500) ORDER BY created_at DESC, id DESC LIMIT 26")
def ord2(t: Inputs):
    return O.keyset_page(t.ticket, "created_at", "id", (F.lit("1996-01-01").cast("timestamp_ntz"), 500), 25).select("id", "created_at")


@query("ord3_cursor_round_trip", "SELECT id, created_at AS cursor_ts, id AS cursor_id FROM ticket")
def ord3(t: Inputs):
    return O.decoded_cursor(t.ticket.select("id", O.cursor(F.col("created_at"), F.col("id")).alias("c")), "c").select("id", "cursor_ts", "cursor_id")


@query("ord6_null_fallback", "SELECT id, coalesce(resolved_h, first_response_h, 0) AS last FROM ticket ORDER BY coalesce(resolved_h, first_response_h, 0) DESC, id DESC LIMIT 50")
def ord6(t: Inputs):
    last = F.coalesce("resolved_h", "first_response_h", F.lit(0)).cast("long")
    return t.ticket.select("id", last.alias("last")).orderBy(F.desc("last"), F.desc("id")).limit(50)


@query("ord7_match_rank", "SELECT blob_id, CASE WHEN contains(lower(title), '1') THEN 0 ELSE 1 END AS tier FROM blobs WHERE contains(lower(title), '1') OR contains(lower(component), 'a') ORDER BY tier, length(title), blob_id LIMIT 40")
def ord7(t: Inputs):
    title = F.instr(F.lower("title"), "1") > 0
    hits = t.blobs.filter(title | (F.instr(F.lower("component"), "a") > 0)).withColumn("tier", F.when(title, 0).otherwise(1))
    return hits.orderBy("tier", F.length("title"), "blob_id").limit(40).select("blob_id", "tier")


@query("ord13_thread_cap", "SELECT request_id, id, n > 3 AS truncated FROM (SELECT request_id, id, count(*) OVER (PARTITION BY request_id) AS n, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) AS r FROM message) WHERE r <= 3")
def ord13(t: Inputs):
    n = t.message.groupBy("request_id").agg(F.count("*").alias("n"))
    return O.top_k(t.message, ["request_id"], [F.desc("created_at"), F.desc("id")], 3).join(n, "request_id").select("request_id", "id", (F.col("n") > 3).alias("truncated"))


@query("jn1_occurrences_blobs", "SELECT o.car_stem, b.component, count(*) AS n FROM occurrences o JOIN blobs b USING (blob_id) GROUP BY 1, 2")
def jn1(t: Inputs):
    return t.occurrences.join(t.blobs, "blob_id").groupBy("car_stem", "component").agg(F.count("*").alias("n"))


@query("jn2_four_way", "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def jn2(t: Inputs):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jn4_on_clause_predicate", "SELECT c.c_custkey, count(o.o_orderkey) AS open_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY 1")
def jn4(t: Inputs):
    return t.customer.join(t.orders.filter("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_orders"))


@query("jn6_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def jn6(t: Inputs):
    return t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("jn7_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def jn7(t: Inputs):
    return t.part.select("p_partkey").join(t.lineitem.filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("jn8_exists_self", "SELECT id FROM nodes n WHERE EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.id)")
def jn8(t: Inputs):
    return t.nodes.select("id").join(t.nodes.select(F.col("parent_id").alias("id")).filter("id is not null"), "id", "left_semi")


@query("jn16_repeated_within", f"SELECT id, coalesce({_SECONDS.format('created_at')} - lag({_SECONDS.format('created_at')}) OVER (PARTITION BY user_id, session_id ORDER BY created_at, id) <= 86400, false) AS repeated FROM chat")
def jn16(t: Inputs):
    return O.repeated_within(t.chat, ["user_id", "session_id"], "created_at", "id", 86400).select("id", "repeated")


@query("jn17_asof", f"""
WITH c AS (SELECT id, user_id, created_at, {_SECONDS.format('created_at')} AS s FROM activity WHERE action = 'click'),
v AS (SELECT id, user_id, created_at, {_SECONDS.format('created_at')} AS s FROM activity WHERE action = 'view')
SELECT c.id, (SELECT CASE WHEN c.s - max(v.s) <= 36000 THEN arg_max(v.id, (v.created_at, v.id)) END FROM v WHERE v.user_id = c.user_id AND v.created_at <= c.created_at) AS matched FROM c""")
def jn17(t: Inputs):
    clicks = t.activity.filter("action = 'click'").select("id", "user_id", "created_at")
    return R.asof_previous(clicks, t.activity.filter("action = 'view'").select(F.col("id").alias("vid"), "user_id", "created_at"), ["user_id"], "created_at", "vid", 36000).select("id", "matched")


@query("jn19_latest_public_message", "SELECT request_id, id, from_customer FROM message WHERE NOT internal QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) = 1")
def jn19(t: Inputs):
    return O.top_k(t.message.filter("not internal"), ["request_id"], [F.desc("created_at"), F.desc("id")], 1).select("request_id", "id", "from_customer")


@query("jn20_unread", "SELECT t.id, count(m.id) AS unread FROM ticket t JOIN message m ON m.request_id = t.id AND m.from_customer AND (t.resolved_h IS NULL OR m.created_at > t.created_at + to_hours(t.resolved_h)) GROUP BY t.id")
def jn20(t: Inputs):
    mark = t.ticket.select(F.col("id").alias("request_id"), F.expr("created_at + make_dt_interval(0, cast(resolved_h as int), 0, 0)").alias("mark"))
    return t.message.filter("from_customer").join(mark, "request_id").filter("mark is null or created_at > mark").groupBy(F.col("request_id").alias("id")).agg(F.count("*").alias("unread"))


@query("jn23_longest_prefix", "SELECT p.p_name AS name, arg_max(b.prefix, length(b.prefix)) AS prefix FROM (SELECT DISTINCT p_name FROM part) p JOIN (SELECT DISTINCT string_split(p_name, ' ')[1] AS prefix FROM part UNION SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:2], ' ') FROM part WHERE p_size < 20) b ON p.p_name = b.prefix OR starts_with(p.p_name, b.prefix || ' ') GROUP BY 1")
def jn23(t: Inputs):
    w = F.split("p_name", " ")
    prefixes = t.part.select(w[0].alias("prefix")).union(t.part.filter("p_size < 20").select(F.array_join(F.slice(w, 1, 2), " ")))
    return R.longest_prefix(t.part.select(F.col("p_name").alias("name")).distinct(), prefixes, "name", "prefix")


@query("jn30_reconciled", "SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS state FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 6 <> 0) b ON a.c_custkey = b.c_custkey WHERE a.v IS DISTINCT FROM b.v")
def jn30(t: Inputs):
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("v"))
    return R.reconciled(c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 6 <> 0").withColumn("v", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("v"))), "c_custkey", "v")


@query("set1_fused", "SELECT l_orderkey, l_partkey, round(sum(rrf), 8) AS rrf, max(sim) AS sim, min(bm25) AS bm25 FROM (SELECT l_orderkey, l_partkey, 1.0 / (60 + l_linenumber) AS rrf, l_discount AS sim, NULL::DOUBLE AS bm25 FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, l_partkey, 0.6 / (60 + l_linenumber), NULL, -l_tax FROM lineitem WHERE l_returnflag <> 'A') GROUP BY 1, 2")
def set1(t: Inputs):
    a = t.lineitem.filter("l_linestatus = 'O'").select("l_orderkey", "l_partkey", (1.0 / (60 + F.col("l_linenumber"))).alias("rrf"), F.col("l_discount").alias("sim"), F.lit(None).cast("double").alias("bm25"))
    b = t.lineitem.filter("l_returnflag <> 'A'").select("l_orderkey", "l_partkey", (0.6 / (60 + F.col("l_linenumber"))).alias("rrf"), F.lit(None).cast("double").alias("sim"), (-F.col("l_tax")).alias("bm25"))
    return R.fused([a, b], ["l_orderkey", "l_partkey"]).withColumn("rrf", F.round("rrf", 8))


@query("set2_intersection", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def set2(t: Inputs):
    return t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey").intersect(t.orders.filter("o_orderpriority like '1%'").select("o_custkey"))


@query("set3_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def set3(t: Inputs):
    return t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("set4_content_dedup", "SELECT sha1(text) AS content_hash, min(doc_id) AS first_item, count(*) AS n_occ FROM documents GROUP BY 1")
def set4(t: Inputs):
    return R.content_deduped(t.documents, "text", "doc_id")


@query("set6_upsert", "SELECT coalesce(s.id, f.id) AS id, coalesce(f.price, s.price) AS price, coalesce(f.csat, s.csat) AS csat FROM (SELECT id, price, csat FROM ticket WHERE id % 3 <> 0) s FULL JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN price * 2 END AS price, CAST(9 AS INT) AS csat FROM ticket WHERE id % 4 = 0) f ON s.id = f.id")
def set6(t: Inputs):
    fresh = t.ticket.filter("id % 4 = 0").select("id", F.expr("if(id % 2 = 0, price * 2, null)").alias("price"), F.lit(9).alias("csat"))
    return R.upserted(t.ticket.filter("id % 3 <> 0"), fresh, "id", ["price", "csat"])


@query("set7_ranked_upsert", "SELECT p_type, arg_min(p_brand, (-p_size, -p_retailprice, p_brand)) AS p_brand, max(p_size) AS p_size, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_type")
def set7(t: Inputs):
    return R.ranked_upsert(t.part, "p_type", "p_brand", "p_size", "p_retailprice")


@query("set9_conflicts", "SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT (l_quantity, l_tax)) > 1 AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def set9(t: Inputs):
    return R.conflicting_rows(t.lineitem, ["l_partkey", "l_suppkey"], ["l_quantity", "l_tax"])


@query("set13_disambiguated", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) > 1 THEN p_type || ' #' || p_partkey ELSE p_type END AS label FROM part")
def set13(t: Inputs):
    return R.disambiguated(t.part.select("p_partkey", "p_brand", F.col("p_type").alias("label")), "p_brand", "label", "p_partkey").select("p_partkey", "label")


@query("set14_numbered", "SELECT p_partkey, CASE WHEN row_number() OVER w > 1 THEN p_type || ' (' || row_number() OVER w || ')' ELSE p_type END AS unique_name FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)")
def set14(t: Inputs):
    return R.numbered_collisions(t.part, "p_type", "p_partkey").select("p_partkey", "unique_name")


@query("set16_jaccard", "SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0), 6) AS similarity FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS a, coalesce(lag(string_split(lower(text), ' ')) OVER (PARTITION BY conv_id ORDER BY turn), []) AS b FROM conversations)")
def set16(t: Inputs):
    from pyspark.sql import Window

    words = F.split(F.lower("text"), " ")
    before = F.coalesce(F.lag(words).over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    return t.conversations.select("conv_id", "turn", words.alias("a"), before.alias("b")).select("conv_id", "turn", F.round(R.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))
