"""More of the survey's operators: joins with conditions, titles and stems, evidence, reports and state rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import hierarchy as H
from ..operators import monitoring as M
from ..operators import ordered as O
from ..operators import relations as R
from ..operators import retrieval as S
from .inputs import Inputs
from .registry import query


@query("flt10_own_or_company", "SELECT id FROM ticket WHERE (company_id % 2 = 0 AND company_id < 40) OR created_by = 7")
def flt10(t: Inputs):
    manager = (F.col("company_id") % 2 == 0) & (F.col("company_id") < 40)
    return t.ticket.filter(manager | (F.col("created_by") == 7)).select("id")


@query("flt14_json_keys", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def flt14(t: Inputs):
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: k.isin("k"))
    return t.events.select("event_id", kept["k"].alias("k")).filter("k is not null")


@query("jn5_dimension_joins", "SELECT n_name, action, count(*) AS n FROM activity JOIN customer ON c_custkey = user_id + 1 JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def jn5(t: Inputs):
    j = t.activity.join(t.customer.select((F.col("c_custkey") - 1).alias("user_id"), "c_nationkey"), "user_id").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return j.groupBy("n_name", "action").agg(F.count("*").alias("n"))


@query("jn9_integrity", "SELECT 'nation without customers' AS issue, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL SELECT 'customer without orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn9(t: Inputs):
    a = t.nation.join(t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti")
    b = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return a.agg(F.lit("nation without customers").alias("issue"), F.count("*").alias("n")).unionByName(b.agg(F.lit("customer without orders").alias("issue"), F.count("*").alias("n")))


@query("jn10_promotion", "SELECT id, CASE WHEN id IN (SELECT parent_id FROM nodes WHERE content IS NOT NULL) THEN 'intermediate' WHEN content IS NULL THEN 'folder' ELSE 'end' END AS kind FROM nodes")
def jn10(t: Inputs):
    parents = t.nodes.filter("content is not null and parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("p", F.lit(True))
    return t.nodes.join(parents, "id", "left").select("id", F.when(F.col("p"), "intermediate").when(F.col("content").isNull(), "folder").otherwise("end").alias("kind"))


@query("jn14_two_step_link", "SELECT p_partkey, coalesce(a.s_suppkey, b.s_suppkey) AS target FROM part LEFT JOIN supplier a ON a.s_suppkey = p_partkey AND p_size > 25 LEFT JOIN supplier b ON b.s_suppkey = p_size")
def jn14(t: Inputs):
    s = t.supplier.select("s_suppkey")
    a = t.part.select("p_partkey", "p_size", F.when(F.col("p_size") > 25, F.col("p_partkey")).alias("k1")).join(s.select(F.col("s_suppkey").alias("k1"), F.col("s_suppkey").alias("a")), "k1", "left")
    return a.join(s.select(F.col("s_suppkey").cast("int").alias("p_size"), F.col("s_suppkey").alias("b")), "p_size", "left").select("p_partkey", F.coalesce("a", "b").alias("target"))


@query("jn15_capped_inheritance", "SELECT l_suppkey, l_partkey, rank FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS rank FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE rank <= 20")
def jn15(t: Inputs):
    return O.top_k(t.lineitem.select("l_suppkey", "l_partkey").distinct(), ["l_suppkey"], [F.col("l_partkey")], 20)


@query("jn21_rank_aligned", "WITH a AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part WHERE p_size % 2 = 0), b AS (SELECT p_partkey AS leaf, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part WHERE p_size % 2 = 1) SELECT a.p_partkey, b.leaf FROM a LEFT JOIN b USING (p_type, r)")
def jn21(t: Inputs):
    n = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey")))
    a, b = n(t.part.filter("p_size % 2 = 0")), n(t.part.filter("p_size % 2 = 1")).select("p_type", "r", F.col("p_partkey").alias("leaf"))
    return a.join(b, ["p_type", "r"], "left").select("p_partkey", "leaf")


@query("jn24_dictionary", "SELECT p_partkey, d.v AS translated FROM part LEFT JOIN (SELECT p_type AS k, arg_min(p_brand, p_partkey) AS v FROM part WHERE p_size < 10 GROUP BY 1) d ON d.k = p_type")
def jn24(t: Inputs):
    d = t.part.filter("p_size < 10").groupBy("p_type").agg(F.min_by("p_brand", "p_partkey").alias("translated"))
    return t.part.join(d, "p_type", "left").select("p_partkey", "translated")


@query("jn26_token_subset", """WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda w: w <> '')) AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda w: w <> '')) AS ws FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON len(b.ws) > 0 AND list_has_all(d.ws, b.ws)""")
def jn26(t: Inputs):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != ""))
    texts = t.documents.filter("text is not null").select("doc_id", words.alias("words"))
    return R.token_subset_pairs(texts, "doc_id", t.benchmark.select("item_id", words.alias("words")), "item_id", "words")


@query("jn28_paired", "SELECT a.l_orderkey, a.v AS x, b.v AS y FROM (SELECT l_orderkey, max(l_discount) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a JOIN (SELECT l_orderkey, max(l_tax) AS v FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) b USING (l_orderkey)")
def jn28(t: Inputs):
    a = t.lineitem.filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.max("l_discount").alias("x"))
    return a.join(t.lineitem.filter("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.max("l_tax").alias("y")), "l_orderkey")


@query("jn11_knn_edges", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
SELECT src, dst, round(sim, 5) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 4""")
def jn11(t: Inputs):
    q = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return S.nearest(t.embeddings, "vec_id", "embedding", q, 4, others_only=True).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "sim")


@query("agg28_set_valued", "SELECT blob_id, list_sort(list(DISTINCT brand)) AS brands, count(DISTINCT car_stem) AS cars FROM occurrences GROUP BY 1")
def agg28(t: Inputs):
    return t.occurrences.groupBy("blob_id").agg(F.array_sort(F.collect_set("brand")).alias("brands"), F.countDistinct("car_stem").alias("cars"))


@query("agg25_backlog", "SELECT count(*) AS open, min(created_at) AS oldest, count(*) FILTER (first_response_h IS NULL) AS unanswered FROM ticket WHERE status <> 'F'")
def agg25(t: Inputs):
    return t.ticket.filter("status <> 'F'").agg(F.count("*").alias("open"), F.min("created_at").alias("oldest"), F.count_if(F.col("first_response_h").isNull()).alias("unanswered"))


@query("win10_carried_forward", "SELECT id, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT id, user_id, nullif(session_id, '') AS s FROM chat)")
def win10(t: Inputs):
    w = Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return t.chat.select("id", F.last(F.nullif("session_id", F.lit("")), ignorenulls=True).over(w).alias("filled"))


@query("win14_unread_divider", "SELECT request_id, id FROM (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) AS r FROM message WHERE from_customer) WHERE r = 2")
def win14(t: Inputs):
    return O.top_k(t.message.filter("from_customer"), ["request_id"], [F.desc("created_at"), F.desc("id")], 2).filter("rank = 2").select("request_id", "id")


@query("win16_chart_offsets", "SELECT priority, n, round((sum(n) OVER (ORDER BY n DESC, priority) - n) / sum(n) OVER (), 6) AS begin FROM (SELECT priority, count(*) AS n FROM ticket GROUP BY 1)")
def win16(t: Inputs):
    c = A.coverage_curve(A.count_by(t.ticket, "priority"), "priority", "n")
    total = Window.partitionBy()
    return c.select("priority", "n", F.round((F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")) / F.sum("n").over(total), 6).alias("begin"))


@query("ord5_offset_pages", "SELECT id FROM ticket ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 150")
def ord5(t: Inputs):
    return t.ticket.orderBy(F.desc("created_at"), F.desc("id")).offset(150).limit(50).select("id")


@query("ord4_id_keyset", "SELECT id, action FROM activity WHERE id < 900 ORDER BY id DESC LIMIT 51")
def ord4(t: Inputs):
    return t.activity.filter("id < 900").orderBy(F.desc("id")).limit(51).select("id", "action")


@query("ord8_composite_best", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, length(p_name) DESC, p_partkey) = 1")
def ord8(t: Inputs):
    return O.top_k(t.part, ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.desc(F.length("p_name")), F.col("p_partkey")], 1).select("p_brand", "p_partkey")


@query("ord10_shallowest", "SELECT title, id FROM nodes QUALIFY row_number() OVER (PARTITION BY content ORDER BY length(title), id) = 1 AND content IS NOT NULL")
def ord10(t: Inputs):
    return O.top_k(t.nodes.filter("content is not null"), ["content"], [F.length("title"), F.col("id")], 1).select("title", "id")


@query("set5_insert_or_ignore", "SELECT id FROM ticket WHERE id % 5 = 0 UNION SELECT id FROM ticket WHERE id % 3 = 0")
def set5(t: Inputs):
    stored, fresh = t.ticket.filter("id % 5 = 0").select("id"), t.ticket.filter("id % 3 = 0").select("id").dropDuplicates(["id"])
    return stored.unionByName(fresh.join(stored, "id", "left_anti"))


@query("set8_distinct", "SELECT DISTINCT car_stem, brand FROM occurrences")
def set8(t: Inputs):
    return t.occurrences.select("car_stem", "brand").distinct()


@query("set11_name_collisions", "SELECT lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS norm, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def set11(t: Inputs):
    return t.part.groupBy(F.lower(F.trim(F.regexp_replace("p_type", "\\s+", " "))).alias("norm"), "p_size").agg(F.count("*").alias("n")).filter("n > 1")


@query("set15_keep_first_conflicts", "SELECT l_orderkey, l_partkey, min(l_linenumber) AS kept, count(DISTINCT l_quantity) > 1 AS conflict FROM lineitem GROUP BY 1, 2")
def set15(t: Inputs):
    lines = O.dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), "l_orderkey")
    return lines.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("kept"), F.coalesce(F.min("l_quantity") < F.max("l_quantity"), F.lit(False)).alias("conflict"))


@query("gr3_prefix_counts", "SELECT substr(p_type, 1, 5) AS prefix, count(*) AS n FROM part WHERE starts_with(p_type, substr(p_type, 1, 5)) GROUP BY 1")
def gr3(t: Inputs):
    return t.part.filter(F.col("p_type").startswith(F.substring("p_type", 1, 5))).groupBy(F.substring("p_type", 1, 5).alias("prefix")).agg(F.count("*").alias("n"))


@query("gr8_would_make_ring", "WITH RECURSIVE up AS (SELECT id, parent_id FROM nodes UNION ALL SELECT u.id, n.parent_id FROM up u JOIN nodes n ON n.id = u.parent_id) SELECT DISTINCT id FROM up WHERE parent_id = 'r2'")
def gr8(t: Inputs):
    return H.subtree(H.ancestor_paths(t.nodes), "r2").filter("id <> 'r2'").select("id")


@query("gr9_scope", "SELECT id FROM nodes WHERE id = 'n3' OR parent_id = 'n3' OR id = (SELECT parent_id FROM nodes WHERE id = 'n3')")
def gr9(t: Inputs):
    own = H.subtree(H.ancestor_paths(t.nodes), "n3").select("id")
    return own.unionByName(t.nodes.filter("id = 'n3'").select(F.col("parent_id").alias("id"))).distinct()


@query("ret9_fused_ranks", "WITH a AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part) SELECT item, round(1.0 / (60 + a.r) + 0.5 / (60 + b.r), 8) AS rrf FROM a JOIN b USING (item) WHERE a.r <= 100 AND b.r <= 100")
def ret9(t: Inputs):
    p = t.part.select(F.col("p_partkey").alias("item"), "p_retailprice", "p_size")
    first = lambda c, w: O.reciprocal_ranks(p.orderBy(F.desc(c), "item").limit(100).withColumn("q", F.lit(1)), ["q"], c, "item", w).select("item", "rrf")
    both = first("p_retailprice", 1.0).unionByName(first("p_size", 0.5))
    return both.groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("rrf"), 8).alias("rrf")).filter("n = 2").select("item", "rrf")


@query("ret12_allowed_only", "SELECT blob_id, min(occ_id) AS occ_id FROM occurrences WHERE car_stem IN ('car1', 'car4') GROUP BY 1")
def ret12(t: Inputs):
    allowed = t.occurrences.filter("car_stem in ('car1', 'car4')").select("car_stem").distinct()
    return t.occurrences.join(allowed, "car_stem", "left_semi").groupBy("blob_id").agg(F.min("occ_id").alias("occ_id"))


@query("ret16_grounded", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN greatest(l_discount * 10, l_tax * 10) ELSE l_discount * 10 END >= 0.6 AS grounded FROM lineitem")
def ret16(t: Inputs):
    kind = F.when(F.col("l_returnflag") == "A", "code").otherwise("semantic")
    return t.lineitem.select("l_orderkey", "l_linenumber", S.grounded(kind, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("grounded"))


@query("evl6_calibration", "SELECT CASE WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM lineitem GROUP BY 1")
def evl6(t: Inputs):
    band = F.when(F.col("l_discount") >= 0.07, "high").when(F.col("l_discount") >= 0.03, "medium").otherwise("low")
    return t.lineitem.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query("hlp8_stale_articles", "SELECT priority, count(*) FILTER (resolved_h IS NULL OR resolved_h > 90) AS stale, count(*) AS n FROM ticket GROUP BY 1")
def hlp8(t: Inputs):
    return t.ticket.groupBy("priority").agg(F.count_if(F.col("resolved_h").isNull() | (F.col("resolved_h") > 90)).alias("stale"), F.count("*").alias("n"))


@query("mon2_thresholds", "SELECT endpoint, CASE WHEN max(max_ms) >= 5000 THEN 'critical' WHEN max(max_ms) >= 2000 THEN 'warning' ELSE 'ok' END AS state FROM traffic GROUP BY 1")
def mon2(t: Inputs):
    most = F.max("max_ms")
    return t.traffic.groupBy("endpoint").agg(F.when(most >= 5000, "critical").when(most >= 2000, "warning").otherwise("ok").alias("state"))


@query("mon6_absent", "SELECT u.user_id, d.day FROM (SELECT DISTINCT user_id FROM activity) u, (SELECT DISTINCT created_at::DATE AS day FROM activity) d WHERE (u.user_id, d.day) NOT IN (SELECT user_id, created_at::DATE FROM activity)")
def mon6(t: Inputs):
    return M.silent_days(t.activity, "user_id", "created_at")


@query("rec8_discovery", "SELECT count(*) AS entitled, count(*) FILTER (v) AS viewed, count(*) FILTER (p) AS bought, round(count(*) FILTER (p) / count(*)::DOUBLE, 6) AS rate FROM (SELECT user_id, bool_or(action = 'view') AS v, bool_or(action = 'purchase') AS p FROM activity GROUP BY 1)")
def rec8(t: Inputs):
    u = t.activity.groupBy("user_id").agg(F.bool_or(F.col("action") == "view").alias("v"), F.bool_or(F.col("action") == "purchase").alias("p"))
    return u.agg(F.count("*").alias("entitled"), F.count_if("v").alias("viewed"), F.count_if("p").alias("bought"), F.round(A.ratio(F.count_if("p"), F.count("*")), 6).alias("rate"))


@query("trm6_majority", "SELECT p_brand, v AS winner, c AS votes FROM (SELECT p_brand, lower(p_type) AS v, count(*) AS c FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, v) = 1")
def trm6(t: Inputs):
    votes = t.part.groupBy("p_brand", F.lower("p_type").alias("winner")).agg(F.count("*").alias("votes"))
    return O.top_k(votes, ["p_brand"], [F.desc("votes"), F.col("winner")], 1).drop("rank")


@query("trm4_candidates", "WITH w AS (SELECT unnest(string_split(lower(p_type), ' ')) AS term FROM part) SELECT term, count(*) AS n FROM w WHERE term NOT IN (SELECT lower(r_name) FROM region) GROUP BY 1 HAVING count(*) >= 3")
def trm4(t: Inputs):
    terms = t.part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    return terms.join(t.region.select(F.lower("r_name").alias("term")), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n")).filter("n >= 3")


@query("ml1_hard_negatives", "WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS item, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R') SELECT query_id, item, rank FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rank FROM h WHERE (query_id, item) NOT IN (SELECT query_id, item FROM r)) WHERE rank <= 2")
def ml1(t: Inputs):
    h = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item")).agg(F.max("l_extendedprice").alias("s"))
    relevant = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item"))
    return O.top_k(h.join(relevant, ["query_id", "item"], "left_anti"), ["query_id"], [F.desc("s"), F.col("item")], 2).select("query_id", "item", "rank")


@query("scl2_ages", "SELECT id, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) / 1e6 / 3600)::BIGINT AS hours FROM activity")
def scl2(t: Inputs):
    return t.activity.select("id", F.expr("timestampdiff(HOUR, created_at, timestamp_ntz'2024-01-31 00:00:00')").alias("hours"))


@query("scl11_rank_weights", "SELECT conv_id, turn, (pos - 1)::INT AS pos, round(1.0 / pos, 6) AS weight FROM (SELECT conv_id, turn, unnest(range(1, least(len(string_split(text, ' ')), 3) + 1)) AS pos FROM conversations WHERE text IS NOT NULL)")
def scl11(t: Inputs):
    return t.conversations.select("conv_id", "turn", F.posexplode(F.slice(F.split("text", " "), 1, 3)).alias("pos", "w")).select("conv_id", "turn", "pos", F.round(1.0 / (F.col("pos") + 1), 6).alias("weight"))


@query("txt34_category", "SELECT p_partkey, CASE WHEN list_contains(string_split(lower(p_type), ' '), 'promo') THEN 'offer' WHEN contains(lower(p_type), 'eco') THEN 'green' ELSE 'other' END AS category FROM part")
def txt34(t: Inputs):
    words = F.split(F.lower("p_type"), " ")
    return t.part.select("p_partkey", F.when(F.array_contains(words, "promo"), "offer").when(F.contains(F.lower("p_type"), F.lit("eco")), "green").otherwise("other").alias("category"))


@query("txt38_number_prefix", "SELECT p_partkey FROM part WHERE starts_with(upper(replace(replace(p_name, '-', ''), ' ', '')), 'SMALLR')")
def txt38(t: Inputs):
    return t.part.filter(F.upper(F.regexp_replace("p_name", "[- ]", "")).startswith("SMALLR")).select("p_partkey")


@query("txt44_stems", "SELECT p_partkey, regexp_extract(p_type, '^([A-Z]+)', 1) AS head, nullif(regexp_extract(p_name, '([0-9]+)$', 1), '') AS tail FROM part")
def txt44(t: Inputs):
    return t.part.select("p_partkey", F.regexp_extract("p_type", "^([A-Z]+)", 1).alias("head"), F.nullif(F.regexp_extract("p_name", "([0-9]+)$", 1), F.lit("")).alias("tail"))


@query("misc8_reconciliation", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'unregistered' WHEN a.k IS NULL THEN 'vanished' ELSE 'known' END AS state FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey % 4 <> 0) a FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0) b ON a.k = b.k")
def misc8(t: Inputs):
    a = t.lineitem.filter("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = t.supplier.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k")).withColumn("b", F.lit(1))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("b").isNull(), "unregistered").when(F.col("a").isNull(), "vanished").otherwise("known").alias("state"))


@query("misc11_windows", "SELECT d AS days, count(*) FILTER (created_at >= TIMESTAMP '2024-01-31' - to_days(d)) AS recent, count(*) AS n FROM activity, (SELECT unnest([7, 14, 30, 90])::INT AS d) GROUP BY d")
def misc11(t: Inputs):
    w = F.array(*[F.struct(F.lit(d).alias("days"), (F.col("created_at") >= F.expr(f"timestamp_ntz'2024-01-31 00:00:00' - interval {d} days")).alias("in")) for d in (7, 14, 30, 90)])
    return t.activity.select(F.explode(w).alias("x")).groupBy(F.col("x.days").alias("days")).agg(F.count_if(F.col("x.in")).alias("recent"), F.count("*").alias("n"))


@query("misc13_ranked_sources", "SELECT c_custkey, coalesce(a, b, 'default') AS value, CASE WHEN a IS NOT NULL THEN 'curated' WHEN b IS NOT NULL THEN 'derived' ELSE 'default' END AS source FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS b FROM customer)")
def misc13(t: Inputs):
    a, b = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return t.customer.select("c_custkey", F.coalesce(a, b, F.lit("default")).alias("value"), F.when(a.isNotNull(), "curated").when(b.isNotNull(), "derived").otherwise("default").alias("source"))


@query("misc27_seat_cap", "SELECT n_nationkey, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_acctbal > 0) >= 40 AS full FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def misc27(t: Inputs):
    active = F.count_if(F.col("c_acctbal") > 0)
    return t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(active.alias("active"), (active >= 40).alias("full"))


@query("jn12_constrained_pairs", "SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 5 QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size), b.p_partkey) <= 12")
def jn12(t: Inputs):
    return O.first_others(t.part, "p_partkey", ["p_brand", "p_type"], 12, "p_size", 5).toDF("src", "dst")


@query("jn18_deduped_searches", "SELECT id FROM (SELECT id, floor(epoch_us(created_at) / 1000000)::BIGINT - lag(floor(epoch_us(created_at) / 1000000)::BIGINT) OVER (PARTITION BY user_id, app_url ORDER BY created_at, id) AS g FROM activity) WHERE g IS NULL OR g > 60")
def jn18(t: Inputs):
    return O.repeated_within(t.activity, ["user_id", "app_url"], "created_at", "id", 60).filter("not repeated").select("id")


@query("set10_repeated_bases", "SELECT regexp_replace(n, ' \\([0-9]+\\)$', '') AS base, count(*) AS n FROM (SELECT CASE WHEN p_size > 40 THEN p_type || ' (' || p_size || ')' ELSE p_type END AS n FROM part) GROUP BY 1 HAVING count(*) > 1")
def set10(t: Inputs):
    name = F.when(F.col("p_size") > 40, F.concat("p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_type"))
    return t.part.groupBy(F.regexp_replace(name, " \\([0-9]+\\)$", "").alias("base")).agg(F.count("*").alias("n")).filter("n > 1")


@query("set6_reconciled_union", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 6 = 0")
def set6(t: Inputs):
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("v"))
    return R.upserted(c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 6 = 0").withColumn("v", F.lit("x")), "c_custkey", ["v"])
