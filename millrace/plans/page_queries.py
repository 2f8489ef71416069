"""Pages, titles, terms and small service rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import hierarchy as H
from ..operators import ordered as O
from ..operators import relations as R
from ..operators import terms as T
from ..operators.ordered import seconds
from ..operators.tickets import ticket_states
from .inputs import Inputs
from .registry import query


@query("src2_leaf_scan", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND (source IS NULL OR source <> 'src1')")
def src2(t: Inputs):
    return t.documents.filter("text is not null and (source is null or source <> 'src1')").select("doc_id", "lang")


@query("src11_latest_and_trend", "WITH d AS (SELECT created_at::DATE AS day, count(*) AS n FROM activity GROUP BY 1), l AS (SELECT * FROM d ORDER BY day DESC LIMIT 20) SELECT max(day) AS latest, arg_max(n, day) AS n, list(n ORDER BY day) AS trend FROM l")
def src11(t: Inputs):
    last = t.activity.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(20)
    return last.agg(F.max("day").alias("latest"), F.max_by("n", "day").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("trend"))


@query("src20_main_block", "SELECT page_id, nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), '') AS block FROM pages")
def src20(t: Inputs):
    return t.pages.select("page_id", F.nullif(F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1), F.lit("")).alias("block"))


@query("src21_vehicle_sets", "SELECT brand, list_sort(list(DISTINCT car_stem)) AS car_models, count(DISTINCT blob_id) AS pages FROM occurrences GROUP BY 1")
def src21(t: Inputs):
    return t.occurrences.groupBy("brand").agg(F.array_sort(F.collect_set("car_stem")).alias("car_models"), F.countDistinct("blob_id").alias("pages"))


_PHRASES = "SELECT DISTINCT lower(split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2)) AS phrase FROM part UNION SELECT lower(split_part(p_type, ' ', 1)) FROM part"


@query("jn25_phrases_in_texts", f"WITH p AS (SELECT phrase FROM ({_PHRASES}) WHERE trim(phrase) <> ''), x AS (SELECT p_partkey AS id, ' ' || lower(p_type || ' ' || p_name) || ' ' AS text FROM part) SELECT id, phrase, row_number() OVER (PARTITION BY id ORDER BY length(phrase) DESC, phrase) AS place FROM x JOIN p ON contains(x.text, ' ' || p.phrase || ' ') QUALIFY place <= 16")
def jn25(t: Inputs):
    words = F.split("p_type", " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    phrases = t.part.select(F.explode(F.array(F.lower(F.concat_ws(" ", word(0), word(1))), F.lower(word(0)))).alias("phrase")).filter("trim(phrase) <> ''").distinct()
    texts = t.part.select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("text"))
    return T.phrases_in_texts(texts, "id", "text", phrases, "phrase", 16)


@query("jn27_segment_overlap", "SELECT DISTINCT a.p_partkey AS tool, b.n_nationkey AS wanted FROM (SELECT p_partkey, unnest(string_split(upper(p_type), ' ')) AS s FROM part) a JOIN (SELECT n_nationkey, unnest(['ECONOMY', upper(substr(n_name, 1, 6)), CASE WHEN n_nationkey % 2 = 0 THEN 'STEEL' ELSE 'BRASS' END]) AS s FROM nation) b USING (s)")
def jn27(t: Inputs):
    tools = t.part.select(F.col("p_partkey").alias("tool"), F.explode(F.split(F.upper("p_type"), " ")).alias("s"))
    wanted = t.nation.select(F.col("n_nationkey").alias("wanted"), F.explode(F.array(F.lit("ECONOMY"), F.upper(F.substring("n_name", 1, 6)), F.when(F.col("n_nationkey") % 2 == 0, "STEEL").otherwise("BRASS"))).alias("s"))
    return tools.join(wanted, "s").select("tool", "wanted").distinct()


@query("gr4_title_walk", """WITH w AS (SELECT c_custkey AS path_id, r_name AS a, CASE WHEN c_custkey % 3 = 0 THEN n_name || '?' ELSE n_name END AS b FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT path_id, n.id FROM w JOIN nodes r ON r.parent_id IS NULL AND r.title = w.a JOIN nodes n ON n.parent_id = r.id AND (n.title = w.b OR n.title = w.a || ': ' || w.b)""")
def gr4(t: Inputs):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(t.nation, "n_nationkey").join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    last = F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name"))
    return H.resolved_titles(t.nodes, c.select(F.col("c_custkey").alias("path_id"), F.array("r_name", last).alias("segments")), 2)


@query("txt2_breadcrumbs", r"SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'repair' WHEN contains(lower(p_type), 'brass') THEN 'diagram' ELSE 'other' END AS kind, trim(regexp_replace(regexp_replace(p_brand || ' [2019-2021]: ' || p_type, '\[[^\]]*\]', '', 'g'), '\s+', ' ', 'g')) AS path FROM part")
def txt2(t: Inputs):
    kind = F.when(F.contains(F.lower("p_type"), F.lit("steel")), "repair").when(F.contains(F.lower("p_type"), F.lit("brass")), "diagram").otherwise("other")
    path = F.trim(F.regexp_replace(F.regexp_replace(F.concat("p_brand", F.lit(" [2019-2021]: "), "p_type"), r"\[[^\]]*\]", ""), r"\s+", " "))
    return t.part.select("p_partkey", kind.alias("kind"), path.alias("path"))


@query("txt5_relative_paths", "SELECT page_id, replace(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', ''), '/'), lambda x: x <> '')[2:], ' > '), '%2F', '⁄') AS path FROM pages")
def txt5(t: Inputs):
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?://", ""), "/"), lambda x: x != "")
    return t.pages.select("page_id", F.replace(F.array_join(F.slice(parts, 2, 1 << 20), " > "), F.lit("%2F"), F.lit("⁄")).alias("path"))


@query("txt11_trigger_sentence", r"SELECT conv_id, turn, nullif(trim(regexp_extract(text, '(?i)([^.?!]*(?:^|[^\p{L}])(?:the|der|la|el|le)(?:$|[^\p{L}])[^.?!]*[.?!]?)', 1)), '') AS sentence FROM conversations")
def txt11(t: Inputs):
    return t.conversations.select("conv_id", "turn", F.nullif(F.trim(F.regexp_extract("text", r"(?i)([^.?!]*(?:^|[^\p{L}])(?:the|der|la|el|le)(?:$|[^\p{L}])[^.?!]*[.?!]?)", 1)), F.lit("")).alias("sentence"))


@query("txt21_normalised", r"SELECT conv_id, turn, trim(regexp_replace(translate(lower(text), 'يكأإآۀة۰۱۲۳۴۵۶۷۸۹', 'یکاااهه0123456789'), '[\x{064B}-\x{0652}\x{200C}\s]+', ' ', 'g')) AS plain FROM conversations")
def txt21(t: Inputs):
    return t.conversations.select("conv_id", "turn", T.normalised(F.col("text")).alias("plain"))


@query("txt22_display", r"SELECT p_partkey, trim(regexp_replace(p_type, '^(?:PROMO|ECONOMY|SMALL)\s+', '')) AS shown FROM part")
def txt22(t: Inputs):
    return t.part.select("p_partkey", F.trim(F.regexp_replace("p_type", r"^(?:PROMO|ECONOMY|SMALL)\s+", "")).alias("shown"))


@query("txt27_lazy_images", r"""SELECT page_id, regexp_replace(regexp_replace(html, '<img\s+src="/?([^":]*)"', '<img loading="lazy" src="/media/\1"', 'g'), '<img\s+src="', '<img loading="lazy" src="', 'g') AS html FROM pages""")
def txt27(t: Inputs):
    moved = F.regexp_replace("html", r'<img\s+src="/?([^":]*)"', '<img loading="lazy" src="/media/$1"')
    return t.pages.select("page_id", F.regexp_replace(moved, r'<img\s+src="', '<img loading="lazy" src="').alias("html"))


@query("txt37_number_forms", "SELECT p_partkey, CASE WHEN length(n) = 10 THEN n[1:5] || '-' || n[6:10] ELSE n END AS shown FROM (SELECT p_partkey, upper(replace(replace(lpad(p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 8 END, 'a-'), '-', ''), ' ', '')) AS n FROM part)")
def txt37(t: Inputs):
    even, odd = F.lpad(F.col("p_partkey").cast("string"), 10, "a-"), F.lpad(F.col("p_partkey").cast("string"), 8, "a-")
    return t.part.select("p_partkey", T.number_form(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)).alias("shown"))


@query("txt41_candidate_terms", r"SELECT p_partkey, term FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '\[[^\]]*\]', '', 'g'), '^P[0-9]{4}\s*', '')) AS term FROM part) WHERE length(term) BETWEEN 3 AND 80 AND length(regexp_replace(term, '[^A-Za-z]', '', 'g')) >= 3 AND lower(term) NOT IN ('the', 'and', 'other')")
def txt41(t: Inputs):
    return T.candidate_terms(t.part.select("p_partkey", F.col("p_name").alias("term")), "term")


@query("txt45_electrified", "SELECT p_partkey, regexp_matches(lower(p_type), '\\b(hybrid|plated|electric)\\b') AS electrified, regexp_matches(lower(p_type), '\\belectric\\b') AS pure FROM part")
def txt45(t: Inputs):
    return t.part.select("p_partkey", F.lower("p_type").rlike("\\b(hybrid|plated|electric)\\b").alias("electrified"), F.lower("p_type").rlike("\\belectric\\b").alias("pure"))


@query("txt32_variant_fit", "SELECT occ_id, round((CASE WHEN occ_id % 4 = 0 THEN 0.8::DOUBLE ELSE 1 END) * (CASE WHEN blob_id % 50 < 20 THEN 0.85::DOUBLE ELSE 1 END), 4) AS fit FROM occurrences")
def txt32(t: Inputs):
    return t.occurrences.select("occ_id", F.round(T.variant_fit(F.col("occ_id") % 4 == 0, F.col("blob_id") % 50 < 20), 4).alias("fit"))


@query("fb5_coverage_gaps", r"WITH g AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS w FROM benchmark), q AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> ''))) AS w FROM conversations WHERE role = 'user' AND text IS NOT NULL) SELECT conv_id, turn, count(*) FILTER (w IN (SELECT w FROM g)) AS matched FROM q GROUP BY 1, 2 HAVING count(*) FILTER (w IN (SELECT w FROM g)) < 2")
def fb5(t: Inputs):
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != "")
    glossary = t.benchmark.select(F.explode(words).alias("w")).distinct().withColumn("_hit", F.lit(1))
    asked = t.conversations.filter("role = 'user' and text is not null").select("conv_id", "turn", F.explode(F.array_distinct(words)).alias("w"))
    return asked.join(glossary, "w", "left").groupBy("conv_id", "turn").agg(F.count("_hit").alias("matched")).filter("matched < 2")


@query("evl19_ablations", "WITH s AS (SELECT l_orderkey AS q, l_partkey AS i, l_suppkey, l_discount AS a, l_tax AS b, unnest(['full', 'no_tax', 'fixed']) AS system, unnest([l_discount + l_tax, l_discount, 0.5::DOUBLE * (l_discount + l_tax)]) AS score FROM lineitem) SELECT q, system, i FROM s QUALIFY row_number() OVER (PARTITION BY q, system ORDER BY score DESC, i, l_suppkey) = 1")
def evl19(t: Inputs):
    variants = F.array(*[F.struct(F.lit(n).alias("system"), s.cast("double").alias("score")) for n, s in (("full", F.col("l_discount") + F.col("l_tax")), ("no_tax", F.col("l_discount")), ("fixed", 0.5 * (F.col("l_discount") + F.col("l_tax"))))])
    s = t.lineitem.select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("i"), "l_suppkey", F.inline(variants))
    return O.top_k(s, ["q", "system"], [F.desc("score"), F.col("i"), F.col("l_suppkey")], 1).select("q", "system", "i")


@query("misc2_devices", "SELECT id, CASE WHEN app_url = lag(app_url) OVER w THEN 'current' WHEN lag(app_url) OVER w IS NULL THEN 'first' ELSE 'changed' END AS device FROM activity WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)")
def misc2(t: Inputs):
    before = F.lag("app_url").over(Window.partitionBy("user_id").orderBy("created_at", "id"))
    return t.activity.select("id", F.when(F.col("app_url") == before, "current").when(before.isNull(), "first").otherwise("changed").alias("device"))


@query("misc3_overview", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER ((created_at + INTERVAL 210 MINUTE)::DATE = DATE '2024-01-10') AS today FROM activity")
def misc3(t: Inputs):
    local = F.to_date(F.expr("created_at + interval 210 minutes"))
    return t.activity.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(local == F.lit("2024-01-10").cast("date")).alias("today"))


@query("misc5_validated", "SELECT c_custkey, list_filter([CASE WHEN NOT regexp_matches('09' || lpad((c_custkey * 7919)::VARCHAR, 9, '0'), '^09[0-9]{9}$') THEN 'phone' END, CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END], lambda x: x IS NOT NULL) AS faults FROM customer")
def misc5(t: Inputs):
    phone = F.concat(F.lit("09"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "0"))
    faults = F.array_compact(F.array(F.when(~phone.rlike("^09[0-9]{9}$"), "phone"), F.when(F.col("c_acctbal") < 0, "balance"), F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "segment")))
    return t.customer.select("c_custkey", faults.alias("faults"))


@query("misc6_seat_plan", "SELECT o_custkey, len(list(o_orderkey)) > 0 AND bool_and(o_orderkey % 9 > 0) AS valid, sum(o_orderkey % 9)::BIGINT AS seats FROM orders GROUP BY 1")
def misc6(t: Inputs):
    seats = F.col("o_orderkey") % 9
    return t.orders.groupBy("o_custkey").agg(F.bool_and(seats > 0).alias("valid"), F.sum(seats).alias("seats"))


@query("misc19_dictionary", "SELECT phrase, list_sort(list_distinct(flatten(list(tokens)))) AS tokens FROM (SELECT lower(p_brand) AS phrase, list_filter(string_split(lower(p_type), ' '), lambda w: length(w) >= 4) AS tokens FROM part) WHERE length(phrase) >= 3 GROUP BY 1 HAVING len(list_distinct(flatten(list(tokens)))) >= 2")
def misc19(t: Inputs):
    words = t.part.select(F.lower("p_brand").alias("phrase"), F.explode(F.split(F.lower("p_type"), " ")).alias("w")).filter("length(phrase) >= 3 and length(w) >= 4")
    return words.groupBy("phrase").agg(F.array_sort(F.collect_set("w")).alias("tokens")).filter(F.size("tokens") >= 2)


#: One action a message, by its author; the ticket was created a day before the first.
_ACTIONS = "CASE author_id % 7 WHEN 0 THEN 'close' WHEN 1 THEN 'customer' WHEN 2 THEN 'reply' WHEN 3 THEN 'note' WHEN 4 THEN 'escalate' WHEN 5 THEN 'internal' ELSE CASE WHEN internal THEN 'open' ELSE 'close' END END"


@query("misc24_transitions", f"""WITH RECURSIVE a AS (SELECT request_id, {_ACTIONS} AS action, epoch(created_at)::BIGINT AS t, min(epoch(created_at)::BIGINT) OVER (PARTITION BY request_id) - 86400 AS created, row_number() OVER (PARTITION BY request_id ORDER BY created_at, id) AS i FROM message),
s AS (SELECT request_id, 0::BIGINT AS i, 'pending' AS status, 'normal' AS priority, NULL::BIGINT AS answered, NULL::BIGINT AS resolved, NULL::BIGINT AS escalated, min(created) + 259200 AS due, 0::BIGINT AS reopened FROM a GROUP BY 1
UNION ALL SELECT a.request_id, a.i,
  CASE WHEN action = 'close' THEN 'closed' WHEN action = 'open' OR (action = 'customer' AND status = 'closed') THEN 'pending' WHEN action = 'reply' AND status = 'pending' THEN 'in_progress' ELSE status END,
  CASE WHEN action = 'escalate' THEN 'high' ELSE priority END,
  CASE WHEN action IN ('reply', 'note') THEN coalesce(answered, t) ELSE answered END,
  CASE WHEN action = 'close' THEN CASE WHEN status = 'closed' THEN resolved ELSE t END WHEN (action = 'open' AND status <> 'pending') OR (action = 'customer' AND status = 'closed') OR (action = 'reply' AND status = 'pending') THEN NULL ELSE resolved END,
  CASE WHEN action = 'escalate' THEN coalesce(escalated, t) ELSE escalated END,
  CASE WHEN action = 'escalate' AND escalated IS NULL THEN created + 86400 WHEN action = 'customer' AND status = 'closed' THEN t + CASE priority WHEN 'high' THEN 86400 ELSE 259200 END ELSE due END,
  reopened + (action = 'customer' AND status = 'closed')::BIGINT
FROM s JOIN a ON a.request_id = s.request_id AND a.i = s.i + 1)
SELECT request_id, status, priority, answered, resolved, escalated, due, reopened FROM s QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY i DESC) = 1""")
def misc24(t: Inputs):
    m = t.message.withColumn("action", F.expr(_ACTIONS)).withColumn("t", seconds("created_at"))
    log = m.withColumn("created", F.min("t").over(Window.partitionBy("request_id")) - 86400)
    return ticket_states(log, "request_id", ["created_at", "id"])


@query("misc25_drafts", "SELECT t.id, count(DISTINCT m.id) AS turns FROM ticket t JOIN message m ON m.request_id = t.id WHERE t.status = 'F' AND NOT m.internal AND t.id % 4 <> 0 GROUP BY 1")
def misc25(t: Inputs):
    closed = t.ticket.filter("status = 'F' and id % 4 <> 0").select(F.col("id").alias("request_id"))
    turns = t.message.filter("not internal").withColumnRenamed("id", "message_id").join(closed, "request_id", "left_semi")
    return turns.groupBy(F.col("request_id").alias("id")).agg(F.countDistinct("message_id").alias("turns"))


@query("misc28_fleet", "SELECT n.n_nationkey AS car, count(c.c_custkey) FILTER (c.c_mktsegment = 'BUILDING') > 0 AS has_manual, count(c.c_custkey) FILTER (c.c_mktsegment = 'MACHINERY') > 0 AS has_parts FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1 HAVING count(c.c_custkey) FILTER (c.c_mktsegment IN ('BUILDING', 'MACHINERY')) > 0")
def misc28(t: Inputs):
    has = lambda s: F.coalesce(F.bool_or(F.col("c_mktsegment") == s), F.lit(False))
    g = t.nation.join(t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"), "n_nationkey", "left").groupBy(F.col("n_nationkey").alias("car")).agg(has("BUILDING").alias("has_manual"), has("MACHINERY").alias("has_parts"))
    return g.filter("has_manual or has_parts")


@query("misc29_ingested", "SELECT a.id, CASE WHEN a.category IN ('content', 'system') THEN a.category ELSE 'other' END AS category, n.n_nationkey FROM activity a LEFT JOIN nation n ON lower(n.n_name) = lower('nation_' || (a.user_id % 30)::VARCHAR)")
def misc29(t: Inputs):
    known = t.nation.select(F.lower("n_name").alias("_car"), "n_nationkey")
    a = t.activity.withColumn("_car", F.lower(F.concat(F.lit("nation_"), (F.col("user_id") % 30).cast("string"))))
    return a.join(known, "_car", "left").select("id", F.when(F.col("category").isin("content", "system"), F.col("category")).otherwise("other").alias("category"), "n_nationkey")


@query("misc31_known_states", "SELECT s.state, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS state) s LEFT JOIN orders ON o_orderstatus = s.state GROUP BY 1")
def misc31(t: Inputs):
    states = t.region.select(F.explode(F.array(*map(F.lit, "FOPX"))).alias("state")).distinct()
    return A.zero_filled(t.orders.withColumnRenamed("o_orderstatus", "state"), states, "state")


@query("misc39_single_run", "SELECT round(avg((l_quantity > 25)::INT), 6) AS hit, round(avg((l_discount < 0.03)::INT), 6) AS refused, round(avg(l_tax), 6) AS tax FROM lineitem")
def misc39(t: Inputs):
    share = lambda test: F.round(F.avg(F.expr(test).cast("int")), 6)
    return t.lineitem.agg(share("l_quantity > 25").alias("hit"), share("l_discount < 0.03").alias("refused"), F.round(F.avg("l_tax"), 6).alias("tax"))


@query("misc40_absence", r"WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS ws FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS ws FROM benchmark) SELECT item_id, count(d.doc_id) AS hits, count(d.doc_id) <= 1 AS absent FROM b LEFT JOIN d ON len(b.ws) > 0 AND list_has_all(d.ws, b.ws) GROUP BY 1")
def misc40(t: Inputs):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != ""))
    pairs = R.token_subset_pairs(t.documents.filter("text is not null").select("doc_id", words.alias("words")), "doc_id", t.benchmark.select("item_id", words.alias("words")), "item_id", "words")
    hits = pairs.groupBy("item_id").agg(F.count("*").alias("hits"))
    return t.benchmark.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) <= 1).alias("absent"))


@query("misc44_masked", "SELECT c_custkey, 'user' || c_custkey::VARCHAR || '@example.invalid' AS mail, '0900' || lpad(c_custkey::VARCHAR, 7, '0') AS phone, regexp_replace('10.0.' || (c_custkey % 256)::VARCHAR || '.' || (c_custkey % 200)::VARCHAR, '\\.[0-9]+$', '.0') AS ip FROM customer")
def misc44(t: Inputs):
    key = F.col("c_custkey").cast("string")
    ip = F.concat(F.lit("10.0."), (F.col("c_custkey") % 256).cast("string"), F.lit("."), (F.col("c_custkey") % 200).cast("string"))
    return t.customer.select("c_custkey", F.concat(F.lit("user"), key, F.lit("@example.invalid")).alias("mail"), F.concat(F.lit("0900"), F.lpad(key, 7, "0")).alias("phone"), F.regexp_replace(ip, "\\.[0-9]+$", ".0").alias("ip"))


@query("pipe4_inbox", "WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS state FROM orders WHERE o_orderkey % 4 <> 0), s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT CASE WHEN s.k IS NULL THEN 'vanished' WHEN p.k IS NULL THEN 'new' ELSE 'pending' END AS what, count(*) AS n FROM p FULL JOIN s ON p.k = s.k GROUP BY 1")
def pipe4(t: Inputs):
    pending = t.orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("p"))
    seen = t.lineitem.select(F.col("l_orderkey").alias("k")).distinct().withColumn("s", F.lit(1))
    return pending.join(seen, "k", "full_outer").groupBy(F.when(F.col("s").isNull(), "vanished").when(F.col("p").isNull(), "new").otherwise("pending").alias("what")).agg(F.count("*").alias("n"))


@query("trm7_exemplars", "WITH c AS (SELECT a.p_partkey AS term, b.p_partkey AS example FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey) SELECT term, example FROM c QUALIFY row_number() OVER (PARTITION BY term ORDER BY example) <= 5")
def trm7(t: Inputs):
    return O.first_others(t.part, "p_partkey", ["p_brand", "p_size"], 5).toDF("term", "example")
