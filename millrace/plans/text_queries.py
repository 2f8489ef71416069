"""Text, HTML and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions import text as X
from ..functions.phrases import replaced
from .inputs import Inputs
from .registry import query


@query("txt1_html_to_text")
def txt1(t: Inputs):
    return t.pages.select("page_id", X.html_to_text("html").alias("text"))


@query("txt26_sanitized_html")
def txt26(t: Inputs):
    return t.pages.select("page_id", X.sanitized_html("html").alias("html"))


@query("txt39_nfkc")
def txt39(t: Inputs):
    return t.documents.select("doc_id", X.nfkc("text").alias("text"))


@query("jn13_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def jn13(t: Inputs):
    return t.pages.select("page_id", F.explode(X.links(F.col("html"))).alias("href"))


@query("txt25_link_gate", "WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS a FROM pages) SELECT page_id, len(a) AS n, len(list_filter(a, lambda x: NOT starts_with(x, '/t'))) AS stripped FROM l")
def txt25(t: Inputs):
    a = X.links(F.col("html"))
    return t.pages.select("page_id", F.size(a).cast("long").alias("n"), F.size(F.filter(a, lambda x: ~x.startswith("/t"))).cast("long").alias("stripped"))


@query("txt3_date_windows", "SELECT doc_id, trim(regexp_replace(regexp_replace('[2019-2021] ' || text, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents")
def txt3(t: Inputs):
    return t.documents.select("doc_id", X.without_date_windows(F.concat(F.lit("[2019-2021] "), F.col("text"))).alias("title"))


@query("txt9_code_form", "SELECT p_partkey, 'P' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((p_size % 100)::VARCHAR, 2, '0') AS code FROM part")
def txt9(t: Inputs):
    raw = F.concat(F.lit("p "), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit(":"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"))
    return t.part.select("p_partkey", X.code_form(raw).alias("code"))


@query("txt28_segment_url", "SELECT p_partkey, url_encode(replace(p_type || '/' || p_name, '/', '⁄')) AS url FROM part")
def txt28(t: Inputs):
    return t.part.select("p_partkey", X.segment_url(F.concat_ws("/", "p_type", "p_name")).alias("url"))


@query("txt36_numbers", "SELECT page_id, list_filter(regexp_extract_all(regexp_replace(html, '([0-9]),([0-9])', '\\1.\\2', 'g'), '([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: contains(x, '.') OR x::DOUBLE > 20) AS numbers FROM pages")
def txt36(t: Inputs):
    return t.pages.select("page_id", X.numbers(F.col("html")).alias("numbers"))


@query("txt40_scrubbed", "SELECT doc_id, regexp_replace(text, '\\b(password|token|secret|api_key)=\\S+', '\\1=[removed]', 'gi') AS text FROM documents")
def txt40(t: Inputs):
    return t.documents.select("doc_id", X.scrubbed(F.col("text")).alias("text"))


@query("txt35_endpoint_group", "SELECT page_id, CASE WHEN starts_with(path, '/a') THEN 'first' WHEN starts_with(path, '/b') THEN 'second' ELSE array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:2], '/') END AS grp FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)")
def txt35(t: Inputs):
    return t.pages.select("page_id", X.endpoint_group(F.regexp_replace("url", "^https?://[^/]*", ""), {"/a": "first", "/b": "second"}).alias("grp"))


@query("txt24_follow_ups", "SELECT conv_id, turn, len(string_split_regex(trim(text), '\\s+')) <= 4 OR regexp_matches(lower(text), '^(and|what about|it|that|this|those|these)\\b') AS follows, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user'")
def txt24(t: Inputs):
    users = t.conversations.filter("role = 'user'")
    return users.select("conv_id", "turn", X.follows_up(F.col("text")).alias("follows"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query("txt47_phone_key", "SELECT c_custkey, right('98' || lpad(c_custkey::VARCHAR, 9, '7'), 10) AS phone FROM customer")
def txt47(t: Inputs):
    raw = F.concat(F.lit("+۹8 ("), F.lpad(F.col("c_custkey").cast("string"), 9, "7"), F.lit(")"))
    return t.customer.select("c_custkey", X.phone_key(raw).alias("phone"))


@query("scl3_bucket", "SELECT c_custkey, (('0x' || substr(sha256('beta:' || c_custkey), 1, 8))::BIGINT % 100)::INT AS bucket FROM customer")
def scl3(t: Inputs):
    return t.customer.select("c_custkey", C.bucket("beta", F.col("c_custkey")).alias("bucket"))


@query("anl8_rollout", "SELECT c_custkey, CASE WHEN c_custkey IN (3, 4) THEN false WHEN c_custkey IN (4, 5) THEN true ELSE (('0x' || substr(sha256('beta:' || c_custkey), 1, 8))::BIGINT % 100) < 30 END AS enabled FROM customer")
def anl8(t: Inputs):
    return t.customer.select("c_custkey", C.rollout("beta", F.col("c_custkey"), 30, force_on=[4, 5], force_off=[3, 4]).alias("enabled"))


@query("scl4_sla_state", "SELECT id, CASE WHEN first_response_h IS NOT NULL THEN CASE WHEN first_response_h <= due THEN 'met' ELSE 'breached' END WHEN due IS NULL THEN NULL WHEN 30 > due THEN 'breached' ELSE 'pending' END AS state FROM (SELECT *, CASE WHEN priority LIKE '1%' THEN 4 WHEN priority LIKE '5%' THEN 48 ELSE 24 END AS due FROM ticket)")
def scl4(t: Inputs):
    due = F.when(F.col("priority").startswith("1"), 4).when(F.col("priority").startswith("5"), 48).otherwise(24)
    return t.ticket.select("id", C.sla_state(due, F.col("first_response_h"), F.lit(30)).alias("state"))


@query("fb2_feedback_factor", "SELECT blob, CASE WHEN total < 3 THEN 1.0 WHEN net >= 0 THEN round(1 + net * 0.2, 6) ELSE round(1 + net * 0.15, 6) END AS factor FROM (SELECT id % 97 AS blob, count(*) FILTER (feedback <> 0) AS total, (count(*) FILTER (feedback > 0) + 0.5 * count(*) FILTER (grounded) - count(*) FILTER (feedback < 0)) / (count(*) FILTER (feedback <> 0) + 1)::DOUBLE AS net FROM chat GROUP BY 1)")
def fb2(t: Inputs):
    g = t.chat.groupBy((F.col("id") % 97).alias("blob")).agg(F.count_if(F.col("feedback") > 0).alias("up"), F.count_if("grounded").alias("clicks"), F.count_if(F.col("feedback") < 0).alias("down"), F.count_if(F.col("feedback") != 0).alias("total"))
    return g.select("blob", F.round(C.feedback_factor(F.col("up"), F.col("clicks"), F.col("down"), F.col("total")), 6).alias("factor"))


@query("gov7_outcome", "SELECT o_orderkey, CASE WHEN s < 400 THEN 'success' WHEN s IN (401, 403, 429) THEN 'denied' ELSE 'failure' END AS outcome FROM (SELECT o_orderkey, 398 + o_orderkey % 40 AS s FROM orders)")
def gov7(t: Inputs):
    return t.orders.select("o_orderkey", C.outcome(398 + F.col("o_orderkey") % 40).alias("outcome"))


@query("scl12_seat_price", "SELECT p_partkey, (least(p_size, 5) * 10 + greatest(0, least(p_size, 20) - 5) * 8 + greatest(0, p_size - 20) * 6)::BIGINT AS price FROM part")
def scl12(t: Inputs):
    return t.part.select("p_partkey", C.seat_price(F.col("p_size")).cast("long").alias("price"))


@query("scl9_cosine", "SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def scl9(t: Inputs):
    from ..operators.retrieval import cosine

    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("e2")), 6).alias("sim"))


@query("scl1_local_day", "SELECT timezone('Asia/Tehran', timezone('UTC', ts))::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def scl1(t: Inputs):
    return t.events.select(F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tehran"), "ts")).alias("day")).groupBy("day").agg(F.count("*").alias("n"))


@query("scl10_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def scl10(t: Inputs):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_DICTIONARY = "SELECT lower(p_type) AS phrase, 'T' || count(*) AS r FROM part WHERE p_size % 2 = 0 GROUP BY 1 UNION SELECT lower(split_part(p_type, ' ', 1) || '-' || split_part(p_type, ' ', 2)), 'U' || count(*) FROM part GROUP BY 1 UNION SELECT lower(split_part(p_type, ' ', 1)), 'V' || count(*) FROM part GROUP BY 1"


@query("txt23_longest_phrases", f"""WITH RECURSIVE d AS (SELECT replace(phrase, '-', ' ') AS phrase, min(r) AS r FROM ({_DICTIONARY}) WHERE trim(phrase) NOT IN ('', '-') GROUP BY 1),
x AS (SELECT p_partkey AS id, string_split(p_type || ' ' || p_name || ' ' || p_type, ' ') AS w FROM part),
m AS (SELECT x.id, i, k, d.r FROM x, unnest(range(1, len(w) + 1)) a(i), (VALUES (1), (2), (3)) b(k) JOIN d ON d.phrase = lower(array_to_string(w[i:i + k - 1], ' ')) AND i + k - 1 <= len(w)),
b AS (SELECT id, i, max(k) AS k, arg_max(r, k) AS r FROM m GROUP BY 1, 2),
s AS (SELECT id, 1::BIGINT AS i, []::VARCHAR[] AS out FROM x UNION ALL SELECT s.id, s.i + coalesce(b.k, 1), list_append(s.out, coalesce(b.r, x.w[s.i])) FROM s JOIN x ON x.id = s.id AND s.i <= len(x.w) LEFT JOIN b ON b.id = s.id AND b.i = s.i)
SELECT id, array_to_string(arg_max(out, i), ' ') AS text FROM s GROUP BY id""")
def txt23(t: Inputs):
    words = F.split(F.lower("p_type"), " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    counted = lambda rows, phrase, letter: rows.groupBy(phrase.alias("phrase")).agg(F.concat(F.lit(letter), F.count("*")).alias("r"))
    terms = counted(t.part.filter("p_size % 2 = 0"), F.lower("p_type"), "T").unionByName(counted(t.part, F.concat_ws("-", word(0), word(1)), "U")).unionByName(counted(t.part, word(0), "V"))
    texts = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name", "p_type").alias("t"))
    return replaced(texts, "t", terms, "phrase", "r", "text").select("id", "text")
