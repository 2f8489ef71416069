"""Relations that the registered queries read: the given tables, and stand-ins for logs, tickets and trees derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each is one SELECT over given tables in braces; Spark and the checking SQL build the same relation from it.
STAND_INS = {
    "activity": "SELECT event_id AS id, user_id, user_id % 7 AS company_id, event_type AS action, CASE WHEN event_type IN ('view', 'click') THEN 'content' WHEN event_type = 'error' THEN 'system' ELSE 'account' END AS category, ts AS created_at, value, props, concat('s', CAST(user_id % 11 AS STRING)) AS app_url FROM {events}",
    "chat": "SELECT event_id AS id, user_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('c', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING)) END AS session_id, event_type = 'purchase' AS grounded, event_type = 'error' AS degraded, CAST(floor(value) AS BIGINT) AS latency_ms, CAST(CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 THEN -1 ELSE 0 END AS INT) AS feedback, ts AS created_at FROM {events}",
    "traffic": "SELECT date_trunc('hour', ts) AS bucket, event_type AS endpoint, CASE WHEN user_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, CAST(1 AS BIGINT) AS requests, CAST(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS errors_4xx, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS errors_5xx, CAST(floor(value * 10) AS BIGINT) AS total_ms, CAST(floor(value * 10) AS BIGINT) AS max_ms, user_id FROM {events}",
    "ticket": "SELECT o_orderkey AS id, o_custkey AS company_id, o_custkey % 50 AS created_by, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 50 AS BIGINT) END AS first_response_h, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 200 AS BIGINT) END AS resolved_h, CASE WHEN o_orderkey % 6 = 0 THEN CAST(1 + o_orderkey % 5 AS INT) END AS csat FROM {orders}",
    "message": "SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, l_orderkey AS request_id, l_suppkey AS author_id, l_returnflag = 'A' AS internal, l_linestatus = 'O' AS from_customer, l_shipdate AS created_at FROM {lineitem}",
    "nodes": "SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS title, CAST(NULL AS STRING) AS content, CAST(r_regionkey AS BIGINT) AS sort_order FROM {region} UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name, CAST(NULL AS STRING), CAST(n_nationkey AS BIGINT) FROM {nation} UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), c_name, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_mktsegment END, CAST(c_custkey AS BIGINT) FROM {customer}",
    "occurrences": "SELECT l_orderkey * 10 + l_linenumber AS occ_id, l_partkey AS blob_id, concat('car', CAST(l_suppkey % 12 AS STRING)) AS car_stem, concat('brand', CAST(l_suppkey % 3 AS STRING)) AS brand FROM {lineitem}",
    "blobs": "SELECT p_partkey AS blob_id, p_name AS title, p_brand AS brand, p_type AS component, p_size AS size, p_retailprice AS price FROM {part}",
    "edges": "SELECT l_partkey AS src_blob, l_suppkey AS dst_blob, CASE WHEN l_returnflag = 'A' THEN 'labor' WHEN l_returnflag = 'N' THEN 'semantic' ELSE 'crosslink' END AS relation, max(l_quantity) AS weight FROM {lineitem} GROUP BY 1, 2, 3",
    "sections": "SELECT concat(source, '/', lang) AS section, doc_id AS node, text AS content, source AS car_stem FROM {documents}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Inputs:
    """Tables and stand-ins of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in STAND_INS[name]}
        return self._spark.sql(STAND_INS[name], **used)


def with_stand_ins(sql: str) -> str:
    """A checking query with the definitions of the stand-ins that it names."""
    used = [f"{n} AS ({q.format(**{t: t for t in TABLES})})" for n, q in STAND_INS.items() if f" {n} " in f" {sql} ".replace("\n", " ").replace(",", " ").replace(")", " ").replace("(", " ")]
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + body[15:]
    return "WITH " + ", ".join(used) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
