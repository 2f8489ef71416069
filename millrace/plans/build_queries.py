"""Builds, layouts and publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import serving as B
from ..sources.archives import archived
from ..sources.files import work_path
from ..sources.versions import publish, read_current
from .inputs import Inputs
from .registry import query

#: Levels of the stand-in tree: regions, nations, customers.
_TREE = """WITH w AS (SELECT r.id AS r, n.id AS n, c.id AS c, r.sort_order AS ro, n.sort_order AS no, c.sort_order AS co, c.content FROM nodes r LEFT JOIN nodes n ON n.parent_id = r.id LEFT JOIN nodes c ON c.parent_id = n.id WHERE r.parent_id IS NULL),
l AS (SELECT *, row_number() OVER (ORDER BY ro, r, no NULLS FIRST, n NULLS FIRST, co NULLS FIRST, c NULLS FIRST) - 1 AS i FROM w),
"""


@query("gr10_tidy_layout", _TREE + """nx AS (SELECT r, n, min(no) AS no, (min(i) + max(i)) / 2.0 AS x FROM l GROUP BY 1, 2),
rx AS (SELECT r, (arg_min(x, (no, n)) + arg_max(x, (no, n))) / 2.0 AS x FROM nx GROUP BY 1)
SELECT id, (x * 240)::DOUBLE AS x, (d * 150)::DOUBLE AS y FROM (SELECT r AS id, x, 0 AS d FROM rx UNION ALL SELECT n, x, 1 FROM nx WHERE n IS NOT NULL UNION ALL SELECT c, i, 2 FROM l WHERE c IS NOT NULL)""")
def gr10(t: Inputs):
    return L.tidy_layout(t.nodes, ["sort_order"])


_BUILD = """WITH c AS (SELECT x.id, x.parent_id, x.content IS NOT NULL AS good, n.title AS nt, r.title AS rt, n.parent_id AS r, x.title || CASE WHEN row_number() OVER (PARTITION BY x.parent_id, x.title, x.content IS NOT NULL ORDER BY x.sort_order, x.id) > 1 THEN ' (' || row_number() OVER (PARTITION BY x.parent_id, x.title, x.content IS NOT NULL ORDER BY x.sort_order, x.id) || ')' ELSE '' END AS title FROM nodes x JOIN nodes n ON n.id = x.parent_id JOIN nodes r ON r.id = n.parent_id),
b AS (SELECT rt || '/' || nt || '/' || title AS path, rt || '/' || nt AS above, 2 AS depth, true AS is_leaf, 1::BIGINT AS kept_leaves, 0::BIGINT AS pruned_leaves FROM c WHERE good
UNION ALL SELECT rt || '/' || nt, rt, 1, false, count(*) FILTER (good), count(*) FILTER (NOT good) FROM c GROUP BY rt, nt HAVING bool_or(good)
UNION ALL SELECT r.title, NULL, 0, false, count(*) FILTER (good), count(*) FILTER (NOT coalesce(good, false)) FROM nodes r JOIN nodes n ON n.parent_id = r.id LEFT JOIN nodes x ON x.parent_id = n.id LEFT JOIN c ON c.id = x.id WHERE r.parent_id IS NULL GROUP BY r.title HAVING bool_or(good))
"""


@query("prt6_serving_build", _BUILD + "SELECT sha1(path) AS id, sha1(above) AS parent_id, path, depth, is_leaf, kept_leaves, pruned_leaves FROM b")
def prt6(t: Inputs):
    return B.serving_build(t.nodes, ["sort_order"], F.col("content").isNotNull())


@query("prt7_audited_build", _BUILD + "SELECT sha1(path) AS id, path, is_leaf FROM b")
def prt7(t: Inputs):
    root = work_path(t._spark, "build")
    build = B.serving_build(t.nodes, ["sort_order"], F.col("content").isNotNull())
    publish(t._spark, root, {"nodes": build}, {"nodes": ["id"]}, lambda w: B.build_faults(w["nodes"]))
    return read_current(t._spark, root, "nodes").select("id", "path", "is_leaf")


@query("src17_published_tables", "SELECT o_orderkey AS id, o_totalprice AS price, (SELECT count(*) FROM customer) AS customers FROM orders WHERE o_orderkey % 3 > 0")
def src17(t: Inputs):
    """The second version replaces the first."""
    root = work_path(t._spark, "tables")
    customers = t.customer.select(F.col("c_custkey").alias("id"))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    publish(t._spark, root, {"orders": orders, "customers": customers}, {"orders": ["id"], "customers": ["id"]})
    publish(t._spark, root, {"orders": orders.filter("id % 3 > 0"), "customers": customers}, {"orders": ["id"], "customers": ["id"]})
    n = read_current(t._spark, root, "customers").count()
    return read_current(t._spark, root, "orders").select("id", "price", F.lit(n).cast("long").alias("customers"))


@query("gr16_rebuilt_graph", "SELECT src_blob, dst_blob, relation, weight FROM edges QUALIFY row_number() OVER (PARTITION BY src_blob, relation ORDER BY weight DESC, dst_blob) <= 4")
def gr16(t: Inputs):
    """The graph anew: each blob's four strongest edges of each relation, without edges to nothing."""
    from ..operators.ordered import top_k

    root = work_path(t._spark, "graph")
    edges = top_k(t.edges, ["src_blob", "relation"], [F.desc("weight"), F.col("dst_blob")], 4).drop("rank")
    suppliers = t.lineitem.select(F.col("l_suppkey").alias("dst_blob")).distinct()
    dangling = lambda w: w["edges"].join(suppliers, "dst_blob", "left_anti").select(F.lit("dangling").alias("gate"), F.col("src_blob").cast("string").alias("id"))
    publish(t._spark, root, {"edges": edges}, {"edges": ["src_blob", "dst_blob", "relation"]}, dangling)
    return read_current(t._spark, root, "edges")


@query("src5_archived_pages", "SELECT page_id, coalesce(strlen(html), 0) AS size, md5(coalesce(html, '')) AS digest FROM pages")
def src5(t: Inputs):
    pages = t.pages.select(F.concat(F.lit("2020 Brand Model/"), "page_id", F.lit(".html")).alias("name"), "html")
    found = archived(pages, "name", "html")
    return found.select(F.regexp_extract("name", "/(-?[0-9]+)\\.html", 1).cast("long").alias("page_id"), "size", F.md5("content").alias("digest"))


@query("src7_archived_section", "SELECT page_id, md5(coalesce(html, '')) AS digest FROM pages WHERE page_id % 3 = 1")
def src7(t: Inputs):
    """One section's folder, chosen by name."""
    section = F.concat(F.lit("section"), F.col("page_id") % 3, F.lit("/"), "page_id", F.lit(".html"))
    found = archived(t.pages.select(section.alias("name"), "html"), "name", "html").filter("name like 'section1/%'")
    return found.select(F.regexp_extract("name", "/(-?[0-9]+)\\.html", 1).cast("long").alias("page_id"), F.md5("content").alias("digest"))
