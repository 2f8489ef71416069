"""Page parsing: each query writes pages from the given tables and reads them back; SQL gives what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators import pages as P
from .inputs import Inputs
from .registry import query


def _page(rows: DataFrame, key: str, order: list[str], before, after="</table>") -> DataFrame:
    """key and html: the column tr of the key's rows in order, within a head and an end."""
    trs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "tr"))), lambda x: x["tr"]), "")
    return rows.groupBy(key).agg(trs.alias("trs")).select(key, F.concat(before, "trs", F.lit(after)).alias("html"))


@query("txt13_symptom_table", "SELECT o_custkey AS page, o_orderpriority AS symptom, 'area ' || o_orderstatus AS suspected, 'o' || o_orderkey AS link_text, 'p' || o_orderkey || '.html' AS link_href FROM orders")
def txt13(t: Inputs):
    w = Window.partitionBy("page", "o_orderpriority")
    o = t.orders.withColumnRenamed("o_custkey", "page").withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("o_orderkey")))
    symptom = F.when(F.col("i") == 1, F.concat(F.lit('<td rowspan="'), "n", F.lit('">'), "o_orderpriority", F.lit("</td>"))).otherwise("")
    rest = F.concat(F.lit("<td>area "), "o_orderstatus", F.lit('</td><td><a href="p'), "o_orderkey", F.lit('.html">o'), "o_orderkey", F.lit("</a></td>"))
    even = F.col("page") % 2 == 0
    rows = o.withColumn("tr", F.concat(F.lit("<tr>"), F.when(even, F.concat(symptom, rest)).otherwise(F.concat(rest, symptom)), F.lit("</tr>")))
    head = F.when(even, "<h2>Problem Symptoms</h2><table><tr><th>Symptom</th><th>Suspected Area</th><th>Link</th></tr>").otherwise("<table><thead><tr><th>Suspected Area</th><th>Link</th><th>Symptom</th></tr></thead>")
    return P.symptom_rows(_page(rows, "page", ["o_orderpriority", "o_orderkey"], head), "page", "html")


@query("txt14_labor_table", """WITH p AS (SELECT c_custkey AS page, replace(c_mktsegment, 'U', 'U/') AS category, 'n' || c_nationkey AS sub1, CASE WHEN c_custkey % 3 = 0 THEN 'a / b' ELSE '' END AS sub2, 'op' || c_custkey AS operation FROM customer)
SELECT p.*, coalesce(o_orderstatus, '') AS applies_to, coalesce(o_orderpriority, '') AS note, coalesce((o_orderkey % 97)::VARCHAR, '') AS standard_hours, coalesce((o_orderkey % 89)::VARCHAR, '') AS warranty_hours, CASE WHEN o_orderkey IS NULL OR page % 5 = 0 THEN '' ELSE 'L' || (o_orderkey % 4) END AS skill_level FROM p LEFT JOIN orders ON o_custkey = page""")
def txt14(t: Inputs):
    values = {"Applies To": F.col("o_orderstatus"), "Note": F.col("o_orderpriority"), "Standard Hours": (F.col("o_orderkey") % 97).cast("string"), "Warranty Hours": (F.col("o_orderkey") % 89).cast("string"), "Skill Level": F.concat(F.lit("L"), F.col("o_orderkey") % 4)}
    orders = [P.LABOR_COLUMNS[k:] + P.LABOR_COLUMNS[:k] for k in range(3)] + [P.LABOR_COLUMNS[:4]]  # the last lacks a column
    which = F.when(F.col("page") % 5 == 0, 3).otherwise((F.col("page") % 3).cast("int"))
    pick = lambda made: F.element_at(F.array(*made), which + 1)
    o = t.orders.withColumnRenamed("o_custkey", "page")
    rows = o.withColumn("tr", pick([F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), values[c], F.lit("</td>")) for c in cs], F.lit("</tr>")) for cs in orders]))
    head = pick([F.lit("<p>x</p><table><tr><td>no hours here</td></tr></table><table><tr>" + "".join(f"<th>{c}</th>" for c in cs) + "</tr>") for cs in orders])
    html = _page(rows, "page", ["o_orderkey"], head)
    path = F.concat(F.lit("car1/Labor Times/"), F.when(F.col("page") % 2 == 1, "Other Variant/").otherwise(""), F.replace("c_mktsegment", F.lit("U"), F.lit("U⁄")), F.lit("/n"), "c_nationkey", F.when(F.col("page") % 3 == 0, "/a/b").otherwise(""), F.lit("/op"), "page")
    pages = t.customer.withColumnRenamed("c_custkey", "page").select("page", path.alias("path")).join(html, "page", "left")
    return P.labor_rows(pages, "page", "path", "html")


@query("txt15_tool_table", "SELECT p_size AS page, lpad(p_partkey::VARCHAR, 5, '0') || '-' || lpad(p_size::VARCHAR, 5, '0') AS number, p_partkey % 2 = 0 AS is_component, p_name AS name, p_type AS note, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey || '.png' END AS image FROM part WHERE p_partkey % 7 <> 0")
def txt15(t: Inputs):
    number = F.concat(F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("-"), F.lpad(F.col("p_size").cast("string"), 5, "0"))
    shown = F.when(F.col("p_partkey") % 7 == 0, "see above").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), number, F.lit(")"))).otherwise(number)
    image = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit('<img src="/media/sst/'), "p_partkey", F.lit('.png">')))
    tr = F.concat(F.lit("<tr><td>"), image, F.lit("</td><td>"), shown, F.lit("</td><td>"), F.replace("p_name", F.lit(" "), F.lit("<br/>")), F.lit("</td><td>"), "p_type", F.lit("</td></tr><tr><td colspan=2>spacer</td></tr>"))
    rows = t.part.withColumnRenamed("p_size", "page").withColumn("p_size", F.col("page")).withColumn("tr", tr)
    return P.tool_rows(_page(rows, "page", ["p_partkey"], F.lit("<table><tr><th>Picture<th>Number<th>Name<th>Note</tr>")), "page", "html")


@query("txt18_spec_facts", """SELECT s_suppkey AS page, ['Engine Oil: SAE 5W-30 ; ' || (s_suppkey % 9) || '.5 L', 'Fuel Tank Capacity: ' || (40 + s_suppkey % 30) || ' L'] AS fluids, (40 + s_suppkey % 30)::DOUBLE AS tank_l, CASE WHEN s_suppkey % 4 > 0 THEN round((1000 + s_suppkey % 2000) / 1000.0, 1)::DOUBLE END AS displacement_l, 'K' || s_suppkey AS engine, CASE WHEN s_suppkey % 2 = 0 THEN ['195/65R15', '205/55R16'] ELSE ['205/55R16'] END AS tyres, false AS auto_trans, s_suppkey % 5 = 0 AS hybrid FROM supplier""")
def txt18(t: Inputs):
    k = F.col("s_suppkey")
    html = F.concat(
        F.lit("<h4>Fluids</h4><table><tr><th>Item</th><th>Type</th><th>Quantity</th></tr><tr><td>Engine Oil</td><td>SAE 5W-30</td><td>"), k % 9, F.lit(".5 L</td></tr><tr><td>Paint</td><td>red</td></tr><tr><td colspan=2>Fuel Tank Capacity</td><td>"), 40 + k % 30,
        F.lit(" L</td></tr></table><table><tr><td>Displacement</td><td>cc</td><td>"), F.when(k % 4 > 0, (1000 + k % 2000).cast("string")).otherwise("unknown"), F.lit(" x</td></tr><tr><td>Engine Type</td><td>K"), k, F.lit("</td></tr>"),
        F.when(k % 5 == 0, "<tr><td>HV Battery</td><td>1</td></tr>").otherwise(""), F.lit("</table><p>Tyres: <b>205/55R16</b>"), F.when(k % 2 == 0, ", 195/65R15, 205/55R16").otherwise(""), F.lit("</p>"))
    facts = P.spec_facts(t.supplier.select(k.alias("page"), html.alias("html")), "page", "html")
    return facts.withColumn("fluids", F.transform("fluids", lambda f: F.concat_ws(": ", f["name"], f["value"])))


def _tree_pages(t: Inputs) -> DataFrame:
    """A page for each region with its nations and their customers as nested lists."""
    item = F.concat(F.lit('<li><a href="pages/'), "id", F.lit('.html">'), "title", F.lit("</a>"))
    n = t.nodes.withColumn("li", item)
    order = lambda extra: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "id", extra.alias("li")))), lambda x: x["li"]), "")
    leaves = n.filter("id like 'c%'").groupBy("parent_id").agg(order(F.concat("li", F.lit("</li>"))).alias("below")).withColumnRenamed("parent_id", "id")
    nations = n.filter("id like 'n%'").join(leaves, "id", "left").withColumn("li", F.concat("li", F.coalesce(F.concat(F.lit("<ul>"), "below", F.lit("</ul>")), F.lit("")), F.lit("</li>")))
    lists = nations.groupBy("parent_id").agg(order(F.col("li")).alias("below")).withColumnRenamed("parent_id", "id")
    return n.filter("id like 'r%'").join(lists, "id", "left").select(F.col("id").alias("page"), F.concat(F.lit('<div class="main"><h1>'), "title", F.lit("</h1><ul>"), F.coalesce("below", F.lit("")), F.lit("</ul></div>")).alias("html"))


@query("txt6_nested_lists", """WITH f AS (SELECT id, parent_id, title, sort_order FROM nodes WHERE parent_id IS NOT NULL)
SELECT id, CASE WHEN parent_id LIKE 'n%' THEN parent_id END AS parent_id, CASE WHEN parent_id LIKE 'r%' THEN parent_id ELSE (SELECT max(x.parent_id) FROM nodes x WHERE x.id = f.parent_id) END AS page, title, (row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, id) - 1)::INT AS place, (parent_id LIKE 'n%')::INT AS depth, CASE WHEN parent_id LIKE 'r%' THEN 'root' ELSE 'leaf' END AS kind FROM f""")
def txt6(t: Inputs):
    found = M.nested_lists(_tree_pages(t), "html").withColumn("id", F.regexp_extract("href", "pages/(.*)\\.html", 1)).select("page", "node", "parent", "id", "title", "place", "depth", "kind")
    above = found.select("page", F.col("node").alias("parent"), F.col("id").alias("parent_id"))
    return found.join(above, ["page", "parent"], "left").select("page", "id", "parent_id", "title", "place", "depth", "kind")


@query("txt4_page_classes", "SELECT id || '.html' AS page, CASE WHEN parent_id IS NULL THEN 'root_path' WHEN id IN (SELECT parent_id FROM nodes) THEN 'intermediate_path' ELSE 'end_path' END AS class FROM nodes")
def txt4(t: Inputs):
    n = t.nodes
    page = F.concat("id", F.lit(".html"))
    links = n.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: F.concat(F.lit('<a href="pages/'), F.upper(x), F.lit('.html">x</a>'))), "").alias("below"))
    # Links up, to itself and into pages do not make a page a hub, nor does a bookmark.
    html = F.concat(F.coalesce("below", F.lit("")), F.lit('<a name="s1">s</a><a href="'), F.coalesce("parent_id", F.lit("none")), F.lit('.html">up</a><a href="#s1">s</a><a href="n1.html#x">y</a>'))
    pages = n.join(links, "id", "left").select(page.alias("page"), F.col("id").alias("path"), "parent_id", html.alias("html"))
    return P.page_classes(pages, "page", "path", "parent_id", "html")


@query("txt7_listed_and_orphans", """WITH p AS (SELECT c_custkey AS k, n_name || '/' || c_mktsegment || '/' || c_name AS path, n_name AS a, n_name || '/' || c_mktsegment AS b FROM customer JOIN nation ON n_nationkey = c_nationkey),
l AS (SELECT a AS path FROM p WHERE k % 10 <> 0 UNION SELECT b FROM p WHERE k % 10 <> 0 UNION SELECT path FROM p WHERE k % 10 <> 0), o AS (SELECT a AS path FROM p WHERE k % 10 = 0 UNION SELECT b FROM p WHERE k % 10 = 0 UNION SELECT path FROM p WHERE k % 10 = 0)
SELECT path, true AS listed FROM l UNION ALL SELECT path, false FROM o WHERE path NOT IN (SELECT path FROM l)""")
def txt7(t: Inputs):
    files = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name", "c_mktsegment", "c_name")
    leaf = F.concat(F.lit('<a class="leaf" href="x/'), "c_custkey", F.lit('">'), "c_name", F.lit("</a>"))
    grouped = files.filter("c_custkey % 10 <> 0").groupBy("n_name", "c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list(leaf)), "").alias("leaves"))
    folded = grouped.select("n_name", F.concat(F.lit("<details><summary> "), "c_mktsegment", F.lit('</summary><div class="grp">'), "leaves", F.lit("</div></details>")).alias("d"))
    sidebar = folded.groupBy("n_name").agg(F.concat(F.lit("<details><summary>"), "n_name", F.lit("</summary>"), F.array_join(F.array_sort(F.collect_list("d")), ""), F.lit("</details>")).alias("html"))
    entries = M.nested_lists(sidebar, "html").select("n_name", "node", "parent", P.crawled_title(F.col("title")).alias("title"))
    two = entries.alias("e").join(entries.alias("m"), (F.col("e.n_name") == F.col("m.n_name")) & (F.col("e.parent") == F.col("m.node")), "left")
    three = two.join(entries.alias("t"), (F.col("m.n_name") == F.col("t.n_name")) & (F.col("m.parent") == F.col("t.node")), "left")
    listed = three.select(F.concat_ws("/", "t.title", "m.title", "e.title").alias("path"))
    return P.with_orphans(listed, files.select(F.concat_ws("/", "n_name", "c_mktsegment", "c_name").alias("path")), "path")


#: The catalogue's categories.
CATEGORIES = ["Engine/Fuel/Tool", "Power Train/Chassis", "Body/Interior", "Electrical"]


def _catalogue_pages(t: Inputs) -> DataFrame:
    """A page for each brand, a diagram and a table for each size; brands ending in 5 lack their last table."""
    p = t.part.select(F.col("p_brand").alias("page"), "p_size", "p_partkey", "p_name", "p_type")
    tr = F.concat(F.lit('<tr class="odd part-search-tr-1"><td><a href="/search?q=N'), "p_partkey", F.lit('">N-'), "p_partkey", F.lit("</a></td><td>"), "p_name", F.lit("</td><td>"), F.col("p_partkey") % 50, F.lit("</td><td>"), "p_type", F.lit("</td><td>0"), F.col("p_partkey") % 4, F.lit("</td></tr>"))
    sections = p.withColumn("tr", tr).groupBy("page", "p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "tr"))), lambda x: x["tr"]), "").alias("trs"))
    box = F.concat(F.lit("zoom_container_"), "p_size")
    image = F.concat(F.lit("<h2>Plate "), "p_size", F.lit('</h2><div id="'), box, F.lit('"><img data-container="'), box, F.lit('" src="/_assets/ABCDEFGH_F'), "p_size", F.lit('.gif"><div class="lable" data-codeonimage="'), "p_size", F.lit('" data-position="'), F.col("p_size") * 2, F.lit(".4,7\" data-size=\"10,20\" data-title=\"t\"></div></div>"))
    table = F.concat(F.lit("<table><thead><tr><th>Number</th><th>Name</th><th>Code</th><th>Note</th><th>Quantity</th><th>Range</th></tr></thead><tbody>"), "trs", F.lit("</tbody></table>"))
    last = F.max("p_size").over(Window.partitionBy("page"))
    cut = F.when((F.substring("page", -1, 1) == "5") & (F.col("p_size") == last), "").otherwise(table)
    whole = sections.withColumn("part", F.concat(image, cut)).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_size", "part"))), lambda x: x["part"]), "").alias("body"))
    return whole.select("page", F.concat(F.lit('<html><head><title>Electrical | x</title><meta property="og:url" content="/g?a=1&amp;gid='), F.regexp_extract("page", "[0-9]+", 0), F.lit('"></head><body>'), "body", F.lit("</body></html>")).alias("html"))


_GID = "regexp_extract(p_brand, '[0-9]+')::BIGINT"


@query("txt16_group_pages", f"""WITH s AS (SELECT p_brand AS page, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS section FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT p_brand AS page, {_GID} AS gid, 'ok' AS status, s.section::INT AS section, 'Plate ' || s.p_size AS caption, 'F' || s.p_size AS figure, s.p_size || '@' || (s.p_size * 2) || ',7,10,20,t' AS callouts, row_number() OVER (PARTITION BY p_brand, s.p_size ORDER BY p_partkey) - 1 AS place, 'N' || p_partkey AS number, 'N-' || p_partkey AS shown, p_name AS name, (p_partkey % 50)::VARCHAR AS callout, p_type AS note, '0' || (p_partkey % 4) AS quantity
FROM part p JOIN s ON s.page = p_brand AND s.p_size = p.p_size WHERE p_brand NOT LIKE '%5'
UNION ALL SELECT p_brand, {_GID}, 'parse_error', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_brand LIKE '%5' GROUP BY p_brand""")
def txt16(t: Inputs):
    found = M.group_pages(_catalogue_pages(t), "page", "html", CATEGORIES)
    s = found.select("page", "gid", "status", F.posexplode_outer("sections").alias("section", "s"))
    callouts = F.array_join(F.transform("s.callouts", lambda c: F.concat(c["code"], F.lit("@"), F.concat_ws(",", c["x"], c["y"], c["w"], c["h"], c["title"]))), ";")
    return s.select("page", "gid", "status", "section", "s.caption", "s.figure", callouts.alias("callouts"), F.explode_outer("s.rows").alias("r")).select("page", "gid", "status", "section", "caption", "figure", "callouts", "r.place", "r.number", "r.shown", "r.name", "r.callout", "r.note", "r.quantity")


@query("txt16_treegrid", "SELECT p_brand AS page, p_partkey AS node, CASE WHEN p_partkey % 3 > 0 AND EXISTS (SELECT 1 FROM part x WHERE x.p_brand = p.p_brand AND x.p_partkey < p.p_partkey) THEN (SELECT min(x.p_partkey) FROM part x WHERE x.p_brand = p.p_brand) END AS parent, p_name AS label, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS gid, p_partkey % 5 = 0 AS conflict FROM part p")
def txt16_treegrid(t: Inputs):
    p = t.part.select(F.col("p_brand").alias("page"), "p_partkey", "p_name").withColumn("least", F.min("p_partkey").over(Window.partitionBy("page")))
    above = F.when((F.col("p_partkey") % 3 > 0) & (F.col("p_partkey") > F.col("least")), F.concat(F.lit(" treegrid-parent-"), "least")).otherwise("")
    label = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('<a href="/g?gid='), "p_partkey", F.lit('">'), "p_name", F.lit("</a>"))).otherwise(F.col("p_name"))
    row = lambda text: F.concat(F.lit('<tr class="treegrid-'), "p_partkey", above, F.lit('"><td>'), text, F.lit("</td></tr>"))
    again = F.when(F.col("p_partkey") % 5 == 0, row(F.concat(label, F.lit(" !")))).when(F.col("p_partkey") % 7 == 0, row(label)).otherwise("")
    pages = _page(p.withColumn("tr", F.concat(row(label), again)), "page", ["p_partkey"], F.lit("<table>"))
    return M.treegrid_rows(pages, "html").select("page", "node", "parent", "label", "gid", "conflict")
