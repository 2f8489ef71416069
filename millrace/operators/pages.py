"""Readers of manual pages on top of grids and lists: symptoms, labour times, special tools, specifications, page classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import anchors, table_rows

#: Columns of a labour-time table, and the levels of paths that are no category.
LABOR_COLUMNS = ["Applies To", "Note", "Standard Hours", "Warranty Hours", "Skill Level"]
LABOR_ROOT, LABOR_VARIANT = "Labor Times", "Other Variant"
#: Words that mark a fluid's row.
FLUID_WORDS = ["engine oil", "transmission fluid", "transaxle", "coolant", "refrigerant", "brake fluid", "differential", "transfer case", "fuel tank", "washer fluid", "power steering"]
TYRE = r"\b\d{3}/\d{2}\s?R\s?\d{2}[A-Z]{0,2}\b"


def cell(at: Column | int) -> Column:
    """Text of the row's cell at a place from 0, empty beyond its end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.coalesce(F.get(F.col("cells.text"), at), F.lit(""))


def head_like(word: str, default: int) -> Column:
    """Place of the first column whose header holds the word, in any case."""
    at = F.array_position(F.transform("heads", lambda h: F.lower(h).contains(word)), True)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(default)


def head_is(name: str, default: int) -> Column:
    at = F.array_position("heads", name)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(default)


def _data_rows(pages: DataFrame, html: str) -> DataFrame:
    return table_rows(pages, html).filter(F.exists("cells", lambda c: ~c["head"]))


def symptom_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, symptom, suspected, link_text, link_href of symptom tables.

    Columns go by header (symptom, suspected area), else they are the first and the second. A symptom over several rows
    holds for each. The link is the first one of the row's own cells. Rows of one cell or without a symptom are left out.
    """
    rows = _data_rows(pages.select(key, html), html).filter(F.size("cells") >= 2)
    link = F.get(F.filter("cells", lambda c: c["fresh"] & c["link"].isNotNull()), F.lit(0))
    out = rows.select(key, cell(head_like("symptom", 0)).alias("symptom"), cell(head_like("suspect", 1)).alias("suspected"), F.coalesce(link["link"], F.lit("")).alias("link_text"), F.coalesce(link["href"], F.lit("")).alias("link_href"))
    return out.filter("symptom <> ''")


def labor_levels(path: Column) -> list[Column]:
    """Category, two levels below it (the second takes all further ones) and operation of a labour-time path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))  # the first is the vehicle
    for name in (LABOR_ROOT, LABOR_VARIANT):
        parts = F.when(F.get(parts, F.lit(0)) == name, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    parts = F.transform(parts, lambda x: F.trim(F.replace(x, F.lit("⁄"), F.lit("/"))))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = lambda i: F.coalesce(F.get(folders, F.lit(i)), F.lit(""))
    rest = F.array_join(F.slice(folders, 3, 1 << 20), " / ")
    return [at(0).alias("category"), at(1).alias("sub1"), rest.alias("sub2"), F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")).alias("operation")]


def labor_rows(pages: DataFrame, key: str, path: str, html: str) -> DataFrame:
    """key, category, sub1, sub2, operation, and the five columns of the page's first labour-time table.

    That is one with a column Standard Hours. A column that its header does not name is taken at its usual place. A page
    without the table gives one row of blanks, so that its operation stays in a report.
    """
    fields = [c.lower().replace(" ", "_") for c in LABOR_COLUMNS]
    rows = table_rows(pages.select(key, html), html).filter(F.array_contains("heads", "Standard Hours"))
    first = rows.withColumn("_first", F.min("table_no").over(Window.partitionBy(key))).filter("table_no = _first and exists(cells, c -> not c.head)")
    data = first.select(key, *[cell(head_is(c, i)).alias(f) for i, (c, f) in enumerate(zip(LABOR_COLUMNS, fields))])
    with_path = pages.select(key, *labor_levels(F.col(path))).join(data, key, "left")
    return with_path.select(key, "category", "sub1", "sub2", "operation", *[F.coalesce(f, F.lit("")).alias(f) for f in fields])


def tool_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, number, is_component, name, note, image of tool tables: rows of four cells (picture, number, name, note).

    A number has five digits, a hyphen, five digits and more of letters, digits and hyphens; one in parentheses is part of
    a kit. Rows without such a number are left out. image is the file name of the picture.
    """
    rows = _data_rows(pages.select(key, html), html).filter((F.size("cells") == 4) & ~F.exists("cells", lambda c: c["head"]))
    number = F.regexp_extract(cell(1), r"^\(?\s*(\d{5}-\d{5}[A-Z0-9-]*)\s*\)?$", 1)
    image = F.coalesce(F.element_at(F.split(F.col("cells")[0]["image"], "/"), -1), F.lit(""))
    return rows.select(key, number.alias("number"), cell(1).startswith("(").alias("is_component"), cell(2).alias("name"), cell(3).alias("note"), image.alias("image")).filter("number <> ''")


def spec_facts(pages: DataFrame, key: str, html: str, most_fluids: int = 40) -> DataFrame:
    """A row a page: fluids (name, value; the first 40), tank_l, displacement_l, engine, tyres (sorted), auto_trans, hybrid.

    A fluid's row begins with one of the known words; its value is the rest of the row, joined. The tank's size is a number
    of litres in its value, displacement the cubic centimetres in the second cell behind its label, the engine's name the
    cell behind its label. Tyre sizes are searched in the whole text. What a page does not give is null or empty.
    """
    # Only the first of spanned cells counts, and blanks do not.
    texts = F.filter(F.transform(F.filter("cells", lambda c: c["fresh"]), lambda c: c["text"]), lambda t: t != "")
    rows = table_rows(pages.select(key, html), html).select(key, "table_no", "row_no", texts.alias("t")).filter("size(t) > 0").withColumn("label", F.col("t")[0])
    low = F.lower("label")
    fluid = F.exists(F.array(*map(F.lit, FLUID_WORDS)), lambda w: low.contains(w))
    value = F.when(F.size("t") > 1, F.array_join(F.slice("t", 2, 1 << 20), " ; ")).otherwise(F.col("label"))
    tank = F.when(low.contains("fuel tank"), F.nullif(F.regexp_extract(value, r"(\d+(?:\.\d+)?)\s*L\b", 1), F.lit("")).cast("double"))
    volume = F.when(F.col("label") == "Displacement", F.nullif(F.regexp_extract(F.coalesce(F.get("t", F.lit(2)), F.lit("")), r"^(\d{3,4})\b", 1), F.lit("")).cast("double"))
    engine = F.when(F.col("label") == "Engine Type", F.get("t", F.lit(1)))
    at = F.struct("table_no", "row_no")
    found = rows.groupBy(key).agg(
        F.slice(F.array_sort(F.collect_list(F.when(fluid, F.struct("table_no", "row_no", F.col("label").alias("name"), value.alias("value"))))), 1, most_fluids).alias("f"),
        F.min(F.when(tank.isNotNull(), F.struct(at, tank.alias("v"))))["v"].alias("tank_l"),
        F.min(F.when(volume.isNotNull(), F.struct(at, F.round(volume / 1000, 1).alias("v"))))["v"].alias("displacement_l"),
        F.min(F.when(engine.isNotNull(), F.struct(at, engine.alias("v"))))["v"].alias("engine"),
        F.coalesce(F.max(low.contains("automatic transmission fluid") & fluid), F.lit(False)).alias("auto_trans"),
        F.coalesce(F.max(F.col("label").startswith("HV Battery") | F.col("label").startswith("Hybrid System")), F.lit(False)).alias("hybrid"),
    )
    sizes = F.regexp_extract_all(F.regexp_replace(html, "<[^>]+>", " "), F.lit(f"({TYRE})"), 1)
    own = pages.select(key, F.slice(F.array_sort(F.array_distinct(sizes)), 1, 8).alias("tyres"))
    fluids = F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    none = F.expr("cast(array() as array<struct<name:string,value:string>>)")
    return own.join(found, key, "left").select(key, F.coalesce(fluids, none).alias("fluids"), "tank_l", "displacement_l", "engine", "tyres", F.coalesce("auto_trans", F.lit(False)).alias("auto_trans"), F.coalesce("hybrid", F.lit(False)).alias("hybrid"))


def page_classes(pages: DataFrame, page: str, path: str, parent_path: str, html: str) -> DataFrame:
    """page and its class: root_path (no parent), intermediate_path, or end_path.

    A page is intermediate if it has a folder anchor (a name that ends in a slash), or links, without a fragment, to a page
    whose own parent is this one; other links (to siblings, to pages elsewhere, to nothing) do not count.
    """
    found = anchors(pages.select(page, path, html), html).select(page, path, "name", "href")
    folders = found.filter("name like '%/'").select(page)
    target = F.lower(F.element_at(F.split(F.element_at(F.split("href", r"\?"), 1), "/"), -1))
    linked = found.filter("name is null and href is not null and not contains(href, '#')").select(page, path, target.alias("_target"))
    own = pages.select(F.lower(page).alias("_target"), F.col(parent_path).alias("_above"))
    children = linked.join(own, (linked["_target"] == own["_target"]) & (linked[path] == own["_above"])).select(page)
    hubs = folders.unionByName(children).distinct().withColumn("_hub", F.lit(True))
    kind = F.when(F.col(parent_path).isNull(), "root_path").when(F.col("_hub"), "intermediate_path").otherwise("end_path")
    return pages.join(hubs, page, "left").select(page, kind.alias("class"))


def crawled_title(c: Column) -> Column:
    """A title as it was before file names took away its signs: ` _ ` a slash, `_ ` after a word a colon; slashes as U+2044."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    t = F.regexp_replace(F.replace(t, F.lit(" _ "), F.lit(" / ")), r"(?<=[\w)])_ ", ": ")
    return F.coalesce(F.nullif(F.replace(t, F.lit("/"), F.lit("⁄")), F.lit("")), F.lit("(untitled)"))


def with_orphans(listed: DataFrame, pages: DataFrame, path: str) -> DataFrame:
    """Paths (with listed = true) and those pages that no list names (false), with the folders that they need.

    Folders above an orphan that nothing else has are added as well, so that every path has its parent.
    """
    known = listed.select(path, F.lit(True).alias("listed"))
    orphans = pages.select(path).distinct().join(listed.select(path), path, "left_anti")
    parts = F.split(path, "/")
    above = orphans.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias(path)).distinct().join(listed.select(path), path, "left_anti")
    return known.unionByName(above.select(path, F.lit(False).alias("listed")))
