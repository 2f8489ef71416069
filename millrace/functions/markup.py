"""Pages as trees: a lenient reader, tables as grids, nested lists as parent links, catalogue pages as nested records.

Each reader is a Python function of one page's text; `read_pages` puts them into DataFrames, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element that ends open ones of these tags, up to the given border.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"td", "th", "tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"div", "td", "li", "table"}), "tbody": ({"td", "th", "tr", "thead", "tbody"}, {"table"}), "thead": ({"td", "th", "tr", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}


#: Text and a plain tag behind it, of which all readings are the same: small letters, quoted attributes, no references in them.
_PLAIN = re.compile(r'([^<]*)<(?:/([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"<>&]*")*))>')
_PLAIN_ATTRIBUTE = re.compile(r' ([a-z-]+)="([^"]*)"')
#: Elements whose content is not marked up, or may not be.
_RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())
_TABLES = frozenset("table h1 h2 h3 h4 h5 h6".split())
_NO_ATTRIBUTES: dict[str, str] = {}


class Element:
    """A tag with its attributes and its parts (texts and elements) in order."""

    __slots__ = ("tag", "attrs", "parts", "above")

    def __init__(self, tag: str, attrs: dict[str, str], above: Element | None):
        self.tag, self.attrs, self.above = tag, attrs, above
        self.parts: list[str | Element] = []

    def walk(self) -> Iterator[Element]:
        """The elements below in document order; deep pages are no trouble, as nothing recurses."""
        left = [p for p in reversed(self.parts) if isinstance(p, Element)]
        while left:
            e = left.pop()
            yield e
            left.extend(p for p in reversed(e.parts) if isinstance(p, Element))

    def children(self, *tags: str) -> list[Element]:
        return [p for p in self.parts if isinstance(p, Element) and p.tag in tags]

    def first(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags), None)

    def texts(self) -> Iterator[str]:
        left: list[str | Element] = list(reversed(self.parts))
        while left:
            p = left.pop()
            if isinstance(p, str):
                yield p
            elif p.tag not in ("script", "style"):
                left.extend(reversed(p.parts))

    def text(self) -> str:
        """All text below, pieces parted by a blank, white space collapsed."""
        if len(self.parts) == 1 and isinstance(self.parts[0], str):
            return " ".join(self.parts[0].split())
        return " ".join(" ".join(self.texts()).split())

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    """Builds the tree of a page; or, with wanted and done, gives each outermost wanted element to done when it ends, and keeps nothing."""

    def __init__(self, wanted: Callable[[Element], bool] | None = None, done: Callable[[Element], None] | None = None):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("", {}, None)
        self.wanted, self.done = wanted, done
        self.held = None if wanted else self.root  # elements in it are kept
        self.tables: list[Element] = []  # and headings, in document order

    def read(self, html: str) -> None:
        """The whole page: plain tags at its beginning by one pattern, the rest, from the first other one on, by the parser."""
        at, match = 0, _PLAIN.match
        while m := match(html, at):
            text, end, start, attrs = m.groups()
            if start in _RAW:
                break
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if end:
                self.handle_endtag(end)
            else:
                self.handle_starttag(start, _PLAIN_ATTRIBUTE.findall(attrs) if attrs else ())
            at = m.end()
        if at < len(html):
            self.feed(html[at:] if at else html)
        self.close()
        if self.wanted:
            self._leave(self.root)

    def _leave(self, to: Element) -> None:
        """Ends the open elements up to one."""
        if self.wanted and self.held is not None:
            at = self.open
            while at is not to:
                if at is self.held:
                    self.held = None
                    self.done(at)
                    break
                at = at.above
        self.open = to

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            ended, border = _ENDS[tag]
            at, last = self.open, None
            while at.above is not None and at.tag not in border:
                if at.tag in ended:
                    last = at
                at = at.above
            if last is not None:
                self._leave(last.above)
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else _NO_ATTRIBUTES, self.open)
        if self.held is not None:
            self.open.parts.append(e)
            if tag in _TABLES:
                self.tables.append(e)
        elif self.wanted(e):
            if tag in _VOID:
                self.done(e)
            else:
                self.held = e
        if tag not in _VOID:
            self.open = e

    def handle_endtag(self, tag):
        at = self.open
        while at.above is not None and at.tag != tag:
            if at.tag == "table" and tag in ("td", "th", "tr"):
                return  # a stray end must not leave the inner table
            at = at.above
        if at.above is not None:
            self._leave(at.above)

    def handle_data(self, data):
        if self.held is not None:
            self.open.parts.append(data)


def page_tree(html: str | None) -> Element:
    """The tree of a page; a null page is an empty one."""
    b = _Builder()
    b.read(html or "")
    return b.root


def outermost(html: str | None, wanted: Callable[[Element], bool], seen: Callable[[Element], None]) -> None:
    """Shows the wanted elements that lie in no other one, in document order, and all in them: each is dropped when it is seen."""

    def done(e: Element) -> None:
        seen(e)
        for inner in e.walk():
            seen(inner)

    _Builder(wanted, done).read(html or "")


def _span(cell: Element, name: str) -> int:
    """A rowspan or colspan, 1 if it is no number; within the limits that browsers set."""
    n = cell.attrs.get(name, "").strip()
    return min(max(int(n), 1), 1000) if n.isascii() and n.isdigit() else 1


def _own_rows(table: Element) -> list[tuple[Element, bool]]:
    """Rows of a table and whether they are in its head; those of inner tables are not its own."""
    out = []
    for part in table.children("tr", "thead", "tbody", "tfoot"):
        out += [(part, False)] if part.tag == "tr" else [(tr, part.tag == "thead") for tr in part.children("tr")]
    return out


def _cell(c: Element, in_head: bool) -> dict:
    text = c.text()
    if not c.parts or len(c.parts) == 1 and isinstance(c.parts[0], str):
        return {"text": text, "head": in_head or c.tag == "th", "fresh": True, "href": None, "link": None, "image": None}
    inner = list(c.walk())
    a, img = (next((e for e in inner if e.tag == tag), None) for tag in ("a", "img"))
    return {"text": text, "head": in_head or c.tag == "th", "fresh": True, "href": a.attrs.get("href") if a else None, "link": a.text() if a else None, "image": img.attrs.get("src") if img else None}



def grids(html: str | None) -> Iterator[tuple[int, int, str | None, list[str] | None, list[dict]]]:
    """(table, row, title, heads, cells) of all tables in document order, with spans resolved.

    A cell stands at each place that its rowspan and colspan cover; it is fresh at the first of them only. Rows and
    columns count from 0. A cell has its text, whether it is a header, and the target and text of its first link and the
    source of its first image. An inner table is a table of its own; its text also counts as that of the cell around it.
    title is the last heading before the table, null if there is none. heads are the
    texts of the table's first row with header cells, null before it. Rows without cells are left out of the count.
    """
    number, title = -1, None
    page = _Builder()
    page.read(html or "")
    for e in page.tables:
        if e.tag != "table":
            title = e.text()
            continue
        number += 1
        held: dict[int, tuple[int, dict]] = {}  # column: rows that a cell above still covers
        at, heads = 0, None
        for tr, in_head in _own_rows(e):
            cells = tr.children("td", "th")
            if not cells:
                continue
            read = [_cell(c, in_head) for c in cells]
            spans = [(_span(c, "rowspan"), _span(c, "colspan")) if c.attrs else (1, 1) for c in cells]
            if held or any(s != (1, 1) for s in spans):
                row: dict[int, dict] = {c: {**cell, "fresh": False} for c, (_, cell) in held.items()}
                held = {c: (n - 1, cell) for c, (n, cell) in held.items() if n > 1}
                column = 0
                for cell, (down, right) in zip(read, spans):
                    while column in row:
                        column += 1
                    for k in range(right):
                        if column + k in row:
                            break  # what a cell above covers stays
                        row[column + k] = {**cell, "fresh": k == 0}
                        if down > 1:
                            held[column + k] = (down - 1, cell)
                    column += k + 1
                empty = {"text": "", "head": False, "fresh": False, "href": None, "link": None, "image": None}
                whole = [row.get(c, empty) for c in range(max(row) + 1)]
            else:
                whole = read
            if heads is None and any(c["head"] for c in whole):
                heads = [c["text"] for c in whole]
            yield number, at, title, heads, whole
            at += 1


_STRINGS = pa.list_(pa.string())
_CELL = pa.struct([("text", pa.string()), ("head", pa.bool_()), ("fresh", pa.bool_()), ("href", pa.string()), ("link", pa.string()), ("image", pa.string())])
#: Columns of a reader's rows: names, types in SQL, and Arrow types.
GRID = {"table_no": ("int", pa.int32()), "row_no": ("int", pa.int32()), "title": ("string", pa.string()), "heads": ("array<string>", _STRINGS), "cells": ("array<struct<text:string,head:boolean,fresh:boolean,href:string,link:string,image:string>>", pa.list_(_CELL))}
#: Rows that a reader's task holds as Python objects.
_ROWS = 2000


def spread(pages: DataFrame) -> DataFrame:
    """The pages dealt evenly: reading one is much work for its bytes, so small files would leave it to a few tasks."""
    return pages.repartition(max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.sparkSession.sparkContext.defaultParallelism))


def read_pages(pages: DataFrame, html: str, columns: dict[str, tuple[str, pa.DataType]], reader: Callable[[str | None], Iterator[tuple]]) -> DataFrame:
    """The reader's rows of each page beside the page's other columns; pages without rows give none.

    Rows go on in parts of some thousand, so a large page's rows are not held together.
    """
    keep = [f for f in pages.schema if f.name != html]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{n} {kind}" for n, (kind, _) in columns.items())])
    names, types = [f.name for f in keep], [t for _, t in columns.values()]
    found = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            place = pa.array(at, pa.int64())
            beside = [batch.column(n).take(place) for n in range(len(names))]
            own = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([*beside, *own], [*names, *found])

        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                for row in reader(batch.column(len(names))[i].as_py()):
                    at.append(i)
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield made()
                        at, rows = [], []
            if rows:
                yield made()

    return spread(pages.select(*[f"`{n}`" for n in names], f"`{html}`")).mapInArrow(run, schema)


def table_rows(pages: DataFrame, html: str) -> DataFrame:
    """All table rows of the pages beside their other columns (table_no, row_no, title, heads, cells); pages without tables give none."""
    return read_pages(pages, html, GRID, grids)


def links(html: str | None) -> Iterator[tuple]:
    """(name, href, link) of a page's links: link is the text."""
    found: list[tuple] = []
    outermost(html, lambda e: e.tag == "a", lambda e: found.append((e.attrs.get("name"), e.attrs.get("href"), e.text())) if e.tag == "a" else None)
    yield from found


def anchors(pages: DataFrame, html: str) -> DataFrame:
    """All links of the pages beside their other columns: name, href, link (its text)."""
    return read_pages(pages, html, {c: ("string", pa.string()) for c in ("name", "href", "link")}, links)


LIST = {c: ("int", pa.int32()) for c in ("node", "parent", "place", "depth")} | {c: ("string", pa.string()) for c in ("title", "name", "href", "kind")}


def list_rows(html: str | None) -> Iterator[tuple]:
    """(node, parent, place, depth, title, name, href, kind) of the page's outermost nested lists, in document order.

    Nodes are numbered from 0; parent is null at the top; place counts the siblings from 0. An entry is a list item with a
    link, or a folded section (details) with its summary; entries without either are passed over and their lists hang at
    the entry above. name is a link's own anchor (a page-less folder), href its target. kind: root at the top, folder with
    entries below, else leaf.
    """
    found: list[list] = []

    def entry(e: Element) -> tuple[str, str | None, str | None] | None:
        if e.tag == "details":
            s = next(iter(e.children("summary")), None)
            return (s.text() if s else "", None, None)
        a = e if e.tag == "a" else next(iter(e.children("a")), None)
        return (a.text(), a.attrs.get("name"), a.attrs.get("href")) if a else None

    # Open parts from right to left, each with the node it hangs at and whether it is inside a list.
    left: list[tuple[Element, int | None, bool]] = [(c, None, False) for c in reversed(page_tree(html).children(*_STEPS))]
    while left:
        e, above, inside = left.pop()
        below = above
        listed = inside or e.tag in ("ul", "ol", "details")
        if e.tag == "details" or (inside and (e.tag == "li" or e.tag == "a" and "leaf" in e.classes())):
            what = entry(e)
            if what:
                below = len(found)
                found.append([below, above, 0, 0, *what, "leaf"])
        left.extend((c, below, listed) for c in reversed(e.children(*_STEPS)) if not (e.tag == "li" and c.tag == "a"))
        e.parts = []  # what the walk has passed is let go
    places: dict[int | None, int] = {}
    for row in found:
        above = row[1]
        row[2] = places.get(above, 0)
        places[above] = row[2] + 1
        row[3] = 0 if above is None else found[above][3] + 1
        if above is not None and found[above][7] == "leaf":
            found[above][7] = "folder"
    for row in found:
        yield (*row[:7], "root" if row[1] is None else row[7])


#: Elements that the walk over lists goes through.
_STEPS = frozenset("html body main article section nav div p span ul ol li details a table tbody tr td".split())


def nested_lists(pages: DataFrame, html: str) -> DataFrame:
    """Entries of the pages' nested lists beside the pages' other columns."""
    return read_pages(pages, html, LIST, list_rows)


def nfkc_text(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").split())


def _whole(numbers: str | None) -> list[int] | None:
    """Two comma-parted numbers, rounded."""
    try:
        found = [round(float(x)) for x in (numbers or "").split(",")[:2]]
    except ValueError:
        return None
    return found if len(found) == 2 else None


def group_page(html: str | None, categories: list[str], packed: Callable[[Iterator[dict]], object] = list) -> dict:
    """A catalogue page as a record: status, error, gid, category, sections with their callouts and part rows.

    Diagrams are images with a container of their own (the first of each counts); the parts table at the same place among
    the page's parts tables belongs to a diagram. Parts tables are those whose head begins with Number and Name and has a
    Quantity. status: ok, empty_page, blocked (a crawler check instead of the page), no_content, or parse_error with the
    reason, among them unequal numbers of diagrams and tables. packed makes what is kept of a table's rows.
    """
    out: dict = {"status": "ok", "error": None, "gid": None, "category": None, "sections": []}
    if not (html or "").strip():
        return out | {"status": "empty_page"}
    title, caption = "", None
    sections: dict[str, dict] = {}
    tables: list = []
    overlays: dict[str, list[dict]] = {}

    def seen(e: Element) -> None:
        nonlocal title, caption
        if e.tag == "title" and not title:
            title = e.text()
        elif e.tag == "h2":
            caption = nfkc_text(e.text()) or None
        elif e.tag == "meta" and e.attrs.get("property") == "og:url":
            m = re.search(r"[?&]gid=(\d+)", e.attrs.get("content", ""))
            out["gid"] = int(m[1]) if m else None
        elif e.tag == "table" and _is_parts_table(e):
            tables.append(packed(_part_rows(e)))
        box = e.attrs.get("data-container", "") if e.tag == "img" else ""
        if box.startswith("zoom_container_") and box not in sections:
            file = re.search(r"_assets/([A-Za-z0-9]{8}_[A-Za-z0-9.\-]+\.gif)", e.attrs.get("src", ""))
            name = file[1] if file else None
            figure = name.split("_", 1)[1].removesuffix(".gif") if name else None
            sections[box] = {"container": box, "figure": figure, "image": name, "caption": caption or nfkc_text(e.attrs.get("alt")), "callouts": [], "rows": packed(iter(()))}
        if _is_overlay(e):
            overlays.setdefault(e.attrs["id"], list(_callouts(e)))

    outermost(html, lambda e: e.tag in ("title", "h2", "meta", "table", "img") or _is_overlay(e), seen)
    if title.startswith("Just a moment"):
        return out | {"status": "blocked", "gid": None}
    category = title.split(" | ")[0].strip() if " | " in title else ""
    if category not in categories:
        return out | {"status": "parse_error", "error": f"unknown category: {title[:120]}", "gid": None}
    out["category"] = category
    if not sections and not tables:
        return out | {"status": "no_content"}
    if len(sections) != len(tables):
        return out | {"status": "parse_error", "error": f"{len(sections)} sections, {len(tables)} tables"}
    for s, table in zip(sections.values(), tables):
        s["callouts"] = overlays.get(s["container"], [])
        s["rows"] = table
    return out | {"sections": list(sections.values())}


def _is_overlay(e: Element) -> bool:
    return e.attrs.get("id", "").startswith("zoom_container_")


def _callouts(overlay: Element) -> Iterator[dict]:
    for e in overlay.walk():
        at, size = _whole(e.attrs.get("data-position")), _whole(e.attrs.get("data-size")) or [None, None]
        if e.tag == "div" and "data-codeonimage" in e.attrs and at:
            yield {"code": nfkc_text(e.attrs["data-codeonimage"]), "x": at[0], "y": at[1], "w": size[0], "h": size[1], "title": nfkc_text(e.attrs.get("data-title"))}


def _is_parts_table(table: Element) -> bool:
    head = [c.text() for tr, in_head in _own_rows(table) if in_head for c in tr.children("th", "td")]
    head = [h for h in head if h]
    return head[:2] == ["Number", "Name"] and "Quantity" in head


def _part_rows(table: Element) -> Iterator[dict]:
    rows = [tr for tr, in_head in _own_rows(table) if not in_head and any(c.startswith("part-search-tr") for c in tr.classes())]
    for n, cells in enumerate(c for c in (tr.children("td") for tr in rows) if len(c) >= 3):
        texts = [nfkc_text(c.text()) for c in cells[:6]] + [""] * max(0, 6 - len(cells))
        link = cells[0].first("a")
        asked = re.search(r"[?&]q=([A-Za-z0-9\-]+)", link.attrs.get("href", "")) if link else None
        yield {"place": n, "number": asked[1] if asked else re.sub(r"[^A-Za-z0-9]", "", texts[0]), "shown": texts[0], "name": texts[1], "callout": texts[2], "note": texts[3], "quantity": texts[4], "dates": texts[5]}


_CALLOUT = "struct<code:string,x:bigint,y:bigint,w:bigint,h:bigint,title:string>"
_ROW = "struct<place:bigint,number:string,shown:string,name:string,callout:string,note:string,quantity:string,dates:string>"
_ROW_TYPE = pa.struct([("place", pa.int64()), *((c, pa.string()) for c in ("number", "shown", "name", "callout", "note", "quantity", "dates"))])
_CALLOUT_TYPE = pa.struct([("code", pa.string()), *((c, pa.int64()) for c in "xywh"), ("title", pa.string())])
_SECTION = {"container": pa.string(), "figure": pa.string(), "image": pa.string(), "caption": pa.string(), "callouts": pa.list_(_CALLOUT_TYPE)}
GROUP = f"status string, error string, gid bigint, category string, sections array<struct<container:string,figure:string,image:string,caption:string,callouts:array<{_CALLOUT}>,rows:array<{_ROW}>>>"


def _packed_rows(rows: Iterator[dict]) -> pa.Array:
    """Rows as one Arrow array, made in parts: a large page has a hundred thousands of them."""
    made = [pa.array(part, _ROW_TYPE) for part in iter(lambda: list(islice(rows, _ROWS)), [])]
    return pa.concat_arrays(made) if made else pa.array([], _ROW_TYPE)


def _packed_sections(sections: list[dict]) -> pa.Array:
    """A page's sections with their packed rows as an array of one list."""
    rows = [s["rows"] for s in sections]
    ends = [0, *accumulate(map(len, rows))]
    own = [pa.array([s[n] for s in sections], t) for n, t in _SECTION.items()]
    below = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(rows) if rows else pa.array([], _ROW_TYPE))
    return pa.ListArray.from_arrays(pa.array([0, len(sections)], pa.int32()), pa.StructArray.from_arrays([*own, below], [*_SECTION, "rows"]))


def group_pages(pages: DataFrame, key: str, html: str, categories: list[str]) -> DataFrame:
    """key and the record of each page (status, error, gid, category, sections)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = group_page(batch.column(1)[i].as_py(), categories, _packed_rows)
                own = [pa.array([r[n]], pa.int64() if n == "gid" else pa.string()) for n in ("status", "error", "gid", "category")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *own, _packed_sections(r["sections"])], [key, "status", "error", "gid", "category", "sections"])

    return spread(pages.select(key, html)).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {GROUP}")


TREE = {"node": ("bigint", pa.int64()), "parent": ("bigint", pa.int64()), "place": ("int", pa.int32()), "label": ("string", pa.string()), "gid": ("bigint", pa.int64()), "conflict": ("boolean", pa.bool_()), "is_leaf": ("boolean", pa.bool_())}


def tree_rows(html: str | None) -> Iterator[tuple]:
    """(node, parent, place, label, gid, conflict, is_leaf) of the page's tree tables."""
    kept: dict[int, tuple] = {}
    conflicts: set[int] = set()

    def seen(tr: Element) -> None:
        named = [re.fullmatch(r"treegrid-(parent-)?(\d+)", c) for c in tr.classes()] if tr.tag == "tr" else []
        own = next((int(m[2]) for m in named if m and not m[1]), None)
        label = tr.text() if own is not None else ""
        if not label:
            return
        above = next((int(m[2]) for m in named if m and m[1]), None)
        link = tr.first("a")
        gid = re.search(r"[?&]gid=(\d+)", link.attrs.get("href", "")) if link else None
        row = (above, label, int(gid[1]) if gid else None)
        if kept.setdefault(own, row) != row:
            conflicts.add(own)

    outermost(html, lambda e: e.tag == "tr", seen)
    parents = {r[0] for r in kept.values()}
    for place, (own, (above, label, gid)) in enumerate(kept.items()):
        yield own, above, place, label, gid, own in conflicts, own not in parents


def treegrid_rows(pages: DataFrame, html: str) -> DataFrame:
    """Rows of tree tables beside the pages' other columns: node, parent, place, label, gid, conflict, is_leaf.

    Nodes and parents are numbers in the row's classes. A repeated node keeps its first row; conflict tells that a later
    one differs. A leaf is nobody's parent.
    """
    return read_pages(pages, html, TREE, tree_rows)
