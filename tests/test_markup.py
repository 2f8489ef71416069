"""Page readers: grids by brute force over generated tables, lists by round trips, catalogue pages by cases."""

import random
import tracemalloc
from itertools import product

from millrace.functions import markup as M
from millrace.operators import pages as P


def laid_out(rows):
    """Brute force: a canvas on which each cell covers its rectangle. rows: lists of (text, down, right)."""
    canvas = {}
    for r, cells in enumerate(rows):
        c = 0
        for text, down, right in cells:
            while (r, c) in canvas:
                c += 1
            for k in range(right):
                if (r, c + k) in canvas:
                    right = k
                    break
            for i, k in product(range(down), range(right)):
                canvas[r + i, c + k] = (text, i == 0 and k == 0)
            c += right
    return [[canvas.get((r, c), ("", False)) for c in range(max(k for i, k in canvas if i == r) + 1)] for r in range(len(rows))]


def test_spans():
    rng = random.Random(1)
    for _ in range(300):
        rows = [[(f"t{r}.{c}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2])) for c in range(rng.randint(1, 4))] for r in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d} colspan='{w}'>{t}" + rng.choice(["", "</td>"]) for t, d, w in cells) + rng.choice(["", "</tr>"]) for cells in rows) + "</table>"
        got = [[(c["text"], c["fresh"]) for c in cells] for *_, cells in M.grids(html)]
        assert got == laid_out(rows)


def test_inner_tables_heads_and_titles():
    html = "<h3>A</h3><table><thead><tr><th>x<th>y</thead><tbody><tr><td>1<td>2<table><tr><td>in</td></tr></table></tbody></table><h4>B</h4><table><tr><td>only"
    rows = list(M.grids(html))
    assert [(n, r, title, heads) for n, r, title, heads, _ in rows] == [(0, 0, "A", ["x", "y"]), (0, 1, "A", ["x", "y"]), (1, 0, "A", None), (2, 0, "B", None)]
    assert [c["text"] for c in rows[1][4]] == ["1", "2 in"]
    assert list(M.grids(None)) == list(M.grids("")) == list(M.grids("<table></table><tr>")) == []
    assert [c["text"] for c in next(M.grids("<table><tr><td rowspan=x colspan='0'>a<td>b"))[4]] == ["a", "b"]


def test_deep_and_broken_pages():
    assert M.page_tree("<div>" * 50_000 + "x").text() == "x"
    assert M.page_tree("</p><b>a</i></b>c<br>d<").text().startswith("a c d")
    assert len(list(M.list_rows("<ul><li><a>x</a>" * 3000))) == 3000


def random_tree(rng, depth=0):
    return [(f"t{rng.randrange(99)}", random_tree(rng, depth + 1) if depth < 4 and rng.random() < 0.5 else []) for _ in range(rng.randint(0, 4))]


def flat(tree, above=None, depth=0, out=None):
    out = [] if out is None else out
    for place, (title, below) in enumerate(tree):
        at = len(out)
        out.append((at, above, place, depth, title, "root" if above is None else "folder" if below else "leaf"))
        flat(below, at, depth + 1, out)
    return out


def as_list(tree):
    return "<ul>" + "".join(f"<li><a href='{t}.html'>{t}</a>{as_list(b) if b else ''}</li>" for t, b in tree) + "</ul>"


def as_sidebar(tree):
    return "".join(f"<details><summary>{t}</summary><div class=grp>{as_sidebar(b)}</div></details>" if b else f"<a class='leaf' href='{t}'>{t}</a>" for t, b in tree)


def test_lists_round_trip():
    rng = random.Random(2)
    for _ in range(200):
        tree = random_tree(rng)
        assert [(n, p, k, d, t, kind) for n, p, k, d, t, _, _, kind in M.list_rows(f"<div>{as_list(tree)}</div>")] == flat(tree)
        whole = [("top", tree)]
        if tree:
            assert [(n, p, k, d, t, kind) for n, p, k, d, t, _, _, kind in M.list_rows(as_sidebar(whole))] == flat(whole)


def test_list_entries_without_links():
    rows = list(M.list_rows("<ul><li>plain<ul><li><a name='x/'>X</a></li></ul></li></ul>"))
    assert [(r[0], r[1], r[4], r[5]) for r in rows] == [(0, None, "X", "x/")]


HEAD = "<thead><tr><th>Number<th>Name<th>Code<th>Note<th>Quantity<th>Range</thead>"


def test_group_page_cases():
    kinds = ["Electrical"]
    page = "<title>Electrical | a</title>"
    assert M.group_page(None, kinds)["status"] == M.group_page(" \n", kinds)["status"] == "empty_page"
    assert M.group_page("<title>Just a moment...</title>", kinds)["status"] == "blocked"
    assert M.group_page("<title>Other | a</title>", kinds)["error"] == "unknown category: Other | a"
    assert M.group_page(page, kinds)["status"] == "no_content"
    img = '<img data-container="zoom_container_1" alt="Fig　1" src="x">'
    assert M.group_page(page + img, kinds)["error"] == "1 sections, 0 tables"
    row = '<tr class="part-search-tr"><td>12-3<td>name<td>5</tr><tr class="part-search-tr"><td>x<td>y</tr><tr><td>a<td>b<td>c</tr>'
    found = M.group_page(page + img * 2 + f"<table>{HEAD}<tr><th>z</tr>{row}</table><table><tr><td>other</table>", kinds)
    assert found["status"] == "ok" and [s["caption"] for s in found["sections"]] == ["Fig 1"]
    assert found["sections"][0]["rows"] == [{"place": 0, "number": "123", "shown": "12-3", "name": "name", "callout": "5", "note": "", "quantity": "", "dates": ""}]
    box = '<div id="zoom_container_1">' + img + '<div data-codeonimage="a" data-position="1.6,2"></div><div data-codeonimage="b" data-position="1"></div></div>'
    found = M.group_page(page + box + f"<table>{HEAD}</table>", kinds)
    assert found["sections"][0]["callouts"] == [{"code": "a", "x": 2, "y": 2, "w": None, "h": None, "title": ""}]


def test_readers_on_edges(spark):
    pages = spark.createDataFrame([(1, None, "c/Labor Times/X⁄Y/op"), (2, "", "op"), (3, "<table><tr><td>a<td rowspan=9>b<td>c</tr><tr><td>d", ""), (3, "<table><tr><th>Suspected<th>My Symptom</tr><tr><td>s<td></tr><tr><td>t<td>u", None)], "id int, html string, path string")
    assert sorted(map(tuple, P.symptom_rows(pages, "id", "html").collect())) == [(3, "a", "b", "", ""), (3, "d", "b", "", ""), (3, "u", "t", "", "")]
    assert [tuple(r)[1:5] for r in P.labor_rows(pages.filter("id < 3"), "id", "path", "html").orderBy("id").collect()] == [("X/Y", "", "", "op"), ("", "", "", "")]
    assert P.tool_rows(pages, "id", "html").count() == 0 and P.table_rows(pages.limit(0), "html").count() == 0
    facts = P.spec_facts(pages.filter("id < 3"), "id", "html").orderBy("id").collect()
    assert [(r.fluids, r.tank_l, r.engine, r.auto_trans) for r in facts] == [([], None, None, False)] * 2


def test_crawled_titles(spark):
    rows = spark.createDataFrame([("ADAS _ AD",), ("QT023A_ Multi  point",), (" ",), (None,), ("a/b",)], "t string")
    assert [r[0] for r in rows.select(P.crawled_title(rows.t)).collect()] == ["ADAS ⁄ AD", "QT023A: Multi point", "(untitled)", "(untitled)", "a⁄b"]


def test_plain_pages_need_no_parser_and_read_the_same(monkeypatch):
    plain = '<h2>A &amp; B</h2><table><tr><th>x</th></tr><tr><td rowspan="1">1</td><td><a href="p.html">o</a></td></tr></table>'
    odd = plain.replace("<tr><td", "<TR ><td", 1)
    assert list(M.grids(plain)) == list(M.grids(odd))
    fed = []
    monkeypatch.setattr(M._Builder, "feed", lambda self, rest: fed.append(rest))
    assert [(title, len(cells)) for _, _, title, _, cells in M.grids(plain)] == [("A & B", 1), ("A & B", 2)] and not fed
    list(M.grids(odd))
    assert fed == [odd[odd.index("<TR") :]]


def test_large_pages_are_not_held_as_trees():
    def peak(read, page):
        read(page)  # what is loaded once is not counted
        tracemalloc.start()
        try:
            return read(page), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    tree = "<table>" + "".join(f'<tr class="treegrid-{i}"><td><a href="/g?gid={i}">n</a></td></tr>' for i in range(4000)) + "</table>"
    whole = peak(M.page_tree, tree)[1]
    rows, held = peak(lambda p: sum(1 for _ in M.tree_rows(p)), tree)
    assert rows == 4000 and held < 0.5 * whole
    row = '<tr class="part-search-tr"><td>1</td><td>n</td><td>c</td><td></td><td>2</td><td></td></tr>'
    parts = "<title>E | x</title>" + "".join(f'<img data-container="zoom_container_{i}"><table>{HEAD}{row * 100}</table>' for i in range(40))
    whole = peak(M.page_tree, parts)[1]
    found, held = peak(lambda p: M.group_page(p, ["E"], M._packed_rows), parts)
    assert sum(len(s["rows"]) for s in found["sections"]) == 4000 and held < 0.5 * whole
