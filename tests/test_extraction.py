from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catloom.operators import extract
from catloom.operators.rules import FieldRule, RegionRule, field_values
from catloom.operators.selectors import Selector, select_nodes
from catloom.sources.html import html_nodes, page_nodes

PAGE = """<!doctype html><html><head><title>T &amp; x</title><style>a{}</style></head><body>
<div class="list main" id=top><ul><li data-k="1"><a href="/a?x=1&amp;y=2" class='n big'>A  one</a> tail
<li><a href=b>B</a><ul><li><a>inner</a></ul></ul></div>
<div class="list"><p>p1<p>p2 <b>bold<br>x</b><table><tr><td>1<td>2<tr><td>3</table></div>
<script>if (a<b) { document.write("</p><a href=z>") }</script><!-- <a href=c> --><img src=i.png><a href="c">C &#x4e2d;</a></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, "http://h.example.com/d/e", PAGE)], "page_id int, url string, html string")


def find(page, **selector):
    picked = Selector.of(**selector)
    rows = page_nodes(page).select(
        F.explode(select_nodes(F.col("nodes"), picked, F.lit(-1), F.size("nodes") - 1)).alias("n")
    )
    return [(r.n.tag, r.n.text) for r in rows.collect()]


def test_tree(page):
    nodes = {r.node_id: r for r in html_nodes(page).collect()}
    for n in nodes.values():
        up, above = n.parent_id, []
        while up != -1:
            above.append(up)
            up = nodes[up].parent_id
        assert n.depth == len(above) and all(nodes[a].node_id < n.node_id <= nodes[a].end_id for a in above)
        children = [m for m in nodes.values() if m.parent_id == n.node_id]
        assert [(m.pos, m.pos_back) for m in children] == [(i + 1, len(children) - i) for i in range(len(children))]
    tags = [nodes[i].tag for i in sorted(nodes)]
    assert tags.count("li") == 3 and tags.count("td") == 3 and tags.count("tr") == 2 and tags.count("a") == 4
    by_tag = lambda t: [n for n in nodes.values() if n.tag == t]
    assert by_tag("title")[0].text == "T & x" and 'write("</p>' in by_tag("script")[0].text
    assert [n.text for n in by_tag("p")] == ["p1", "p2 bold x"]
    assert by_tag("a")[0].attrs == {"href": "/a?x=1&y=2", "class": "n big"}
    assert by_tag("li")[0].text == "A one tail" and by_tag("a")[3].text == "C 中"


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ({"css": "a"}, ["A one", "B", "inner", "C 中"]),
        ({"css": ".list > ul > li > a"}, ["A one", "B"]),
        ({"css": "div.list.main a.big"}, ["A one"]),
        ({"css": "#top li li a, body > a"}, ["inner", "C 中"]),
        ({"css": "[data-k='1'] a[href^=\"/a\"]"}, ["A one"]),
        ({"css": "a[href$=b]"}, ["B"]),
        ({"css": "a[href*='x=1']"}, ["A one"]),
        ({"css": "a[class~=n]"}, ["A one"]),
        ({"xpath": "//div[@id='top']//a[@href]"}, ["A one", "B"]),
        ({"xpath": "//div[contains(@class,'main')]/ul/li/a"}, ["A one", "B"]),
        ({"xpath": "/html/body/a"}, ["C 中"]),
        ({"xpath": "/body"}, []),
        ({"css": "a:first-child"}, ["A one", "B", "inner"]),
        ({"css": "#top > ul > li:nth-child(2) > a"}, ["B"]),
        ({"css": "li:nth-child(odd) a:not(.big)"}, ["inner"]),
        ({"css": "li:has(> ul) > a"}, ["B"]),
        ({"css": "li + li > a, td:nth-last-of-type(1)"}, ["B", "2", "3"]),
        ({"css": "p ~ table td:first-of-type"}, ["1", "3"]),
        ({"css": "td:nth-child(-n+1)"}, ["1", "3"]),
        ({"css": "a:empty"}, []),
        ({"xpath": "//a[1]"}, ["A one", "B", "inner", "C 中"]),
        ({"xpath": "//li[2]/a"}, ["B"]),
        ({"xpath": "//td[last()] | //a[text()='inner']"}, ["inner", "2", "3"]),
        ({"xpath": "//a[contains(text(), 'one') or @href='b']"}, ["A one", "B"]),
        ({"xpath": "//a[@href and not(contains(@href, 'x'))]"}, ["B", "C 中"]),
        ({"xpath": "//li[a[1]]"}, None),
        ({"xpath": "//p/following-sibling::table//td[position()<2]"}, ["1", "3"]),
        ({"css": "a >"}, None),
        ({"css": "a:hover"}, None),
        ({"xpath": "//a/text()"}, None),
        ({"xpath": "//a[@x][1]"}, None),
        ({"css": "b", "xpath": "//a"}, ["bold x"]),
        ({}, []),
    ],
)
def test_selectors(page, selector, texts):
    if texts is None:
        with pytest.raises(ValueError, match="not supported"):
            Selector.of(**selector)
        return
    assert [t for _, t in find(page, **selector)] == texts


def values(page, rule, limit=-1):
    column = field_values(F.col("nodes"), rule, F.lit(-1), F.size("nodes") - 1, limit)
    return page_nodes(page).select(column).first()[0]


def test_field_rules(page):
    assert values(page, FieldRule(css="a", attr="href")) == ["/a?x=1&y=2", "b", "", "c"]
    assert values(page, FieldRule(css="a", attr="href"), 2) == ["/a?x=1&y=2", "b"]
    assert values(page, FieldRule(css="a", attr="href", regex=r"regex:x=(\d)")) == ["1", "b", "", "c"]
    assert values(page, FieldRule(css="a", father_css="li li, #top ul")) == ["A one", "B", "inner"]
    assert values(page, FieldRule(css="a", father_css="#top", father_child_max_count=1), 3) == ["A one"]
    assert values(page, FieldRule(css="a", combine="x")) == []


def test_regions(page):
    rules = {"link": FieldRule(css="a", attr="href"), "main_title": FieldRule(css="a"), "id": FieldRule(css="a", attr="href", regex="(.)$")}
    blocks = [RegionRule(css=".list", fields=("link", "main_title")), RegionRule(css="p", fields=("main_title",), child_max_count=2)]
    got = extract.list_records(page, rules, blocks).orderBy("unit", "region_seq", "record_seq").collect()
    first = [(r.unit, r.region_seq, r.common.link, r.common.main_title, r.id) for r in got]
    assert first == [
        (0, 0, "http://h.example.com/a?x=1&y=2", "A one", ""), (0, 0, "http://h.example.com/d/b", "B", ""), (0, 0, "", "inner", ""),
        (1, 0, "", "", ""), (1, 0, "", "", ""), (1, 1, "", "", ""), (1, 1, "", "", ""),
    ]
    whole = extract.list_records(page, rules, [RegionRule(css=".list", child_block=1)], content_type="article").collect()
    assert len(whole) == 4 and all(r.product is None and r.unit == -1 for r in whole)


def test_combined_field(page):
    rules = {
        "id": FieldRule(css="a", attr="href", regex="(.)$"),
        "main_owner_id": FieldRule(css="td"),
        "link": FieldRule(combine="/p/#{NODE_CATE_LIST_COMMON_MAIN_OWNER_ID}/#{NODE_CATE_LIST_COMMON_ID}"),
    }
    got = extract.list_records(page, rules).orderBy("record_seq").collect()
    owners, ids = ["1", "2", "3"], ["2", "b", "", "c"]
    want = [f"http://h.example.com/p/{o}/{i}" for o, i in extract.all_combinations(owners, ids)]
    assert [r.common.link for r in got] == want
    assert [r.id for r in got][:5] == ["2", "b", "", "c", ""]


def test_template_errors(spark):
    for bad in ("#{NODE_OTHER}", "#{NODE_DETAIL_COMMON_SUB_OWNER_ID}"):
        with pytest.raises(ValueError):
            extract.combine_template(bad, {}, layer="CATE_LIST")
    one = extract.combine_template("https://x.example.com/home", {}, layer="CATE_LIST")
    none = extract.combine_template("/#{NODE_CATE_LIST_COMMON_ID}", {}, layer="CATE_LIST")
    r = spark.range(1).select(one.alias("one"), none.alias("none")).first()
    assert r.one == ["https://x.example.com/home"] and r.none == []


def test_triples(spark):
    rows = [
        (1, ["a", "b", "a"], ["1", "2", "3"], []), (2, ["a", "b", "c"], ["1", "2", "3"], ["x", "x", "y"]),
        (3, ["a", "a"], ["1"], []), (4, ["a", "b"], ["1", "2"], ["", ""]), (5, ["a", "b"], ["1", "2"], ["x"]),
    ]
    frame = spark.createDataFrame(rows, "k int, links array<string>, names array<string>, ids array<string>")
    got = {r.k: (r.links, r.names, r.ids) for r in extract.dedup_triples(frame).collect()}
    assert got[1] == (["a", "b"], ["1", "2"], []) and got[2] == (["a", "c"], ["1", "3"], ["x", "y"])
    assert got[3] == (["a", "a"], ["1"], []) and got[4] == (["a"], ["1"], [""]) and got[5] == (["a", "b"], ["1", "2"], ["x"])


def test_defaults(spark):
    frame = spark.createDataFrame([("", "x"), (None, "y")], "a string, b string")
    assert [r.a for r in extract.with_defaults(frame, ["a"], ["d"]).collect()] == ["d", "d"]
    for bad in (["a"], []), ([], ["d"]), (["a", "b"], ["d"]):
        with pytest.raises(ValueError):
            extract.with_defaults(frame, *bad)


def test_deep_and_broken_pages(spark):
    rows = [
        (1, "u", "<div>" * 3000 + "x"), (2, "u", '<a href="never closed><p>y</p>'), (3, "u", None), (4, "u", "</p></div>plain < text & more &lt;"),
        (5, "u", "<script>" + "var a;" * 10), (6, "u", "<!-- open <p>z</p>"), (7, "u", "<B CLASS=Q>up</b><br/>"),
    ]
    nodes = html_nodes(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    by = lambda page: [n for n in nodes if n.page_id == page]
    assert len(by(1)) == 3000 and max(n.depth for n in by(1)) == 2999 and all(n.text == "x" for n in by(1))
    assert [n.tag for n in by(2)] == ["a", "p"] and not by(3) and not by(4) and not by(6)
    assert by(5)[0].text == "var a;" * 10
    assert [(n.tag, n.text) for n in by(7)] == [("b", "up"), ("br", "")] and by(7)[0].attrs == {"class": "Q"}


def test_no_fields(page):
    with pytest.raises(ValueError):
        extract.list_records(page, {})


def test_links_below_six_hundred_elements(spark):
    frame = spark.createDataFrame([(1, "u", "<div>" * 600 + "<a>deep</a>")], "page_id int, url string, html string")
    assert find(frame, css="div > a") == [("a", "deep")] and find(frame, css="div div a") == [("a", "deep")]
