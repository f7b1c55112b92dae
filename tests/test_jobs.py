"""Whole jobs: runs that follow each other, runs that are lost and come again, detail pages, the table of states."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catloom.jobs.category_tree import CategoryTreeJob, TreeRules
from catloom.jobs.list_content import ListContentJob, ListRules
from catloom.manifest import Conflict
from catloom.operators.progress import COMPLETED, SAME_ITEMS
from catloom.operators.records import RECORD, DetailRules, detail_records
from catloom.operators.rules import FieldRule
from catloom.operators.state_table import StateTable
from catloom.session import scratch

RULES = ListRules({
    "link": FieldRule(css="a", attr="href"), "main_title": FieldRule(css="a"), "id": FieldRule(css="a", attr="href", regex=r"/(\w+)"),
    "price": FieldRule(css="b"),
})
PAGE = "link_index long, page_no long, page_id long, url string, html string"


def page(spark, *rows):
    html = lambda ids: "".join(f'<a href="/{i}">T{i}</a><b>{i[-1:]}.5</b>' if i else "<a>no id</a>" for i in ids)
    return spark.createDataFrame([(k, n, 100 * (k or 0) + n, f"http://x.y/{k}/{n}", html(ids)) for k, n, ids in rows], PAGE)


def links(spark, **last):
    return spark.createDataFrame([(int(k[1:]), n) for k, n in last.items()], "link_index long, last_page_no long")


def tiers(out):
    return {(r["_id"], r.tier, r.iid, r.page_id) for r in out.collect()}


def md5(spark, *ids):
    return [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(F.md5("id")).collect()]


@pytest.fixture(scope="module")
def catalog(spark):
    """Two runs over the lists."""
    job = ListContentJob(spark, scratch(spark, "job"), RULES, cache_ttl=50, page_ttl=500, length=1)
    pages = page(spark, (1, 0, ["a1", "b2", "a1"]), (1, 1, ["c3", ""]), (2, 0, ["b2"]), (3, 0, ["z9"]), (None, 0, ["n1"]))
    first = tiers(job.run(links(spark, _1=1, _2=4), pages, now=100, tag="one"))
    return job, pages, first


def test_a_run_over_lists(spark, catalog):
    job, pages, first = catalog
    a, b, c = md5(spark, "a1", "b2", "c3")
    assert first == {(a, "new", 1, 100), (b, "new", 2, 100), (c, "new", 3, 101)}
    row = job.store.read().filter(F.col("_id") == b).first()
    assert job.store.read().schema.names[: len(RECORD.names)] == RECORD.names
    assert (row.iid, row.crawl_url, row.crawl_time, row.user_index, row.system_version, row.ects_4, row.update_time) == (2, "http://x.y/1/0", 100, -1, "0.1", 0, 0)
    assert row.common.link == "http://x.y/b2" and row.common.main_title == "Tb2" and row.common.publish_time == 0
    assert row.content.product.price == 2.5 and row.content.sku_colors == [] and row.content.tags == []
    assert {r.key: r.value for r in job.progress.read(now=101).collect()} == {"1": COMPLETED, "2": "http://x.y/2/0"}


def test_a_run_that_comes_again_replaces_itself(spark, catalog):
    job, pages, _ = catalog
    more = pages.unionByName(page(spark, (2, 1, ["b2", "d4"]), (2, 2, ["c3"])))
    b, c, d = md5(spark, "b2", "c3", "d4")
    put = job.pages.put

    def lost(*args, **options):
        raise RuntimeError("lost")

    # The store and the cache are written when the run is lost.
    job.pages.put = lost
    with pytest.raises(RuntimeError, match="lost"):
        job.run(links(spark, _1=1, _2=4), more, now=120, tag="two")
    job.pages.put = put
    again = tiers(job.run(links(spark, _1=1, _2=4), more, now=120, tag="two"))
    assert again == {(b, "cache", None, 201), (d, "new", 5, 201), (c, "cache", None, 202)}
    assert job.store.read().count() == 4
    # Nothing is open now; the cache's clock is over for the first ids, the pages' is not.
    assert tiers(job.run(links(spark, _1=1, _2=4), more, now=160, tag="three")) == set()
    seen_again = page(spark, (2, 3, ["b2", "d4"]), (2, 4, ["a1"]))
    a, = md5(spark, "a1")
    assert tiers(job.run(links(spark, _1=1, _2=4), seen_again, now=160, tag="four")) == {(b, "store", None, 203), (d, "cache", None, 203), (a, "store", None, 204)}
    assert {r.key: r.value for r in job.progress.read(now=160).collect()} == {"1": COMPLETED, "2": COMPLETED}


def test_a_list_without_new_items_ends(spark):
    job = ListContentJob(spark, scratch(spark, "job"), RULES, streak=2, length=1)
    pages = page(spark, (1, 0, ["a1"]), (1, 1, ["a1"]), (1, 2, []), (2, 0, ["b1"]), (2, 1, ["b1"]), (2, 2, ["c1"]))
    job.run(pages.select("link_index").distinct(), pages, now=1, tag="t")
    assert {r.key: r.value for r in job.progress.read(now=2).collect()} == {"1": SAME_ITEMS, "2": "http://x.y/2/2"}
    more = page(spark, (1, 3, ["d1"]), (2, 3, ["e1"]))
    assert {r.page_id for r in job.open_pages(more.select("link_index"), more, now=3).collect()} == {203}


DETAIL = DetailRules({
    "id": FieldRule(css="h1"), "summary": FieldRule(css="p"), "main_owner_link": FieldRule(css="a", attr="href"), "price": FieldRule(css="b"),
    "publish_time": FieldRule(css="time"), "sku_color_names": FieldRule(css="i"), "sku_color_links": FieldRule(css="i", attr="title"), "tags": FieldRule(css="u"),
})


def test_details_are_merged(spark, catalog):
    job, _, _ = catalog
    a, b, x = md5(spark, "a1", "b2", "x0")
    rows = [
        (1, "http://x.y/d1", '<h1>a1</h1><p>good</p><a href="o">O</a><b>9</b><time>77</time><i title="l1">red</i><i title="l2">blue</i><u>["s","t"]</u>'),
        (2, "http://x.y/d2", "<h1>b2</h1><p></p>"), (3, "http://x.y/d3", "<h1>x0</h1>"), (4, "http://x.y/d4", "<h1>a1</h1><p>later</p>"),
        (5, "http://x.y/d5", "<p>no id</p>"), (6, "http://x.y/d6", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for _ in range(2):
        out = {(r["_id"], r.page_id, r.known) for r in job.add_details(pages, DETAIL, now=900, tag="details").collect()}
        assert out == {(a, 1, True), (b, 2, True), (x, 3, False)}
    docs = {r["_id"]: r for r in job.store.read().collect()}
    assert x not in docs and docs[a].iid == 1 and docs[a].update_url == "http://x.y/d1" and docs[a].update_time == 900
    assert docs[a].common.summary == "good" and docs[a].common.main_owner_link == "http://x.y/o" and docs[a].common.publish_time == 77
    assert docs[a].common.main_title == "Ta1" and docs[a].content.product.price == 9.0 and docs[a].content.tags == ["s", "t"]
    assert [(c.name, c.link) for c in docs[a].content.sku_colors] == [("red", "l1"), ("blue", "l2")]
    assert docs[b].common.summary == "" and docs[b].content.product.price == 2.5 and docs[b].update_time == 900
    assert detail_records(pages.limit(0), DETAIL).count() == 0


def test_detail_rules_are_checked():
    with pytest.raises(ValueError, match="no detail field"):
        DetailRules({"id": FieldRule(css="a"), "colour": FieldRule(css="b")})
    with pytest.raises(ValueError, match="its id"):
        DetailRules({"summary": FieldRule(css="a")})


def test_state_table(spark):
    table = StateTable(spark, scratch(spark, "state"), length=1, fan=2)
    rows = lambda *kv: spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(kv)], "key string, value string, pos long")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "key string")
    got = lambda now, **o: sorted(((r.key, r.value) for r in table.get(asked, now=now, **o).collect()), key=str)
    assert got(0) == [("a", None), ("a", None), ("b", None), ("c", None), (None, None)]
    table.put(rows(("a", "1"), ("a", "2"), ("b", "3"), (None, "4")), now=10, ttl=10, tag="t1")
    table.put(rows(("c", "5")), now=11, ttl=0, tag="t2")
    assert got(19) == [("a", "2"), ("a", "2"), ("b", "3"), ("c", "5"), (None, None)]
    assert got(20) == [("a", None), ("a", None), ("b", None), ("c", "5"), (None, None)]
    assert got(15, without="t2")[3] == ("c", None)
    table.put(rows(("a", "6")), now=30, ttl=10, tag="t3")
    for n in range(4, 9):
        table.put(rows((f"k{n}", "v")), now=30 + n, ttl=1000, tag=f"t{n}")
    assert got(39)[0] == ("a", "6") and got(40)[0] == ("a", None)
    # What has expired leaves with the merge of the oldest runs.
    table.put(rows(("z", "v")), now=5000, ttl=10, tag="t9")
    table.put(rows(("y", "v")), now=5001, ttl=10, tag="t10")
    table.put(rows(("x", "v")), now=5002, ttl=10, tag="t11")
    assert {r.key for r in table.read(now=5003).collect()} == {"c", "x", "y", "z"}
    kept = table.store._rows(table.store._runs()[1]).select("key").collect()
    assert "b" not in {r.key for r in kept}


# The category tree

TREE = TreeRules(link=FieldRule(css="a", attr="href"), name=FieldRule(css="a"), level_regex={1: r"c=(\d+)"})
TREE_PAGE = "page_id long, url string, html string, level int, limit_cate_level_0_id int, cate_names_path array<string>"


def tree_page(spark, *rows):
    html = lambda items: "".join(f'<a href="{h}">{n}</a>' for h, n in items)
    return spark.createDataFrame([(i, f"http://x.y/p{i}", html(items), len(path) - 1, 7, path) for i, path, items in rows], TREE_PAGE)


def test_a_category_tree_grows(spark, monkeypatch):
    job = CategoryTreeJob(spark, scratch(spark, "tree"), TREE)
    assert job.links().count() == 0 and job.filled().count() == 0
    entries = spark.createDataFrame([("http://x.y/p1>>>7>Books",), ("http://x.y/p2>>>8>Arts",), (" ",)], "line string")
    pages = tree_page(spark, (1, ["Books"], [("/b?c=1", "Novels"), ("/b?c=2", "Poems"), ("/other?c=1", "Again"), ("javascript:x()", "Gone"), ("/more", "更多")]))
    new = lambda out: {(r.url, r.level, r.line) for r in out.collect()}
    books = {
        ("http://x.y/p1", 0, "http://x.y/p1--0>>>7>Books"), ("http://x.y/p2", 0, "http://x.y/p2--0>>>8>Arts"),
        ("http://x.y/b?c=1", 1, "http://x.y/b?c=1--1>>>7>Books||Novels"), ("http://x.y/b?c=2", 1, "http://x.y/b?c=2--1>>>7>Books||Poems"),
    }
    assert new(job.run(tag="one", entries=entries, pages=pages)) == books
    index = lambda: {tuple(r.cate_names_path): (r.cate_ids_path, r.cate_level_index) for r in job.index().collect()}
    first = index()
    assert first == {("Arts",): ([1], 0), ("Books",): ([2], 1), ("Books", "Novels"): ([2, 1], 2), ("Books", "Poems"): ([2, 2], 3)}
    more = tree_page(
        spark, (1, ["Books"], [("/b?c=1", "Novels"), ("/b?c=9", "Essays")]), (2, ["Arts"], [("/a", "Film"), ("/a2", "film!")]),
        (3, ["Books", "Novels"], [("/deep", "Crime")]), (4, ["Nowhere"], [("/n", "Lost")]), (5, ["Arts"], []),
    )
    # A run that is lost before its commit leaves nothing that counts; one that is repeated replaces itself.
    with monkeypatch.context() as m:
        m.setattr(type(job.manifest), "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            job.run(tag="two", pages=more)
    assert index() == first
    for _ in range(2):
        assert {u for u, _, _ in new(job.run(tag="two", pages=more))} == {"http://x.y/b?c=9", "http://x.y/a", "http://x.y/a2", "http://x.y/deep", "http://x.y/n"}
        assert job.links().count() == 9
    now = index()
    assert {k: now[k] for k in first} == first and now["Books", "Essays"][0] == [2, 3] and now["Books", "Novels", "Crime"][0] == [2, 1, 1]
    assert sorted(i for _, i in now.values()) == list(range(len(now)))
    filled = {r.url.rsplit("/", 1)[1]: (r.cate_ids_path, r.cate_links_path) for r in job.filled().collect()}
    assert filled["deep"] == ([2, 1, 1], ["http://x.y/p1", "http://x.y/b?c=1", "http://x.y/deep"])
    assert filled["a"] == (None, None) and filled["n"] == ([3, 1], None)
    with pytest.raises(Exception, match="not unique|has no link"):
        job.filled(strict=True).collect()
    links_file, index_file = job.lines()
    assert links_file.count() == 9 and "001#Arts" in {r.line.split("------------")[0] for r in index_file.collect()}
    with pytest.raises(ValueError):
        job.run(tag="none")


def test_two_runs_at_once(spark):
    job = CategoryTreeJob(spark, scratch(spark, "tree"), TREE)
    entries = spark.createDataFrame([("http://x.y/p1>>>7>Books",)], "line string")
    read = job.manifest.read

    def late():
        state = read()
        job.manifest.read = read
        job.run(tag="other", entries=entries)
        return state

    job.manifest.read = late
    with pytest.raises(Conflict):
        job.run(tag="mine", entries=entries)
    assert job.links().count() == 1
    assert job.run(tag="mine", entries=entries).count() == 0
