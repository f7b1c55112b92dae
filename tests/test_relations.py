"""Joins, de-duplication, positions and caps against brute force, with one key holding a third of all rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catloom.operators import caps, category, dedup, progress, sequence
from catloom.operators.skew import lookup_join, top_n_per_group


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 400)}", rng.randint(0, 99)) for i in range(3000)]


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed, "i int, k string, v int").repartition(6)


def test_lookup_join(spark, skewed, frame):
    right = {k: len(k) for k in {k for _, k, _ in skewed} if not k.endswith("7")}
    table = spark.createDataFrame(list(right.items()), "k string, w int")
    top = frame.groupBy("k").count().orderBy(F.desc("count")).first()["k"]
    hot = [frame.filter(F.col("k") == top).select(F.xxhash64("k")).first()[0]]
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = lookup_join(frame, table, ["k"], how, spread=["i"], salts=7, hot=hot)
        got = sorted(r.i for r in joined.collect())
        keep = {"inner": True, "left": None, "left_semi": True, "left_anti": False}[how]
        assert got == sorted(i for i, k, _ in skewed if keep is None or (k in right) == keep)
        assert "_salt" not in joined.columns
    assert lookup_join(frame, table, ["k"]).count() == frame.count()
    plan = lookup_join(frame, table, ["k"], "left", spread=["i"], hot=hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Cartesian" not in plan


def test_keep_first(skewed, frame):
    first = {}
    for i, k, v in sorted(skewed):
        first.setdefault(k, (i, v))
    got = {r.k: (r.i, r.v) for r in dedup.keep_first(frame, ["k"], ["i"]).collect()}
    assert got == first
    flags = dedup.accepted_flags(frame, "k", ["i"], spread=["i"]).collect()
    assert len(flags) == len(skewed) and {r.i for r in flags if r.accepted} == {i for i, _ in first.values()}


def test_blank_keys_are_never_accepted(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (4, "a")], "i int, k string")
    assert [r.i for r in dedup.keep_first(rows, ["k"], ["i"]).collect()] == [3]
    assert {r.i: r.accepted for r in dedup.accepted_flags(rows, "k", ["i"], spread=["i"]).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_top_n(skewed, frame):
    groups = defaultdict(list)
    for i, k, v in skewed:
        groups[k].append((-v, i))
    for count in (5, 200):
        want = {i: n for rows in groups.values() for n, (_, i) in enumerate(sorted(rows)[:count], 1)}
        got = top_n_per_group(frame, ["k"], [F.col("v").desc(), F.col("i")], count, spread=["i"], salts=4, rank="n").collect()
        assert {r.i: r.n for r in got} == want


def test_dense_position(skewed, frame):
    order = sorted((k, v, i) for i, k, v in skewed)
    want = {i: n for n, (_, _, i) in enumerate(order, 10)}
    for parts in (None, 1, 30):
        out = sequence.dense_position(frame, ["k", "v", "i"], start=10, parts=parts)
        assert {r.i: r.pos for r in out.collect()} == want


def test_id_block(spark, frame):
    store = spark.createDataFrame([(7,), (41,)], "iid bigint")
    rows, first, last = sequence.allocate_ids(frame, store, ["i"])
    assert (first, last) == (42, 3041) and sorted(r.iid for r in rows.collect()) == list(range(42, 3042))
    empty = spark.createDataFrame([], "iid bigint")
    assert sequence.allocate_ids(frame.limit(0), empty, ["i"])[1:] == (1, 0)


def test_caps_and_stops(spark):
    rng = random.Random(8)
    pages = [(n, f"l{n % 3}" if n % 2 else "l0", n // 10, rng.random() < 0.15) for n in range(400)]
    frame = spark.createDataFrame(pages, "i int, link string, page int, fresh boolean")
    stops = {}
    for link in {p[1] for p in pages}:
        fresh = defaultdict(int)
        for _, at, page, new in pages:
            if at == link:
                fresh[page] += new
        read = sorted(fresh)
        ends = [p for q, p in zip(read, read[1:]) if fresh[q] == 0 and fresh[p] == 0]
        if ends:
            stops[link] = min(ends)
    got = caps.stop_pages(frame, link="link", page_no="page", fresh="fresh", streak=2)
    assert {r.link: r.stop_page for r in got.collect()} == stops and stops
    listed = spark.createDataFrame([("e", p) for p in (1, 2, 5, 9, 10)], "link string, page int")
    few = spark.createDataFrame([("e", 1, True), ("e", 9, True)], "link string, page int, fresh boolean")
    gaps = caps.stop_pages(few, link="link", page_no="page", fresh="fresh", streak=2, pages=listed)
    assert [(r.link, r.stop_page) for r in gaps.collect()] == [("e", 5)]
    kept = caps.until_stop(frame, got, link="link", page_no="page", spread=["i"])
    assert {r.i for r in kept.collect()} == {i for i, link, page, _ in pages if page <= stops.get(link, 10**9)}


def test_backfill(spark):
    links = spark.createDataFrame(
        [("u0", ["Books"]), ("u1", ["books!", "Art & Design"]), ("u2", ["BOOKS", "art design", "Straße"])], "url string, cate_names_path array<string>"
    )
    index = spark.createDataFrame(
        [([1], ["books"]), ([1, 2], ["Books", "artdesign"]), ([1, 2, 3], ["books", "Art-Design", "STRASSE"])],
        "cate_ids_path array<int>, cate_names_path array<string>",
    )
    ids = {r.url: r.cate_ids_path for r in category.backfill_ids(links, index).collect()}
    assert ids == {"u0": [1], "u1": [1, 2], "u2": [1, 2, 3]}
    urls = {r.url: r.cate_links_path for r in category.backfill_links(links).collect()}
    assert urls == {"u0": ["u0"], "u1": ["u0", "u1"], "u2": ["u0", "u1", "u2"]}
    shared = spark.createDataFrame([("u0", ["A"]), ("same", ["A", "B"]), ("same", ["A", "C"])], "url string, cate_names_path array<string>")
    assert [r.cate_links_path for r in category.backfill_links(shared).orderBy("cate_names_path").collect()] == [["u0"], ["u0", "same"], ["u0", "same"]]
    orphan = links.filter("url <> 'u1'")
    with pytest.raises(Exception, match="no link"):
        category.backfill_links(orphan).collect()
    with pytest.raises(Exception, match="no index row"):
        category.backfill_ids(links, index.limit(1)).collect()
    with pytest.raises(Exception, match="not unique"):
        category.backfill_ids(links, index.union(index)).collect()
    lenient = {r.url: r.cate_links_path for r in category.backfill_links(orphan, strict=False).collect()}
    assert lenient == {"u0": ["u0"], "u2": None}


def test_lines(spark):
    good = "001#文艺------------002#青春文学------------004#校园/成长------------ ------------ ------------24"
    lines = spark.createDataFrame([(good,), ("",), (good + "------------1",), (good.replace("002#", "002"),)], "line string")
    rows = category.parsed_or_error(lines, "line", category.parse_index_line("line"), strict=False).collect()
    assert [(r.cate_ids_path, r.cate_names_path, r.cate_level_index) for r in rows] == [([1, 2, 4], ["文艺", "青春文学", "校园/成长"], 24)]
    with pytest.raises(Exception, match="malformed"):
        category.parsed_or_error(lines, "line", category.parse_index_line("line")).collect()
    link = "https://e.example.com/list-XHJS-dd_sale-0-1.html--2>>>-1>文艺||青春文学||玄幻/惊悚"
    out = category.parsed_or_error(spark.createDataFrame([(link,)], "line string"), "line", category.parse_category_link("line")).first()
    assert (out.url, out.level, out.limit_cate_level_0_id, out.cate_name) == ("https://e.example.com/list-XHJS-dd_sale-0-1.html", 2, -1, "玄幻/惊悚")
    assert out.cate_names_path == ["文艺", "青春文学", "玄幻/惊悚"]


def test_tree(spark):
    edges = [("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("o", "gone")]
    edges += [(f"n{i}", "a") for i in range(200)]
    frame = spark.createDataFrame([(k, p, k.upper()) for k, p in edges], "key string, parent string, name string")
    placed, rejected = category.walk_tree(frame, key="key", parent="parent", name="name")
    assert {r.key for r in rejected.collect()} == {"e", "x", "y", "o"}
    got = {r.key: (r.level, r.path) for r in placed.collect()}
    assert got["d"] == (4, ["R", "A", "B", "C", "D"]) and got["n7"] == (2, ["R", "A", "N7"])
    assert not {"e", "x", "y", "o"} & set(got) and len(got) == 205


def test_progress(spark):
    events = spark.createDataFrame(
        [(1, "page", "p1", 10, 1), (1, "page", "p2", 20, 2), (2, "page", "q1", 10, 3), (2, "completed", "", 30, 4), (3, "page", "z", 1, 5)],
        "link_index int, event string, page_url string, ts_sec bigint, event_id bigint",
    )
    state = progress.latest_state(events, now=100, ttl_seconds=95)
    assert {r.link_index: r.state for r in state.collect()} == {1: "p2", 2: "COMPLETED_END"}
    links = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3"), (4, "f4")], "link_index int, url string")
    assert {r.link_index: r.start_url for r in progress.resume_links(links, state).collect()} == {1: "p2", 3: "f3", 4: "f4"}
    assert progress.latest_state(events, now=10**9, ttl_seconds=0).count() == 3
