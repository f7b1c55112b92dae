"""Corpus operators against brute force, round trips, held-out accuracy and their SQL twins."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from catloom.llm import neighbours, queries
from catloom.llm.components import components
from catloom.llm.decontamination import contamination, decontaminate, hit_words
from catloom.llm.labelled import labelled_sample
from catloom.llm.main_text import extract_main_text, is_main, labelled_rows, main_text, train_tree
from catloom.llm.mixing import mix, mix_plan, source_targets
from catloom.llm.near_dedup import NearDuplicates, least_matches, one_of_each
from catloom.llm.neighbours import NeighbourGraph
from catloom.llm.quality import QualityModel, keep_good, score_quality
from catloom.llm.shards import assign_shards, best_fit, pack, write_shards
from catloom.llm.toxicity import Distance, ToxicityModel, pieces, score_toxicity
from catloom.llm.url_rules import DigestArray, judge
from catloom.llm.warc import MAGIC, archive_records, read_archives, write_archives
from catloom.session import scratch
from check import TABLES, rows_of

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    frame = queries.JOBS[name](spark, SF)
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, cursor.fetchall())


def test_all_queries_and_the_pipeline():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.JOBS) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


# Sharding


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(5)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 400))), reverse=True)
        room, want = [], []
        for s in sizes:
            fits = [(left, i) for i, left in enumerate(room) if left >= s]
            if fits:
                i = min(fits)[1]
            else:
                i = len(room)
                room.append(50)
            room[i] -= s
            want.append(i)
        assert best_fit(sizes, 50) == want


def test_pack_is_even():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    sums = np.bincount(pack(sizes, 7), sizes)
    assert len(sums) == 7 and sums.max() - sums.min() <= 5
    assert pack([], 3) == [] and pack([9, 1], 4) == [0, 1] and pack([90, 3, 3, 2, 2], 3) == [0, 1, 2, 1, 2]


def test_open_bricks_are_packed_again(spark):
    """Many cells leave many open bricks; their number comes down, groups stay whole and shards even."""
    rng = random.Random(4)
    rows = docs(spark, *("x" * rng.randint(1, 60) + str(i % 700) for i in range(1500)))
    out = [(r["row"]["text"], r["shard"], r["size"]) for r in assign_shards(rows, shards=4, bricks=8, cell_rows=5, most_bricks=48).collect()]
    assert len(out) == 1500 and len({(t, s) for t, s, _ in out}) == len({t for t, _, _ in out})
    sums = [sum(n for _, s, n in out if s == k) for k in range(4)]
    assert max(sums) < 1.05 * min(sums)


def test_shards_hold_whole_groups(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs(spark, None, None, "", "same", "same", "x" * 300_000))
    rows = rows.withColumns({"shard": F.lit(1), "size": F.lit("clash")})
    out = assign_shards(rows, cell_rows=40)
    got = [(r["row"]["text"], r["size"], r["shard"], r["slot"]) for r in out.collect()]
    assert len(got) == rows.count()
    shard_of = {}
    for text, size, shard, _ in got:
        assert size == len((text or "").encode()) + 1
        assert shard_of.setdefault(text, shard) == shard
    for s in range(16):
        assert sorted(x[3] for x in got if x[2] == s) == list(range(sum(x[2] == s for x in got)))
    small = [sum(x[1] for x in got if x[2] == s) for s in range(16)]
    small.remove(max(small))
    assert max(small) < 1.02 * min(small)
    write_shards(out, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == rows.count()
    assert assign_shards(docs(spark).limit(0)).count() == 0


# Decontamination


def brute_hits(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = split(text), set(), set()
    for name, item in items:
        w = split(item)
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            for p in range(len(own) - m + 1):
                if own[p : p + m] == w[k : k + m]:
                    hit |= set(range(p, p + m))
                    found.add(str(name))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "Bb", "ccc", "É", "ü1"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "...", "a b " * 3000]
    items = [(i, " - ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 9])))) for i in range(8)] + [(None, None), (3, "Bb ccc a"), (99, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = docs(spark, *texts).withColumn("found", F.lit(1))
    out = contamination(rows, bench, width=4, block_bytes=block_bytes)
    for r in out.withColumn("hit", hit_words(F.col("found"))).collect():
        assert (r["found"]["n_words"], r["hit"], sorted(r["found"]["items"])) == brute_hits(r["text"], [("" if i is None else i, t) for i, t in items], 4), r["text"]
    clean = decontaminate(rows, bench, width=4)
    assert clean.columns == rows.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(texts) if not brute_hits(t, items, 4)[1]]
    assert contamination(rows.limit(0), bench).count() == 0
    assert decontaminate(rows, bench.limit(0)).count() == rows.count()


# Toxicity and quality


def accuracy(rows, label):
    known = {r["doc_id"]: r for r in rows.collect()}
    pairs = [(known[i]["score"], y) for i, y in label.items() if i in known and known[i]["held_out"]]
    ones, zeros = ([s for s, y in pairs if y == k] for k in (1, 0))
    better = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    return better / max(1, len(ones) * len(zeros))


def labels_of(spark, name):
    return {r["doc_id"]: r[name] for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}


def test_quality_on_held_out_rows(spark):
    out = queries.JOBS["op10_quality"](spark, SF2)
    assert accuracy(out, labels_of(spark, "quality")) > 0.9
    for r in out.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_on_held_out_rows(spark):
    out = queries.JOBS["op3_toxicity"](spark, SF2)
    assert accuracy(out, labels_of(spark, "toxic")) > 0.7
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.collect())


@pytest.mark.parametrize("model,score", [(QualityModel, score_quality), (ToxicityModel, score_toxicity)])
def test_classifiers_on_odd_tables(spark, model, score):
    rows = docs(spark, None, "", " ", "one", "one", "long " * 50_000).withColumn("score", F.lit("clash"))
    kind = "doc_id bigint, quality int, toxic int"
    given = spark.createDataFrame([(None, 1, 1), (2, None, None), (3, 1, 0), (3, 1, 0), (5, 0, 1), (4, 1, 0)], kind)
    for labels in (given, given.limit(0)):
        out = score(rows, model.train(rows, labels)).collect()
        assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["text"] == "one"}) == 1
    assert score(rows.limit(0), model.train(rows.limit(0), given)).count() == 0


def test_toxic_passage_at_the_end_of_a_text_without_blanks():
    rng = random.Random(1)
    plain, toxic = ("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n)).encode() for n in (50_000, 40))
    distance = Distance(b" some ordinary words " * 50, toxic)
    assert distance.saved(plain).max() < 20 < distance.saved(plain + toxic).max()
    run = b" " + plain + b" "
    assert all(p.decode() and len(p) <= 512 for p in pieces(run))
    assert all(any(run[i : i + 24] in p for p in pieces(run[:3000])) for i in range(3000 - 24))


def test_long_texts_leave_room_for_others(spark):
    rows = [(i, "x" * 500 if i % 7 == 0 else f"text {i}", i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    sample, _ = labelled_sample(frame.drop("toxic"), frame.drop("text"), "toxic", rows=60, text_bytes=1200)
    assert sum(len(r["text"]) for r in sample) <= 1200
    assert [sum(r["label"] == k for r in sample) for k in (0, 1)] == [30, 30]


def test_keep_good_keeps_columns(spark):
    rows = spark.read.parquet(f"{SF2}/documents.parquet")
    model = QualityModel.train(rows, spark.read.parquet(f"{SF2}/labels.parquet"))
    kept = keep_good(rows, model)
    assert kept.columns == rows.columns
    label = labels_of(spark, "quality")
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good, bad = ([i for i, y in label.items() if y == k] for k in (1, 0))
    assert sum(i in left for i in good) > 0.97 * len(good) and sum(i in left for i in bad) < 0.2 * len(bad)


# Mixing


def test_targets_are_filled_from_the_top(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 50), ("", 0)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    # Order: '', a, b, c, null with weights 5, 2, 1, 5, 2.
    assert got[""] == 0 and got["a"] == 200 and got[None] == 100
    assert got["c"] == 2000 and got["b"] == pytest.approx(2150 * 1.5 - 2300)
    assert source_targets(rows.limit(0)).count() == 0


def test_mix_repeats_documents(spark):
    rows = docs(spark, *["two words"] * 300, None, "").withColumn("target", F.lit("clash"))
    out = mix(rows)
    assert out.columns == rows.columns
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(1 <= c <= 2 for c in n.values()) and sum(n.values()) == pytest.approx(450, rel=0.12)
    plan = mix_plan(rows.withColumn("size", F.lit(2)))
    assert {r["doc_id"]: r["copies"] for r in plan.collect()} == {r["doc_id"]: r["copies"] for r in plan.repartition(3).collect()}
    assert mix(rows.limit(0)).count() == 0


# Near duplicates


def brute_components(texts, width, similar=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)) if w else frozenset())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    rng = random.Random(11)
    texts = [None, "", "  ", "One", "one", "one two", "one two three"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 60, 200]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 16))):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 9999)}"
            texts.append(" ".join(copy))
    texts += texts[20:30]
    rows = docs(spark, *texts)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in NearDuplicates(rows, width=width).components().collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, width)


def edited(rng, words, share):
    """Some words replaced, dropped or put in, about ``share`` of them."""
    out = []
    for w in words:
        kind = rng.choice(["keep", "put", "drop", "replace"]) if rng.random() < share else "keep"
        out += {"keep": [w], "put": [w, f"n{rng.randint(0, 400)}"], "drop": [], "replace": [f"n{rng.randint(0, 400)}"]}[kind]
    return out


@pytest.mark.parametrize(("width", "shares"), [(2, (0.01, 0.1)), (2, (0.04, 0.2)), (5, (0.01, 0.06)), (1, (0.05, 0.5))])
def test_members_of_a_bucket_against_brute_force(spark, width, shares):
    """One bucket with everything in it and no leader: differences from a pivot find every component."""
    rng = random.Random(21)
    texts = ["a", "b c", "unlike all others " * 3]
    for _ in range(4):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([25, 60, 120]))]
        texts += [" ".join(edited(rng, base, rng.uniform(*shares))) for _ in range(25)]
        texts += [" ".join(base[: rng.randint(len(base) * 3 // 4, len(base))]) for _ in range(6)]
    found = NearDuplicates(docs(spark, *texts), width=width)
    want = brute_components(texts, width)
    none = spark.createDataFrame([], "a bigint, b bigint")
    rows = found.classes.select(F.lit(1).alias("bucket"), "id", F.col("id").alias("root"))
    links = found._across(rows, none)
    first = {r["id"]: r["first"] for r in found.members.collect()}
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert [roots.get(first[i], first[i]) for i in range(len(texts))] == [root for _, root in want]
    # Nothing is linked that is not.
    assert all(want[r["a"]][1] == want[r["b"]][1] for r in links.collect())


def test_a_family_of_half_alike_copies_makes_few_pairs(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(rng.choice([w, w, w, w, w, w, w, w, w, w, w, w, w, f"n{rng.randint(0, 10**9)}"]) for w in base) for _ in range(300)]
    found = NearDuplicates(docs(spark, *texts), width=2)
    rows = found.classes.select(F.lit(1).alias("bucket"), "id", F.col("id").alias("root"))
    members = rows.select(F.lit(0).cast("bigint").alias("pivot"), "id")
    deltas = found._rooted(found._differences(members), spark.createDataFrame([], "node bigint, root bigint"))
    # 44,850 pairs share the bucket.
    assert found._common_differences(deltas).distinct().count() < 3000
    assert {r["component_id"] for r in found.components().collect()} == {root for _, root in brute_components(texts, 2)}
    assert rows.count() == 300


def test_one_of_each_keeps_odd_rows(spark):
    rows = docs(spark, "a b c d e f g", "A b c d e f g", None, None, "").unionByName(spark.createDataFrame([(None, "a b c d e f g", "x", "y", 1)] * 2, DOCS))
    rows = rows.unionByName(rows.filter("doc_id = 1")).withColumn("component_id", F.lit("clash"))
    kept = one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (False, 4), (True, None), (True, None)]
    assert one_of_each(rows.limit(0)).count() == 0


def test_a_hundred_near_copies_cost_no_pairs(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[:i] + ["odd"] + words[i + 1 :]) for i in range(100)]
    found = NearDuplicates(docs(spark, *texts), width=2)
    assert found.links().count() < 1000
    assert {r["component_id"] for r in found.components().collect()} == {0}


def test_pruning_follows_the_posterior():
    steps = dict(least_matches(200, 20, 80, 1e-7))
    assert steps[20] == 2 or steps[20] < 10
    assert 0.55 * 200 < steps[200] < 0.8 * 200


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 600), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 700: 600}


# WARC


@pytest.mark.parametrize("stretch", [64 << 20, 700])
def test_archives_round_trip(spark, stretch):
    big = "p" * 150
    evil = f"<p>{MAGIC}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{MAGIC}{MAGIC} end</p>"
    bodies = [None, "", big, big, "short", "short", evil, evil, MAGIC, "é\r\n\r\n" * 40, "x" * 3000 + MAGIC + "y" * 3000, big]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\n", b) for i, b in enumerate(bodies)], "page_id bigint, url string, html string").withColumn("digest", F.lit(0))
    path = scratch(spark, "warc-test")
    write_archives(archive_records(pages).coalesce(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r["record_id"]: r for r in read_archives(spark, path, stretch=stretch, payloads=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(bodies)
    for i, body in enumerate(bodies):
        r, raw = got[f"<urn:page:{i}>"], (body or "").encode()
        first = bodies.index(body)
        again = len(raw) >= 100 and first < i
        assert r["record_type"] == ("revisit" if again else "response")
        assert r["refers_to"] == (f"<urn:page:{first}>" if again else None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r["payload"] == ("" if again else body or "")


def test_archives_of_nothing(spark):
    path = scratch(spark, "warc-test")
    write_archives(archive_records(spark.createDataFrame([], "page_id bigint, url string, html string")), path)
    assert read_archives(spark, path).count() == 0


# Main text


def test_the_tree_learns_its_table():
    tree = train_tree(labelled_rows())
    assert all(is_main(tree, x) == bool(y) for y, x in labelled_rows())


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body class="with-sidebar"><div id="cookie-notice">We use cookies</div>
<header><h1>Site name</h1><a href=/>Home</a></header><div class="wrap sidebar-right"><main><article><header><h1>Title&nbsp;here</h1></header>
<p>First &lt;para&gt;  with
<a href=x>link</a>.<!-- <p>hidden</p> --></p><ul><li>one<li>two</ul><div class="ad">Buy now</div><p>Last.</p>
<section class="comments"><article><p>I am a reader and I have much to say about this</p></article></section></article></main>
<aside><p>Related long text about other things that is long enough</p></aside></div><form><label>Mail</label></form><footer>&copy; 2020</footer>"""


def test_main_text_of_a_page(spark):
    want = "Title here\n\nFirst <para> with link.\n\none\n\ntwo\n\nLast."
    assert main_text(PAGE) == want
    plain = "<div><a href=1>Home</a></div><div>" + "word " * 50 + "</div><div>Short line</div><div>" + "text " * 60 + "</div><div><a>Next</a></div><div>copyright 2020</div>"
    assert main_text(plain).split("\n\n")[1] == "Short line" and "copyright" not in main_text(plain)
    deep = "<div>" * 3000 + "deep words here " * 10 + "</div>" * 3000
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<<<a"), (5, deep)], "page_id bigint, html string").withColumn("n_chars", F.lit("clash"))
    got = {r["page_id"]: r for r in extract_main_text(rows).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and len(got[5]["text"]) > 100


@pytest.mark.parametrize("wrapper", ["<form id='aspnetForm'>|</form>", "<div class='has-sidebar'>|</div>", "<div class='page-header-fixed'>|</div>"])
def test_main_text_of_a_page_within_a_weak_box(wrapper):
    start, end = wrapper.split("|")
    body = [" ".join(f"word{i}{j}" for j in range(60)) for i in range(4)]
    page = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>" + "".join(f"<p>{p}</p>" for p in body)
    side = "<nav><p>" + "menu words " * 300 + "</p></nav><div class=related><p>" + "other words " * 20 + "</p></div>"
    assert main_text(f"<html><body>{start}{page}{side}{end}</body></html>") == "\n\n".join(body)


def test_articles_of_the_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert main_text(r["html"]) == "\n\n".join(p for p in parts if p)


# Nearest neighbours


def test_nearest_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    ids, x = map(np.array, zip(*[(r["vec_id"], r["embedding"]) for r in rows.collect()], strict=True))
    got = {}
    for r in NeighbourGraph(rows, rounds=2).nearest(F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i].astype(float)
        s[i] = -np.inf
        own = sorted(got[ids[i]])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-6 for _, v, score in own)
        hits += len({v for _, v, _ in own} & set(ids[np.argsort(-s)[:20]]))
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_with_a_thin_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "DIRECTIONS", 2)
    x = np.random.default_rng(4).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    found = {}
    for r in NeighbourGraph(frame, degree=4).nearest(F.col("id") % 100 == 0, k=10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found.get(i, set()) & set(np.argsort(-np.where(np.arange(3000) == i, -9, x @ x[i]))[:10].tolist())) for i in range(0, 3000, 100))
    assert hits >= 0.9 * 300


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in NeighbourGraph(frame).nearest(F.col("id").isin(0, 2, 5), k=3).collect()]
    assert sorted(got) == [(0, 1, 9, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (2, 1, 9, 2.0), (2, 2, 0, 1.0), (2, 3, 1, 1.0)]
    assert NeighbourGraph(frame.limit(0)).nearest(F.lit(True), k=3).count() == 0


# URL rules


def test_digest_collisions_are_confirmed(tmp_path):
    same = lambda text: 7
    path = f"{tmp_path}/rules"
    open(path, "wb").write(DigestArray.pack([(b"a/", True), (b"b/", False), (b"c/", True)], same))
    rules = DigestArray(path)
    assert [rules.texts[rules.borders[i] : rules.borders[i + 1]].tobytes() for i in rules.find([b"c/", b"a/"], same)] == [b"c/", b"a/"]
    assert rules.find([b"x/"], same).tolist() == [-1] and DigestArray.pack([])
    assert xxhash.xxh64_intdigest(b"a/") != 7


@pytest.mark.parametrize("block_rows", [4_000_000, 2])
def test_rules_against_brute_force(spark, block_rows):
    rules = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.net", None, "block"), (None, "/", "block"), ("x.org", "/a", "block"), ("x.org", "/a", "allow")]
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?y", "http://m.example.com/EN/", "https://www.example.com/en/", "http://net/es/#f", "http://a.net/es", "x://b.net?/es/", "x://a.b.net/es/1", "x://ab.net/", "h://x.org/ab", "h://x.org", "a://b://c.com/", "h://com/\n/en/"]
    frame = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id int, url string, verdict int")
    given = [(h.lower(), p or "", v) for h, p, v in rules if h]
    for r in judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string"), block_rows=block_rows).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in given if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[3], best[4]), r["url"]
    assert judge(frame.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# Pipeline


def test_pipeline_stage_by_stage(spark):
    rows = spark.read.parquet(f"{SF2}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, SF2)
        if name != "sharding":
            assert rows.columns == before.columns
        path = scratch(spark, f"test-{name}")
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        ids, old = ({r["doc_id"] for r in x.select("doc_id").distinct().collect()} for x in (rows, before))
        assert ids <= old and len(ids) > 0.6 * len(old)
        if name == "near_duplicates":
            texts = [r["text"] for r in rows.orderBy("doc_id").collect()]
            assert all(root == i for i, (_, root) in enumerate(brute_components(texts, 5)))
        if name == "benchmark":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF2}/benchmark.parquet").collect()]
            wanted = {tuple(w[k : k + 10]) for _, t in items for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for k in range(len(w) - 9)}
            gone = old - ids
            for r in before.collect():
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].lower())
                assert (r["doc_id"] in gone) == any(tuple(w[k : k + 10]) in wanted for k in range(len(w) - 9))
    assert rows.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.max("b") / F.min("b")).first()[0] < 1.05
