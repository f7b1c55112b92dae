"""Line runs, periodic runs and spelling variants against brute force, with odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catloom.llm.line_dedup import LineRuns, dedup_lines
from catloom.llm.periodic import COVER, MODULUS, Extensions, find_runs, periodic_runs, planted
from catloom.llm.spelling import letter_runs, misspelt, near_pairs, spelling_groups, word_counts
from catloom.session import scratch

DOCS = "doc_id bigint, text string"


# Line de-duplication


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, least=10, known=()):
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        for line in (text or "").split("\n"):
            first.setdefault(line_key(line), i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < least or line_key(x) not in known and first[line_key(x)] == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def odd_texts():
    rng = random.Random(4)
    pool = ["A shared line of text", "a SHARED line of text \t", "short", "", "  \r", "é" * 10, "É" * 10, "é" * 9, "one more line that is shared"]
    texts = ["\n".join(rng.choice([*pool, f"line number {rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "A shared line of text\n" * 500, "same text of a repeated row", " lead  \x0b\na shared line of text\x0c"]
    rows = list(enumerate(texts)) + [(66, "a different text with the same id\nA shared line of text"), (5, texts[5]), (5, texts[5])]
    return rows + [(None, "keyless line that stays"), (None, "keyless line that stays\nA shared line of text"), (None, None), (-7, "É" * 10)]


def outcome(frame):
    return Counter((r["row"]["doc_id"], r["lines"], r["dropped"], r["kept"]) for r in frame.collect())


@pytest.mark.parametrize(("batches", "hot"), [(1, 1000), (3, 2), (5, 10**9)])
def test_lines_against_brute_force(spark, batches, hot):
    rows = odd_texts()
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("row", "doc", "id", "pos", "kept", "h1")})
    out = dedup_lines(frame, batches=batches, hot=hot)
    assert out.select("row.*").columns == frame.columns
    assert outcome(out) == brute_lines(rows)


def test_lines_of_two_loads(spark):
    """Runs outlive the session's catalog; lines of an earlier load go in all documents of the next."""
    one, two = odd_texts()[:40], odd_texts()[20:]
    path = scratch(spark, "line-runs")
    assert outcome(dedup_lines(spark.createDataFrame(one, DOCS), runs=LineRuns(spark, path, buckets=3))) == brute_lines(one)
    runs = LineRuns(spark, path)
    assert [r["level"] for r in runs.runs()] == [2] and runs.buckets == 3
    for run in runs.runs():
        spark.sql(f"drop table {runs._table(run['name'])}")
    hashes = runs._open(runs.runs()[0])
    assert hashes.count() == hashes.distinct().count()
    known = {line_key(x) for _, t in one for x in (t or "").split("\n")}
    assert outcome(dedup_lines(spark.createDataFrame(two, DOCS), runs=runs, batches=1)) == brute_lines(two, known=known)
    assert [r["level"] for r in runs.runs()] == [2, 0]


def test_a_run_is_merged_without_a_shuffle(spark):
    runs = LineRuns(spark, scratch(spark, "line-runs"), buckets=4)
    some = spark.range(1000).select(F.xxhash64("id").alias("h1"), (F.col("id") * 7).alias("h2"))
    runs.add(some.filter("id < 300" if "id" in some.columns else "h2 < 2100"))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = runs.unseen(some.repartition(4, "h1", "h2"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    assert runs.unseen(some).count() == 700


def test_no_lines(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    assert outcome(dedup_lines(spark.createDataFrame([(1, None), (2, "")], DOCS))) == Counter({(1, 1, 0, ""): 1, (2, 1, 0, ""): 1})


# Periodic runs


def brute_runs(w, least=6, periods=4):
    n, out = len(w), {}
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, periods * p):
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, k, p) for (s, k), p in out.items())


def repetitive(rng):
    k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 2, 5, 6, 7, 8, 20, 60, 200])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 8 else 0):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        for i in range(a + p, min(n, a + rng.randint(2, 8) * p)):
            w[i] = w[i - p]
    return w


def test_cover_meets_every_pair_of_residues():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_extensions_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 400)
        codes = np.array([*(rng.randint(1, rng.choice([1, 2, 4])) for _ in range(n - 1)), 9])
        i, j = (np.array(x) for x in zip(*[(a, b) for a, b in ((rng.randint(0, n), rng.randint(0, n)) for _ in range(50)) if a != b] or [(0, 1)], strict=True))
        want = []
        for a, b in zip(i, j, strict=True):
            k = 0
            while a + k < n and b + k < n and codes[a + k] == codes[b + k]:
                k += 1
            want.append(k)
        assert Extensions(codes).common(i, j).tolist() == want


@pytest.mark.parametrize(("least", "periods"), [(6, 4), (1, 2), (3, 3)])
def test_runs_against_brute_force(least, periods):
    rng = random.Random(3)
    for _ in range(80):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 10))]
        borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = find_runs(np.array([c for t in texts for c in t], np.int64), borders, least, periods)
        assert [tuple(map(int, r)) for r in got] == [(t, *r) for t, w in enumerate(texts) for r in brute_runs(w, least, periods)]


def test_periodic_texts(spark):
    rng = random.Random(9)
    texts = [" \t".join(f"w{c}" for c in repetitive(rng)) for _ in range(50)] + [None, "", " \n ", "a " * 30_000, "Ä ä " * 9, "x\xa0y " * 7, "end end end end end end"]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts + texts[:3])], "doc_id bigint, text string, found string")
    out = periodic_runs(frame)
    assert out.columns == frame.columns
    for r in out.collect():
        words = [w for w in (r["text"] or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        runs = brute_runs(words) if len(words) < 1000 else [(0, 30_000, 1)]
        gone = {i for s, k, p in runs for i in range(s + p, s + k)}
        got = r["found"]
        assert got["n_words"] == len(words) and [tuple(x) for x in got["runs"]] == runs
        assert got["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs(frame.limit(0)).count() == 0


def test_planted_runs_are_found(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(400)] + [(7, None), (None, "a b")]
    out = periodic_runs(spark.createDataFrame(rows, DOCS).withColumn("text", planted("text", F.col("doc_id").cast("string"))))
    assert 5 < out.filter(F.size("found.runs") > 0).count() < 60


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("pairs_per_row", [16, 0.01])
def test_near_words_against_brute_force(spark, pairs_per_row):
    """With few pairs a row every group is divided down to the edited place."""
    rng = random.Random(6)
    words = {"".join(rng.choice("abéÿ") for _ in range(rng.randint(5, 8))) for _ in range(250)}
    words |= {"a" * k for k in range(1, 30)} | {"prefixof" + x + y for x in "abcdefgh" for y in "abcdefgh"} | {"", "x", "y", "🎈ball", "🎈bell", "z" * 3000, "z" * 2999 + "y"}
    frame = spark.createDataFrame([(w, rng.randint(1, 9)) for w in sorted(words)] + [(None, 4)], "word string, n bigint")
    got = Counter(frozenset((r["a"], r["b"])) for r in near_pairs(frame, pairs_per_row=pairs_per_row).collect())
    assert got == Counter(frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b))


def test_forms_and_roots(spark):
    words = {"color": 40, "colour": 90, "colours": 20, "coloura": 45, "colourb": 46, "colourbe": 23, "lonely": 8, "tiesa": 4, "tiesb": 9, "tiesc": 9}
    rng = random.Random(8)
    words |= {"".join(rng.choice("ab") for _ in range(7)): rng.randint(3, 400) for _ in range(60)}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: r for r in spelling_groups(frame).collect()}
    form = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        assert (got[w]["n"], got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (n, len(near), form[w], words.get(form[w])), w
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        assert got[w]["root"] == root
    assert len(got) == len(words) and spelling_groups(frame.limit(0)).count() == 0


def test_runs_of_letters(spark):
    frame = spark.createDataFrame([(1, "Don't ÀB_cé9x×÷ ßtraße\nŁódź"), (2, None), (3, ""), (None, "abc")], DOCS).withColumn("run", F.lit(0))
    assert Counter(r["run"] for r in letter_runs(frame).collect()) == Counter(["don", "t", "Àb", "cé", "x×÷", "ßtraße", "ód", "abc"])
    spelt = letter_runs(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("éclairs").alias("text"))).select(misspelt(F.col("run"), F.col("key")).alias("word"))
    kinds = {r["word"] for r in spelt.distinct().collect()}
    assert "éclairs" in kinds and 2 < len(kinds) and all(one_edit("éclairs", k) for k in kinds - {"éclairs"})
    counted = {r["word"]: r["n"] for r in word_counts(spelt, least_points=6, least_count=1).collect()}
    assert sum(counted.values()) == 3000
