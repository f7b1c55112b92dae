"""Spelling variants: words one edit apart, found by chunks of one word among the positional grams of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import crc32_sql, lower_ascii, query, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_POINTS, LEAST_COUNT = 5, 3
MORE = 2  # a form is so many times as frequent as its variant
PAIRS = 16  # pairs for each row of a group; a group with more is divided by further chunks
_ROW = ["key", "shift", "long", "lo", "hi", "word", "n"]


def letter_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, run)`` for every maximal run of letters, A-Z in lower case, as often as it occurs."""
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(LETTERS), F.lit(0))
    return docs.select(F.col(key).alias("key"), F.explode(runs).alias("run"))


def word_counts(words: DataFrame, *, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough; counted before they are shuffled."""
    return words.filter(F.length("word") >= least_points).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _grams(rows: DataFrame) -> DataFrame:
    """Divides what is left between ``lo`` and ``hi`` of the shorter word into two chunks and keeps one of them.

    One edit lies in one of two disjoint chunks, so the other stands in the longer word too: the left one in its
    place, the right one ``shift`` places on. The longer word has its gram of that size at that place in the key.
    """
    size = F.col("hi") - F.col("lo")
    half = F.col("lo") + F.floor(size / 2).cast("int")
    # One letter is left and one comes in before or behind it: either way it is all there is to keep.
    alone = (size == 1) & (F.col("shift") == 1)
    cut = {"left": F.when(alone, F.col("hi")).otherwise(half), "right": F.when(alone, F.col("lo")).otherwise(half)}
    move = F.when(F.col("long"), F.col("shift")).otherwise(0)

    def kept(first: Column, last: Column, by: Column, lo: Column, hi: Column) -> Column:
        chunk = F.col("word").substr(first + by + 1, last - first)
        return F.struct(F.xxhash64("key", first, last, chunk).alias("key"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    parts = F.array(
        kept(F.col("lo"), cut["left"], F.lit(0), cut["left"], F.col("hi")),
        kept(cut["right"], F.col("hi"), move, F.col("lo"), cut["right"]),
    )
    return rows.withColumn("part", F.explode(parts)).select("part.key", "shift", "long", "part.lo", "part.hi", "word", "n")


def near_pairs(words: DataFrame, *, pairs_per_row: int = PAIRS) -> DataFrame:
    """``(a, n_a, b, n_b)``: every pair of the distinct words ``(word, n)`` that one inserted, deleted or replaced code point parts, once.

    A word meets words of its own length and words that are one longer. As the shorter one it has two chunks, as
    the longer one its grams where chunks of such a word can lie, within one place. Groups with the same key are
    paired and the pairs confirmed by their edit distance; a group in which that would be more than
    ``pairs_per_row`` pairs for each of its rows is divided by two chunks of what is left, and again, until only the
    edited place is left. Then all its pairs are near. So pairs grow with the rows and the true pairs, however many words
    share a chunk, and none is lost. Null words take part in nothing.
    """
    n = F.length("word").cast("int")
    sides = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(long).alias("long"), (n - s * int(long)).alias("hi")) for s, long in ((0, False), (1, False), (1, True))])
    whole = words.filter(F.col("word").isNotNull()).withColumn("side", F.explode(sides))
    rows = whole.select(F.xxhash64("side.shift", "side.hi").alias("key"), "side.shift", "side.long", F.lit(0).alias("lo"), "side.hi", "word", "n")
    found = None
    while True:
        rows = written(_grams(rows).select(*_ROW), "grams")
        counts = rows.groupBy("key").agg(F.count_if(~F.col("long")).alias("x"), F.count_if("long").alias("y"), F.max("shift").alias("_shift"))
        same = F.col("_shift") == 0
        cost = F.when(same, F.col("x") * (F.col("x") - 1) / 2).otherwise(F.col("x") * F.col("y"))
        # Groups without a pair end here.
        groups = written(counts.withColumn("cost", cost).filter(cost > 0).select("key", (cost <= pairs_per_row * (F.col("x") + F.col("y"))).alias("small")), "gram-groups")
        placed = rows.join(groups, "key")
        done = F.col("small") | (F.col("hi") - F.col("lo") + F.col("shift") <= 1)
        settled = written(placed.filter(done).drop("small"), "gram-settled")
        one = settled.filter(~F.col("long")).select("key", "shift", F.col("word").alias("a"), F.col("n").alias("n_a"))
        two = settled.filter(F.col("long") | (F.col("shift") == 0)).select("key", "shift", F.col("word").alias("b"), F.col("n").alias("n_b"))
        pairs = one.join(two, ["key", "shift"]).filter((F.col("shift") == 1) | (F.col("a") < F.col("b")))
        near = pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
        found = near if found is None else found.unionByName(near)
        rows = written(placed.filter(~done).drop("small"), "gram-rest")
        if rows.isEmpty():
            return written(found.distinct(), "near-words")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words ``(word, form)`` that have a form: pointers jump until none moves."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_groups(words: DataFrame, *, more: int = MORE, pairs_per_row: int = PAIRS) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every one of the words ``(word, n)``, each given once.

    The form is the near word with the largest ``n``, ties to the smallest in code-point order, if that ``n`` is at
    least ``more`` times the word's, else null. The root is where the forms end, the word itself without one. As
    counts grow by ``more`` from form to form, forms make no circle. An empty table gives an empty result.
    """
    if more < 2:
        raise ValueError("a form has at least twice the count")
    words = written(words.select("word", "n"), "words")
    pairs = near_pairs(words, pairs_per_row=pairs_per_row)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best")
    near = written(both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best, F.first("n_a").alias("own")), "near-best")
    forms = near.filter(-F.col("best.less") >= more * F.col("own")).select("word", "best.form", (-F.col("best.less")).alias("form_n"))
    out = words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(_roots(forms), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def misspelt(run: Column, key: Column) -> Column:
    """The run, without one of its code points for one occurrence in 97, by the crc32 of key and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


OP13_SQL = r"""
with runs as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
coded as (select run, count(*) as k, {crc} as h from runs group by doc_id, run),
spelt as (select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, k from coded),
words as (select word, cast(sum(k) as bigint) as n from spelt where length(word) >= 5 group by word having sum(k) >= 3),
places as (select word, n, unnest(range(length(word))) as i from words),
gaps as (select distinct word, n, substr(word, 1, i) || substr(word, i + 2) as rest from places),
holes as (select word, n, i, substr(word, 1, i) || chr(0) || substr(word, i + 2) as rest from places),
near as (
    select g.word as a, g.n as n, w.word as b, w.n as m from gaps g join words w on w.word = g.rest
    union all select w.word, w.n, g.word, g.n from gaps g join words w on w.word = g.rest
    union all select x.word, x.n, y.word, y.n from holes x join holes y on x.rest = y.rest and x.word <> y.word),
best as (select a as word, count(*) as n_near, any_value(n) as n, min(struct_pack(less := -m, form := encode(b))) as best from near group by a),
forms as (select word, decode(best.form) as form, -best.less as form_n from best where -best.less >= 2 * n),
up as (
    with recursive up(word, root) as (select word, form from forms union all select up.word, forms.form from up join forms on forms.word = up.root)
    select word, root from up where root not in (select word from forms))
select w.word, form, coalesce(root, w.word) as root, w.n, coalesce(n_near, 0) as n_near, form_n
from words w left join best on best.word = w.word left join forms on forms.word = w.word left join up on up.word = w.word""".replace("{crc}", crc32_sql("doc_id || ':' || run"))


@query("op13_spelling_variants", OP13_SQL)
def op13(spark, sf):
    """Every frequent word with the number of words one edit apart, the form that it is a variant of, and its root."""
    runs = letter_runs(table(spark, sf, "documents"))
    words = word_counts(runs.select(misspelt(F.col("run"), F.col("key")).alias("word")))
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")
