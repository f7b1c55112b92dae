"""Positions without a shuffle, decimal keys, products by number, and an index over loads."""

from __future__ import annotations

import random
from decimal import Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F

from catloom.operators import category, extract, filters
from catloom.session import written
from catloom.sources import readers


def test_positions_over_splits_without_a_shuffle(spark, tmp_path):
    rng, want = random.Random(5), []
    for f in range(4):
        lines = [rng.choice(["", "  ", f" f{f} line {i} " + "x" * rng.randint(0, 40)]) for i in range([2000, 1, 0, 700][f])]
        (tmp_path / f"part-{f}.txt").write_text("\n".join(lines))
        want += [x.strip() for x in lines if x.strip()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    spark.conf.set("spark.sql.files.openCostInBytes", 10)
    try:
        got = readers.read_numbered_lines(spark, str(tmp_path))
        rows = {r.pos: r.value for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [rows[i] for i in range(len(want))] == want and len(rows) == len(want)
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_decimal_keys_sort_as_numbers(spark):
    rng = random.Random(1)
    texts = ["0", "-0", "0.0", "+0e5", "", " ", "abc", "1e", "e5", ".", "-", "1.2.3", "--1", "1,5", "NaN", "٣", "1_0", ".5", "5.", "-.5", "1E+3", "1e-3", "00012.500", " 12.5\t", "-12.5"]
    texts += ["9" * 60, "-" + "9" * 60, "1" + "0" * 60, "9" * 59 + "8", "0." + "0" * 40 + "1", "-0." + "0" * 40 + "1", "1e-41", "123456789012345678901234567890.1", "123456789012345678901234567890.10", "1e999999999", "-1e999999999"]
    texts += [f"{rng.choice(['', '-', '+'])}{rng.randint(0, 10 ** rng.randint(0, 5))}{rng.choice(['', '.' + str(rng.randint(0, 999))])}{rng.choice(['', 'e' + str(rng.randint(-4, 4))])}" for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", filters.decimal_key("t").alias("k"))
    keys = {r.t: r.k for r in frame.collect()}
    numbers = {}
    for t in texts:
        try:
            number = Decimal(t.strip()) if t not in ("٣", "1_0") else None
        except InvalidOperation:
            number = None
        numbers[t] = None if number is None or number.is_nan() else number
        assert (keys[t] is None) == (numbers[t] is None), t
    assert keys[None] is None
    known = [t for t in texts if numbers[t] is not None]
    for a in known:
        for b in rng.sample(known, 40):
            assert (keys[a] < keys[b]) == (numbers[a] < numbers[b]) and (keys[a] == keys[b]) == (numbers[a] == numbers[b]), (a, b)


def test_ranges_of_long_numbers(spark):
    big = 123456789012345678901234567890123
    frame = spark.createDataFrame([(str(big + d),) for d in (-1, 0, 1)] + [(f"{big}.0000000000000001",), ("x",), (None,)], "v string")
    bounds = (Decimal(str(big)), Decimal(str(big + 1)))
    kept = frame.filter(filters.allow_range(F.col("v"), bounds))
    assert sorted(r.v for r in kept.collect()) == sorted([str(big), f"{big}.0000000000000001", str(big + 1)])
    assert frame.filter(filters.reject_range(F.col("v"), bounds)).count() == 3
    small = spark.createDataFrame([(t,) for t in ("1", " 1.5 ", "1e0", "2.0000000000", "2.00000000001", "0.99999999999", "01", "-1", "", None, "x")], "v string")
    got = [r.v for r in small.filter(filters.allow_range(F.col("v"), (Decimal(1), Decimal(2)))).collect()]
    assert got == ["1", " 1.5 ", "1e0", "2.0000000000", "01"]


def test_a_million_combinations_stream(spark):
    template = "a#{NODE_CATE_LIST_COMMON_ID}-#{NODE_CATE_LIST_COMMON_MAIN_OWNER_ID}b"
    values = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: i.cast("string"))
    rows = extract.combine_rows(spark.range(1), template, {"NODE_CATE_LIST_COMMON_ID": values, "NODE_CATE_LIST_COMMON_MAIN_OWNER_ID": values}, layer="CATE_LIST")
    got = rows.agg(F.count("*"), F.count_distinct("combined"), F.min("pos"), F.max("pos")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 0, 999_999)
    assert [r.combined for r in rows.filter("pos in (0, 1, 1000, 999999)").orderBy("pos").collect()] == ["a1-1b", "a1-2b", "a2-1b", "a1000-1000b"]


def test_products_by_number_are_the_products(spark):
    template = "#{NODE_CATE_LIST_COMMON_ID}/#{NODE_CATE_LIST_COMMON_MAIN_OWNER_ID}"
    lists = [(0, ["a", "b"], ["x", None]), (1, [], ["x"]), (2, ["c"], ["y", "z", "y"]), (3, None, ["x"])]
    frame = spark.createDataFrame(lists, "id int, p array<string>, q array<string>")
    variables = {"NODE_CATE_LIST_COMMON_ID": F.col("p"), "NODE_CATE_LIST_COMMON_MAIN_OWNER_ID": F.col("q")}
    one = extract.combine_rows(frame, template, variables, layer="CATE_LIST")
    two = frame.select("id", F.posexplode(extract.combine_template(template, variables, layer="CATE_LIST")).alias("pos", "combined"))
    key = lambda r: (r.id, r.pos, r.combined)
    assert sorted(map(key, one.collect()), key=repr) == sorted(map(key, two.collect()), key=repr)
    assert [r.combined for r in extract.combine_rows(frame, "plain", {}, layer="CATE_LIST").collect()] == ["plain"] * 4
    with pytest.raises(ValueError):
        extract.combine_rows(frame, "#{NODE_NOT_KNOWN}", {}, layer="CATE_LIST")


def test_ids_are_kept_over_loads(spark):
    def index(frame):
        return {tuple(r.cate_names_path): (tuple(r.cate_ids_path), r.cate_level_index) for r in frame.collect()}

    load = lambda *paths: spark.createDataFrame([(list(p),) for p in paths], "names array<string>")
    first = written(category.build_index(load("bx", "by", "d"), "names", max_ids=3), "index")
    second = written(category.extend_index(load("ax", "bw", "by", "c", "e"), "names", first, max_ids=3), "index")
    one, two = index(first), index(second)
    assert one == {("b",): ((1,), 0), ("b", "x"): ((1, 1), 1), ("b", "y"): ((1, 2), 2), ("d",): ((2,), 3)}
    assert {k: two[k] for k in one} == one
    assert {k: v for k, v in two.items() if k not in one} == {
        ("a",): ((3,), 4), ("a", "x"): ((3, 1), 5), ("b", "w"): ((1, 3), 6), ("c",): ((category.OTHER_ID,), 7), ("e",): ((category.OTHER_ID,), 8),
    }
    assert index(category.extend_index(load("by", "e", "ax"), "names", second, max_ids=3)) == two
    assert index(category.extend_index(load("bx", "by", "d"), "names", first.limit(0), max_ids=3)) == one


def test_quoted_csv_over_splits(spark, tmp_path):
    """A file with line ends inside quotes is read by several tasks, with the values that one task would read."""
    import csv

    rng, want = random.Random(6), []
    value = lambda: rng.choice(["plain", "", "a,b", 'say "hi"', "two\nlines", "three\n\n\"lines\"\n", "\n", "é中", " lead", "x" * 50, '"', "00"])
    for f in range(3):
        rows = [[value(), value(), value()] for _ in range([400, 0, 37][f])]
        with open(tmp_path / f"{f}.csv", "w", encoding="utf-8-sig" if f else "utf-8", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows([["a", 'b"', "c\nd"], *rows])
        want += [tuple(r) for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 10)
    try:
        got = readers.read_csv(spark, str(tmp_path), ["a", "b", "c"])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
