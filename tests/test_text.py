"""Column expressions against plain restatements of the rules, on examples and random strings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from catloom.functions import convert, text

ALPHABET = list("aB z9Z0.-+;&#()[]　\t中文é世ßÉ４²①,/") + ["&#27431;", "更多", "专卖店", "品牌", "void(0)", "  "]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(5)
    made = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 12))) for _ in range(400)]
    return sorted(set(made)) + [
        "Hello", "Hello123", "12345", "123.45", "-123.45", "+99.99", "12.34.56", "12-3", "你好世界", "Hello世界",
        "Apple-iPhone(15)", "【三星】Galaxy-S25!!!", "......", "usb", "sony-camera", "APPLE iphone", "void(null)",
    ]


def run(spark, values, column):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.v for r in frame.select("i", column("s").alias("v")).orderBy("i").collect()]


def check(spark, values, column, rule):
    got = run(spark, values, column)
    wrong = [(v, g, rule(v)) for v, g in zip(values, got, strict=True) if g != rule(v)]
    assert not wrong, wrong[:5]


def ascii_runs(s):
    return re.findall(r"[\x00-\x7f]+|[^\x00-\x7f]+", s)


PREDICATES = {
    text.is_all_letter: str.isalpha,
    text.is_all_number: str.isdigit,
    text.is_all_letter_or_number: str.isalnum,
    text.is_all_float: lambda s: bool(re.match(r"^[+-]?\d+\.?\d*$", s)),
    text.is_all_letter_or_float: lambda s: bool(re.match(r"^[a-zA-Z0-9.+\-]+$", s)),
    text.has_number: lambda s: any(c.isdigit() for c in s),
    text.has_letter: lambda s: bool(re.search("[a-zA-Z]", s)),
    text.has_chinese: lambda s: any("一" <= c <= "鿿" for c in s),
    text.is_all_chinese: lambda s: s != "" and all("一" <= c <= "鿿" for c in s),
    text.is_all_english: lambda s: not any("一" <= c <= "鿿" for c in s),
    text.is_letter_char: lambda s: len(s) == 1 and s.isalpha(),
    text.is_number_char: lambda s: len(s) == 1 and s.isdigit(),
    text.is_trim_empty: lambda s: s.strip() in ("", "void(null)", "void(0)"),
}


@pytest.mark.parametrize("column", PREDICATES, ids=lambda f: f.__name__)
def test_predicates(spark, strings, column):
    check(spark, strings, column, PREDICATES[column])


def title(s):
    s = s.lower().strip()
    if sum(c.isascii() and c.isalpha() for c in s) <= 3:
        return s.upper()
    return re.sub("[a-z]+", lambda m: m[0][0].upper() + m[0][1:], s)


def spaced(s):
    return re.sub(" +", " ", " ".join(ascii_runs(s))).strip() if s.strip() not in ("", "void(null)", "void(0)") else ""


def plain_words(s):
    return re.sub(r"\0+", " ", "".join(c if c.isalpha() or c.isdigit() else "\0" for c in s)).lower().strip()


def name_type(s):
    t = s.strip()
    if t in ("", "void(null)", "void(0)"):
        return "", ""
    at = t.find(" ")
    if at > 0 and (ord(t[0]) < 128 or (ord(t[at - 1]) > 127 and ord(t[at + 1]) > 127)):
        return t[:at], t[at + 1:]
    first, *rest = ascii_runs(t)
    if rest:
        tail = "".join(rest)
        return first, tail[1:] if tail.startswith(" ") else tail
    return "", ""


def test_formatting(spark, strings):
    check(spark, strings, text.title_words, title)
    check(spark, strings, text.space_scripts, spaced)
    check(spark, strings, text.to_space_replace, plain_words)
    check(spark, strings, lambda c: F.to_json(text.split_name_type(c)), lambda s: __import__("json").dumps(
        dict(zip(("name", "type"), name_type(s), strict=True)), ensure_ascii=False, separators=(",", ":")
    ))


def test_examples(spark):
    assert run(spark, ["usb", "sony-camera", "APPLE iphone"], text.title_words) == ["USB", "Sony-Camera", "Apple Iphone"]
    assert run(spark, ["&#27431;&#33298;", "&27431;&33298;", "&#99999999;", "&#55296;", "a&#38;#39;"], text.decode_numeric_refs) == [
        "欧舒", "欧舒", "&#99999999;", "&#55296;", "a&#39;",
    ]
    assert run(spark, ["http%3A//x%20", "a&amp;b;", "&raquo;"], text.decode_codes) == ["http://x ", "a&b;", "?"]
    assert run(spark, ["更多", "Read MORE", "小说（a）", "(x)", "★", "&#8249;"], text.clean_caption) == [None, None, "小说", "其他", "其他", None]
    assert run(spark, ["作者 张三 编著 中国 张三 a"], text.drop_role_words) == ["张三"]
    frame = spark.createDataFrame([(42, 5), (123, 3), (999999, 10), (-7, 4), (12345, 3)], "v int, n int")
    got = [frame.filter(f"v = {v}").select(text.zero_fill("v", n)).first()[0] for v, n in frame.collect()]
    assert got == [str(v).zfill(n) for v, n in frame.collect()]


def test_same(spark):
    frame = spark.createDataFrame([("a", "a"), (None, ""), ("a", "b"), ("", "b"), ("void(0)", " ")], "a string, b string")
    assert [r[0] for r in frame.select(text.is_same("a", "b")).collect()] == [True, True, False, False, True]


def test_regex_key(spark):
    assert run(spark, [" ID=12 ", "x"], lambda c: text.extract_regex_key(c, r" id=(\d+) ")) == ["12", ""]
    assert run(spark, ["id=１２"], lambda c: text.extract_regex_key(c, r"id=(\d+)")) == ["１２"]
    assert run(spark, ["x"], lambda c: text.extract_regex_key(c, "(")) == [""]
    # A group that took no part gives way to the whole match; one that matched nothing doesn't.
    assert run(spark, ["a", "b", "c"], lambda c: text.extract_regex_key(c, "(a)|b")) == ["a", "b", ""]
    assert run(spark, ["b", "xb"], lambda c: text.extract_regex_key(c, "(x?)b")) == ["", "x"]


def test_conversions(spark):
    values = ["", None, '["a","b"]', '{"a":1}', "x", "[1, true, null, 1.5]", "12", "[]"]
    assert run(spark, values, convert.json_list) == [[], [], ["a", "b"], [], ["x"], ["1", "True", "None", "1.5"], [], []]
    numbers = ["", "12", "1,234", "￥1999.99", "1.2万", "-5", ",", "x", None, "１２"]
    assert run(spark, numbers, convert.to_integer) == [0, 12, 1234, 1999, 1, -5, 0, 0, 0, 12]
    assert run(spark, numbers, convert.to_number) == [0.0, 12.0, 1234.0, 1999.99, 1.2, -5.0, 0.0, 0.0, 0.0, 12.0]
