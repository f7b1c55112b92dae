from __future__ import annotations

from urllib.parse import quote, urljoin, urlparse, urlunparse

from catloom.functions import urls

BASES = [
    "http://a.example.com/b/c/d;p?q", "https://a.example.com", "http://a.example.com/", "https://a.example.com/x/y/?z=1#f",
    "http://a.example.com/b//c/", "mailto:someone@example.com", "",
]
HREFS = [
    "", "g", "./g", "g/", "/g", "//g.example.com/x", "?y", "g?y", "#s", "g#s", ";x", "g;x", "g;x?y#s", ".", "./", "..", "../", "../g",
    "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http:g", "https://h.example.com/a b",
    "javascript:go()", "a//b", "/a//b/../c", "é/中?x=ü", "mailto:x@y", "HTTP://A.example.com/Q", "g?y/./x", "x:y:z", "1a:b",
]
URLS = [
    " http://A.example.com/Ä b~*/100%25/(x)+;v=1;w?a= b#f ", "HTTPS://x.example.com", "ftp://x.example.com/a", "//x.example.com/a", "http:///a",
    "http://x.example.com/a?", "http://x.example.com/a;b/c;d", "nonsense", "", "http://x.example.com/%E4%B8%AD/中",
]


def normal(url, encode=True):
    parts = urlparse(url.strip())
    if not parts.scheme or not parts.netloc or parts.scheme.lower() not in ("http", "https"):
        return ""
    return urlunparse(parts._replace(fragment="", path=quote(parts.path, safe="/%") if encode else parts.path))


def test_join(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", urls.url_join("b", "h").alias("j")).collect()
    wrong = [(r.b, r.h, r.j, urljoin(r.b, r.h)) for r in got if r.j != urljoin(r.b, r.h)]
    assert not wrong, wrong


def test_normalize(spark):
    frame = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = frame.select("u", urls.normalize_url("u").alias("n"), urls.normalize_url("u", encode_path=False).alias("p")).collect()
    assert [(r.n, r.p) for r in got] == [(normal(r.u), normal(r.u, False)) for r in got]


def test_page_links(spark):
    rows = [("#a",), (" JavaScript:x",), ("mailto:a",), ("TEL:1",), ("data:x",), ("",), (None,), (" /a b#t ",), ("ftp://x/y",)]
    got = spark.createDataFrame(rows, "h string").select(urls.normalize_link("h", "h").alias("x")).count()
    assert got == 9
    frame = spark.createDataFrame([(h, "https://x.example.com/q") for (h,) in rows], "h string, b string")
    assert [r[0] for r in frame.select(urls.normalize_link("h", "b")).collect()] == [None] * 7 + ["https://x.example.com/a%20b", None]


def test_small_keys(spark):
    f = spark.createDataFrame([("00ab", "price", "asc"), ("00ab", "pop", "")], "i string, f string, o string")
    r = f.select(
        urls.store_bucket("i", "C").alias("b"), urls.cache_key("i", "c").alias("k"), urls.head_key("t", "f", "o").alias("h"),
        urls.field_ttl("f", {"price": 5}).alias("t"), urls.clean_url(f.i).alias("c"),
    ).collect()
    assert [tuple(x) for x in r] == [("C-AB", "c:ab:00ab", "t:price-asc", 5, "00ab"), ("C-AB", "c:ab:00ab", "t:pop", None, "00ab")]
