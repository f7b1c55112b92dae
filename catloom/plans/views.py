"""Frames derived from the given tables that several queries share, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import WHITE_SPACE
from .catalog import lit, table

# Caption patterns; ``{}`` takes the part's name and number.
CAPTIONS = [
    "{}", "", "   ", "void(null)", " void(0) ", "<null>", "Hello", "Hello123", "12345", "123.45", "-12.5", "12-3",
    "你好世界", "Hello世界", "你好123", "Test@123", "usb", " APPLE iphone ", "sony-camera", "【三星】Galaxy-S25!!!",
    "￥1999.99 {}", "......", "★品牌专卖店 {} [手机报价]#", "小说（连载）{}", "科幻/魔幻(全集)", "更多{}", "More {}",
    "查看上级分类", "&#27431;&#33298;&#20025; {}", "&27431;&33298; {}", "&#8249; {}", "&#8249;", "%3Ax%20y//z {}",
    "Sony相机 {}", "三星 手机", "三星 Galaxy {}", "iPhone手机", "A{}", "男士色馆区123 壹贰 {}", "作 者：{} 更多 正品",
    "：作者 {}", "&amp;nbsp; &NBSP;{}", "作者 {} 编著 中国 译者 {} com http www", "日本 {} 法国 {}", "简介 {} 说明",
    "Ａｂｃ１２３：（{}）", "a中b中 c 中", "x　{}\t", "&#1234567890; {}",
]


def ws_trim(sql: str) -> str:
    return f"trim({sql}, {lit(WHITE_SPACE)})"


_LIST = "[" + ", ".join(lit(c) for c in CAPTIONS) + "]"

CAPTION_SQL = f"""
    select p_partkey as id,
           nullif(replace({_LIST}[p_partkey % {len(CAPTIONS)} + 1], '{{}}', p_name || ' ' || p_partkey), '<null>') as text
    from part"""

# Captions made from every part, and the whole text of every document.
TEXT_SQL = f"texts as ({CAPTION_SQL} union all select -1 - doc_id as id, text from documents)"


def captions(spark: SparkSession, sf: str) -> DataFrame:
    choice = F.get(F.array(*[F.lit(c) for c in CAPTIONS]), (F.col("p_partkey") % len(CAPTIONS)).cast("int"))
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    text = F.nullif(F.replace(choice, F.lit("{}"), name), F.lit("<null>"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), "text")
    return captions(spark, sf).unionByName(docs)


def seconds(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})").cast("bigint")


def seconds_sql(column: str) -> str:
    return f"cast(floor(epoch({column})) as bigint)"


# Category tree of the given tables: region / nation / market segment / customer.
PATH_SQL = """paths as (
    select c_custkey, r_name, n_name, c_mktsegment, c_name, r_regionkey, n_nationkey
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def customer_paths(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer; region and nation are fixed, tiny dimension tables that Spark sizes and broadcasts."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("c_custkey", "r_name", "n_name", "c_mktsegment", "c_name", "r_regionkey", "n_nationkey")


# Links of the category tree: one row per region, nation, segment of a nation, and customer.
LINK_SQL = PATH_SQL + """,
links as (
    select distinct 0 as level, r_name as p0, '' as p1, '' as p2, '' as p3, 'https://shop.example.com/r' || r_regionkey as url from paths
    union all select distinct 1, r_name, n_name, '', '', 'https://shop.example.com/n' || n_nationkey from paths
    union all select distinct 2, r_name, n_name, c_mktsegment, '', 'https://shop.example.com/n' || n_nationkey || '/' || lower(c_mktsegment) from paths
    union all select 3, r_name, n_name, c_mktsegment, c_name, 'https://shop.example.com/c' || c_custkey from paths)"""


def category_links(spark: SparkSession, sf: str) -> DataFrame:
    """``(url, level, cate_names_path)`` for every node of the customers' category tree."""
    p = customer_paths(spark, sf)
    base = "https://shop.example.com/"

    def node(level: int, names: list[str], url: Column) -> DataFrame:
        rows = p.select(F.concat(F.lit(base), url).alias("url"), F.lit(level).alias("level"), F.array(*names).alias("cate_names_path"))
        return rows if level == 3 else rows.distinct()

    n = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    levels = [
        node(0, ["r_name"], F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))),
        node(1, ["r_name", "n_name"], n),
        node(2, ["r_name", "n_name", "c_mktsegment"], F.concat(n, F.lit("/"), F.lower("c_mktsegment"))),
        node(3, ["r_name", "n_name", "c_mktsegment", "c_name"], F.concat(F.lit("c"), F.col("c_custkey").cast("string"))),
    ]
    out = levels[0]
    for frame in levels[1:]:
        out = out.unionByName(frame)
    return out


# Anchors of the pages: every one has the form <a href="...">text</a>.
ANCHOR_SQL = """anchors as (
    select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) as href,
           unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as name,
           generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1 as pos
    from pages)"""
HOST_SQL = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
