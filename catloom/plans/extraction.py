"""Queries for page extraction (PRJ-*) and the flagship job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_page_href, normalize_link, page_url, store_bucket
from ..operators import extract
from ..operators.category import LinkRules, build_links, level_item, repair_levels, rewrite_url
from ..operators.dedup import keep_first
from ..operators.rules import FieldRule, RegionRule, Selector, apply_regex, field_values, select_nodes
from ..sources.html import html_nodes, page_nodes
from .catalog import query, table
from .scalars import CAPTION_STEPS, number_sql, price_text
from .views import ANCHOR_SQL, HOST_SQL, PATH_SQL, TEXT_SQL, customer_paths, texts, ws_trim

LINK, NAME = FieldRule(css="a", attr="href"), FieldRule(css="a")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of every page: ``(page_id, url, pos, href, name)``."""
    parsed = page_nodes(pages(spark, sf), text_tags={"a"})
    nodes = F.col("nodes")
    last = F.size(nodes) - 1
    lists = parsed.select(
        "page_id", "url",
        field_values(nodes, LINK, F.lit(-1), last).alias("href"),
        field_values(nodes, NAME, F.lit(-1), last).alias("name"),
    )
    return lists.select("page_id", "url", F.inline(extract.zip_rows({"href": F.col("href"), "name": F.col("name")})))


@query(
    "flagship_catalog",
    f"""with {ANCHOR_SQL},
    links as (select page_id, pos, name, {HOST_SQL} || regexp_replace(href, '[.,]$', '') as link from anchors),
    kept as (select *, row_number() over (partition by link order by page_id, pos) as rn from links)
    select 'CONTENT-' || upper(right(md5(link), 2)) as bucket, count(*) as records, count(distinct name) as names,
           min(page_id) as first_page, cast(sum(length(link)) as bigint) as link_chars
    from (select replace(replace(url_encode(link), '%3A', ':'), '%2F', '/') as link, name, page_id from kept where rn = 1) group by 1""",
)
def _flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pages -> links -> normalised, first of each URL -> typed record -> records per store bucket."""
    rules = {
        "link": FieldRule(css="a", attr="href", regex=r"^(.*?)[.,]?$"),
        "main_title": FieldRule(css="a"),
    }
    parsed = extract.list_records(pages(spark, sf), rules)
    link = normalize_link(F.col("common.link"), F.col("url"))
    # Exploding drops rows without a link and evaluates the link once, where a filter would repeat it.
    kept = [c for c in parsed.columns if c != "id"]
    linked = parsed.select(*kept, F.explode(F.array_compact(F.array(link))).alias("id"))
    first = keep_first(linked, ["id"], ["page_id", "record_seq"])
    records = extract.content_records(first, crawl_time=1_700_000_000)
    return records.groupBy(store_bucket("_id", "CONTENT").alias("bucket")).agg(
        F.count("*").alias("records"),
        F.count_distinct("common.main_title").alias("names"),
        F.min("page_id").alias("first_page"),
        F.sum(F.length("id").cast("bigint")).alias("link_chars"),
    )


_TAGS = ["a", "li", "h1", "nav", "article", "footer", "title", "script"]


@query(
    "prj_01_html_nodes",
    " union all ".join(
        f"select page_id, '{t}' as tag, cast(len(regexp_extract_all(html, '<{t}[ >]')) as bigint) as n from pages "
        f"where len(regexp_extract_all(html, '<{t}[ >]')) > 0" for t in _TAGS
    ),
)
def _html_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = html_nodes(pages(spark, sf), text_tags=())
    return nodes.filter(F.col("tag").isin(*_TAGS)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("prj_02_inner_text", f"with {ANCHOR_SQL} select page_id, pos, name as inner_text from anchors")
def _inner_text(spark: SparkSession, sf: str) -> DataFrame:
    parsed = page_nodes(pages(spark, sf), text_tags={"a"})
    found = select_nodes(F.col("nodes"), Selector.of("a"), F.lit(-1), F.size("nodes") - 1)
    return parsed.select("page_id", F.posexplode(F.transform(found, lambda n: n.text)).alias("pos", "inner_text")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query(
    "prj_03_attributes",
    f"with {ANCHOR_SQL} select page_id, pos, href, '' as title from anchors",
)
def _attributes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, last = F.col("nodes"), F.size("nodes") - 1
    parsed = page_nodes(pages(spark, sf), text_tags=())
    lists = parsed.select(
        "page_id",
        field_values(nodes, LINK, F.lit(-1), last).alias("href"),
        field_values(nodes, FieldRule(css="a", attr="title"), F.lit(-1), last).alias("title"),
    )
    return lists.select("page_id", F.inline(extract.zip_rows({"href": F.col("href"), "title": F.col("title")})))


@query(
    "prj_04_selector_choice",
    """select page_id, cast(len(regexp_extract_all(html, '<a ')) as bigint) as by_css,
       cast(len(regexp_extract_all(html, '<h1>')) as bigint) as by_xpath, cast(0 as bigint) as by_none,
       cast(len(regexp_extract_all(html, '<a ')) > 1 as bigint) as second_item, cast(len(regexp_extract_all(html, '<a ')) - 1 as bigint) as later_items,
       cast(len(regexp_extract_all(html, '<a ')) as bigint) as texts from pages""",
)
def _selector_choice(spark: SparkSession, sf: str) -> DataFrame:
    nodes, last = F.col("nodes"), F.size("nodes") - 1
    count = lambda rule: F.size(field_values(nodes, rule, F.lit(-1), last)).cast("bigint")
    return page_nodes(pages(spark, sf), text_tags=()).select(
        "page_id",
        count(FieldRule(css="a", xpath="//h1")).alias("by_css"),
        count(FieldRule(xpath="//article/h1")).alias("by_xpath"),
        count(FieldRule()).alias("by_none"),
        count(FieldRule(css="nav li:nth-child(2) > a:only-child")).alias("second_item"),
        count(FieldRule(css="nav li:not(:first-child) a, nav li + li a")).alias("later_items"),
        count(FieldRule(xpath="//nav/ul/li[position()>=1]/a[1][@href and not(contains(@href, '://'))] | //nope[last()]")).alias("texts"),
    )


@query(
    "prj_05_regex_step",
    f"""with {ANCHOR_SQL} select page_id, pos,
      case when regexp_matches(href, '/([a-z]+)') then regexp_extract(href, '/([a-z]+)', 1) else href end as grouped,
      case when regexp_matches(name, '[A-Z]\\w+') then regexp_extract(name, '[A-Z][\\w]+') else name end as whole from anchors""",
)
def _regex_step(spark: SparkSession, sf: str) -> DataFrame:
    return anchors(spark, sf).select(
        "page_id", "pos",
        apply_regex(F.col("href"), "regex:/([a-z]+)").alias("grouped"),
        apply_regex(F.col("name"), "[A-Z][a-zA-Z0-9_]+").alias("whole"),
    )


@query(
    "prj_06_block_regions",
    f"""with {ANCHOR_SQL} select page_id, cast(0 as bigint) as unit, pos as region_seq, cast(0 as bigint) as record_seq, {HOST_SQL} || href as link, name as main_title from anchors
    union all select page_id, 1, 0, 0, '', trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) from pages""",
)
def _block_regions(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"link": LINK, "main_title": FieldRule(css="a, h1")}
    regions = [
        RegionRule(css="nav > ul > li", fields=("link", "main_title")),
        RegionRule(xpath="//article", fields=("main_title",), child_max_count=1),
    ]
    out = extract.list_records(pages(spark, sf), rules, regions)
    return out.select(
        "page_id", *[F.col(c).cast("bigint").alias(c) for c in ("unit", "region_seq", "record_seq")],
        "common.link", "common.main_title",
    )


@query(
    "prj_07_father_range",
    f"""with {ANCHOR_SQL} select page_id, pos as record_seq, {HOST_SQL} || href as link from anchors where pos < 3""",
)
def _father_range(spark: SparkSession, sf: str) -> DataFrame:
    regions = [RegionRule(css="nav li", child_block=0, child_max_count=3, fields=("link",))]
    out = extract.list_records(pages(spark, sf), {"link": LINK}, regions, content_type="article")
    return out.select("page_id", F.col("record_seq").cast("bigint").alias("record_seq"), "common.link")


@query(
    "prj_08_zip_columns",
    f"""with {ANCHOR_SQL}, h as (select page_id, trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) as title from pages)
    select page_id, cast(pos as bigint) as pos, href, name, case when pos = 0 then title else '' end as title, case when pos < 4 then 'yes' else 'no' end as in_four
    from anchors join h using (page_id)""",
)
def _zip_columns(spark: SparkSession, sf: str) -> DataFrame:
    nodes, last = F.col("nodes"), F.size("nodes") - 1
    rules = {"href": LINK, "name": NAME, "title": FieldRule(css="h1")}
    lists = page_nodes(pages(spark, sf), text_tags={"a", "h1"}).select(
        "page_id", *[field_values(nodes, r, F.lit(-1), last).alias(n) for n, r in rules.items()]
    )
    rows = lists.select("page_id", F.inline(extract.zip_rows({n: F.col(n) for n in rules})))
    return rows.withColumn("in_four", F.when(F.col("pos") < 4, "yes").otherwise("no"))


@query(
    "prj_08_zip_fixed_count",
    f"""with {ANCHOR_SQL}, n as (select page_id, cast(unnest(generate_series(0, 9)) as bigint) as pos from pages)
    select n.page_id, n.pos, coalesce(href, '') as href from n left join anchors a on a.page_id = n.page_id and a.pos = n.pos""",
)
def _zip_fixed(spark: SparkSession, sf: str) -> DataFrame:
    nodes, last = F.col("nodes"), F.size("nodes") - 1
    lists = page_nodes(pages(spark, sf), text_tags=()).select("page_id", field_values(nodes, LINK, F.lit(-1), last).alias("href"))
    return lists.select("page_id", F.inline(extract.zip_rows({"href": F.col("href")}, 10)))


_TRIPLE_SQL = f"""{ANCHOR_SQL},
    t as (select page_id, pos, href, name, regexp_extract(href, '/(.)', 1) as id from anchors),
    d as (select *, row_number() over (partition by page_id, id order by pos) as rn from t)
"""


@query(
    "prj_09_category_triples",
    f"with {_TRIPLE_SQL} select page_id, row_number() over (partition by page_id order by pos) - 1 as pos, href as link, name, id from d where rn = 1",
)
def _triples(spark: SparkSession, sf: str) -> DataFrame:
    out = extract.category_links(pages(spark, sf), LINK, NAME, link_id_regex="regex:/(.)")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", "name", "id")


@query("prj_10_clean_values", f"with {TEXT_SQL} select id, {ws_trim("coalesce(text, '')")} as result from texts")
def _clean_values(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.base import trim_ws

    cleaned = F.transform(F.array("text"), lambda v: F.coalesce(trim_ws(v), F.lit("")))
    return texts(spark, sf).select("id", F.get(cleaned, F.lit(0)).alias("result"))


@query("prj_11_resolve_links", f"with {ANCHOR_SQL} select page_id, pos, {HOST_SQL} || href as link from anchors")
def _resolve(spark: SparkSession, sf: str) -> DataFrame:
    out = extract.list_records(pages(spark, sf), {"link": LINK})
    return out.select("page_id", F.col("record_seq").cast("bigint").alias("pos"), "common.link")


_TEMPLATE = "https://shop.example.com/#{NODE_CATE_LIST_COMMON_MAIN_OWNER_ID}/#{NODE_CATE_LIST_COMMON_ID}?x=1"


@query(
    "prj_12_combine_template",
    """with b as (select p_partkey, ['o' || p_size, 'o' || (p_size + 1)] as owners,
        case when p_partkey % 5 = 0 then [] else ['i' || p_partkey, p_brand, p_type] end as ids from part),
    c as (select p_partkey, o, i, generate_subscripts(ids, 1) as j, oi from (
        select p_partkey, ids, unnest(owners) as o, generate_subscripts(owners, 1) as oi, ids as i from b))
    select p_partkey, cast((oi - 1) * len(i) + j - 1 as bigint) as pos, 'https://shop.example.com/' || o || '/' || i[j] || '?x=1' as link, 'plain' as constant from c""",
)
def _combine(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    owners = F.array(F.concat(F.lit("o"), size.cast("string")), F.concat(F.lit("o"), (size + 1).cast("string")))
    ids = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("i"), F.col("p_partkey").cast("string")), "p_brand", "p_type")
    )
    rows = table(spark, sf, "part").select("p_partkey", owners.alias("owners"), ids.alias("ids"))
    variables = {"NODE_CATE_LIST_COMMON_MAIN_OWNER_ID": F.col("owners"), "NODE_CATE_LIST_COMMON_ID": F.col("ids")}
    links = extract.combine_rows(rows, _TEMPLATE, variables, layer="CATE_LIST", name="link")
    constant = extract.combine_template("plain", {}, layer="CATE_LIST")
    return links.select("p_partkey", "pos", "link", F.get(constant, F.lit(0)).alias("constant"))


def parsed_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as parsed list records, all strings."""
    p = table(spark, sf, "part")
    blank = lambda names: [F.lit("").alias(n) for n in names]
    from ..operators.rules import COMMON_FIELDS

    known = {
        "link": F.concat(F.lit("https://shop.example.com/p/"), F.col("p_partkey").cast("string")),
        "main_title": F.col("p_name"), "sub_title": F.col("p_type"), "view_count": F.col("p_size").cast("string"),
        "comment_count": price_text(), "sub_images": F.concat(F.lit('["'), "p_brand", F.lit('","b"]')),
        "main_owner_name": F.col("p_brand"),
    }
    common = F.struct(*[known.get(n, F.lit("")).alias(n) for n in COMMON_FIELDS])
    product = F.struct(
        price_text().alias("price"), F.lit("USD").alias("price_currency"), price_text().alias("price_text"),
        F.concat(F.col("p_size").cast("string"), F.lit("+ sold")).alias("sales_count"), *blank(["sales_text"]),
    )
    return p.select(
        "p_partkey", common.alias("common"), F.concat(F.lit("raw"), F.col("p_partkey").cast("string")).alias("raw_id"),
        F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit('["'), "p_type", F.lit('"]')).alias("tags"),
        F.when(F.col("p_partkey") % 3 != 0, product).alias("product"),
        F.lit("https://shop.example.com/list").alias("url"),
    )


_INT = number_sql(r"-?[0-9,]+", "bigint", "0")
_NUM = number_sql(r"-?[0-9,]+(?:\.[0-9]+)?", "double", "0.0")
RECORD_SQL = f"""records as (
    select p_partkey, md5(cast(p_partkey as varchar)) as _id, 'raw' || p_partkey as raw_id, 'https://shop.example.com/p/' || p_partkey as raw_url,
      'https://shop.example.com/list' as crawl_url, cast(1700000000 as bigint) as crawl_time, p_name as main_title,
      cast(p_size as bigint) as view_count, {_INT} as comment_count, p_brand || '|b' as sub_images, p_type as tags,
      case when p_partkey % 3 <> 0 then {_NUM} end as price, case when p_partkey % 3 <> 0 then cast(p_size as bigint) end as sales_count from part)"""


@query("prj_13_content_records", f"with {RECORD_SQL} select * from records")
def _content_records(spark: SparkSession, sf: str) -> DataFrame:
    r = extract.content_records(parsed_parts(spark, sf), crawl_time=1_700_000_000)
    return r.select(
        "p_partkey", "_id", "raw_id", "raw_url", "crawl_url", "crawl_time", "common.main_title", "common.view_count",
        "common.comment_count", F.array_join("common.sub_images", "|").alias("sub_images"),
        F.array_join("content.tags", "|").alias("tags"), "content.product.price", "content.product.sales_count",
    )


@query(
    "prj_14_optional_product",
    "select p_partkey % 3 <> 0 as has_product, count(*) as n, sum(case when p_partkey % 3 <> 0 then p_size else 0 end)::bigint as sales from part group by 1",
)
def _optional_product(spark: SparkSession, sf: str) -> DataFrame:
    r = extract.content_records(parsed_parts(spark, sf), crawl_time=0)
    return r.groupBy(F.col("content.product").isNotNull().alias("has_product")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("content.product.sales_count", F.lit(0))).alias("sales")
    )


@query(
    "prj_15_derive_ids",
    f"with {ANCHOR_SQL} select page_id, pos, regexp_extract(href, '/([a-z]+)en', 1) as id, '' as prefix_only from anchors",
)
def _derive_ids(spark: SparkSession, sf: str) -> DataFrame:
    a = anchors(spark, sf)
    one = lambda rule: F.get(extract.derive_ids(F.array("href"), rule), F.lit(0))
    return a.select("page_id", "pos", one("regex:/([a-z]+)en").alias("id"), one("regex:").alias("prefix_only"))


@query(
    "prj_16_link_id_by_level",
    f"""with {ANCHOR_SQL} select page_id, pos, cast(pos % 4 as bigint) as level, case pos % 4 when 0 then coalesce(regexp_extract(href, '(?i)/([a-z])'), '')
      when 1 then coalesce(regexp_extract(href, '(?i)/([a-z]{{2,}})', 1), '') when 2 then regexp_extract(href, '(?i)E+') else '' end as link_id from anchors""",
)
def _link_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = anchors(spark, sf).withColumn("level", F.col("pos") % 4)
    rules = {0: "/[a-z]", 1: "/([a-z]{2,})", 2: " E+ "}
    return rows.select("page_id", "pos", "level", extract.link_id_by_level("href", "level", rules).alias("link_id"))


_MIXED_SQL = "case pos % 5 when 0 then href when 1 then ' ' || href || '#x ' when 2 then 'JavaScript:go()' when 3 then '#a' else '' end"


def mixed_href():
    k = F.col("pos") % 5
    return (
        F.when(k == 0, F.col("href")).when(k == 1, F.concat(F.lit(" "), "href", F.lit("#x "))).when(k == 2, "JavaScript:go()")
        .when(k == 3, "#a").otherwise("")
    )


@query(
    "prj_17_normalize_links",
    f"with {ANCHOR_SQL} select page_id, pos, case when pos % 5 < 2 then {HOST_SQL} || replace(url_encode(href), '%2F', '/') end as link from anchors",
)
def _normalize_links(spark: SparkSession, sf: str) -> DataFrame:
    return anchors(spark, sf).select("page_id", "pos", normalize_link(mixed_href(), "url").alias("link"))


@query("flt_12_page_hrefs", f"with {ANCHOR_SQL} select page_id, pos, {_MIXED_SQL} as href from anchors where pos % 5 < 2")
def _page_hrefs(spark: SparkSession, sf: str) -> DataFrame:
    rows = anchors(spark, sf).withColumn("href", mixed_href())
    return rows.filter(is_page_href("href")).select("page_id", "pos", "href")


_BUILT_SQL = f"""{TEXT_SQL}, {CAPTION_STEPS},
    urls as (select id, caption, lower('https://Shop.example.com/List?Cat=' || abs(id)) as u from captions),
    gated as (select * from urls where abs(id) between 10 and 1000000000000),
    built as (select id, caption, 'https://m.example.com/' || regexp_extract(u, 'cat=([0-9]+)', 1) || '?s=1' as url from gated)"""
_RULES = LinkRules(
    regex=r"https://shop\.example\.com/list\?cat=\d+", lower_case=True, rewrite=True, rewrite_regex="CAT=([0-9]+)",
    rewrite_head="https://m.example.com/", add_suffix=True, suffix="?s=1 ", start_gate=True, low=10, high=10**12,
)


def _shop_links(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit(" https://Shop.example.com/List?Cat="), F.abs("id").cast("string"))
    return texts(spark, sf).select("id", url.alias("url"), F.col("text").alias("name"))


@query(
    "prj_18_build_links",
    f"with {_BUILT_SQL} select id, url, caption as cate_name, url || '--2>>>-1>' || caption as line from built where caption is not null",
)
def _build(spark: SparkSession, sf: str) -> DataFrame:
    return build_links(_shop_links(spark, sf), _RULES, level=2).select("id", "url", "cate_name", "line")


@query(
    "prj_19_rewrite_url",
    "select p_partkey, 'https://m.example.com/' || p_partkey || '&r=1' as rewritten, 'https://shop.example.com/?p=' || p_partkey as kept from part",
)
def _rewrite(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://shop.example.com/?p="), F.col("p_partkey").cast("string"))
    rules = LinkRules(rewrite=True, rewrite_regex="P=([0-9]+)", rewrite_head="https://m.example.com/", add_suffix=True, suffix="&r=1")
    miss = LinkRules(rewrite=True, rewrite_regex="q=([0-9]+)", rewrite_head="https://m.example.com/")
    return table(spark, sf, "part").select("p_partkey", rewrite_url(url, rules).alias("rewritten"), rewrite_url(url, miss).alias("kept"))


@query(
    "prj_20_output_lines",
    f"""with {PATH_SQL} select c_custkey,
      case when c_custkey % 2 = 0 then 'https://shop.example.com/' || c_custkey || '--2>>>' || r_regionkey || '>' || r_name || '||' || n_name || '||' || c_name
           else 'https://shop.example.com/' || c_custkey || '--2>>>' || r_regionkey || '>' || c_name end as line,
      'https://shop.example.com/' || c_custkey || '--0>>>' || r_regionkey || '>小说||言情小说' as no_text from paths""",
)
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.category import link_line

    p = customer_paths(spark, sf)
    url = F.concat(F.lit("https://shop.example.com/"), F.col("c_custkey").cast("string"))
    path = F.when(F.col("c_custkey") % 2 == 0, F.array("r_name", "n_name", "c_name")).otherwise(F.array("c_name"))
    no_text = LinkRules(with_text=False, inter="小说||言情小说")
    return p.select(
        "c_custkey",
        link_line(url, F.lit(2), F.col("r_regionkey"), F.col("c_name"), path, LinkRules()).alias("line"),
        link_line(url, F.lit(2), F.col("r_regionkey"), F.lit(""), path, no_text).alias("no_text"),
    )


@query(
    "prj_21_level_items",
    f"with {PATH_SQL} select c_custkey, r_name as level_0, n_name as level_1, case when c_custkey % 3 = 0 then '00' else c_mktsegment end as level_2, case when c_custkey % 3 = 2 then c_name else '00' end as level_3, '00' as level_4 from paths",
)
def _level_items(spark: SparkSession, sf: str) -> DataFrame:
    return level_frame(spark, sf).select("c_custkey", *[f"level_{i}" for i in range(5)])


def level_frame(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    path = F.when(k == 0, F.array("r_name", "n_name", F.lit(""))).when(
        k == 1, F.array("r_name", "n_name", "c_mktsegment")
    ).otherwise(F.array("r_name", "n_name", "c_mktsegment", "c_name"))
    p = customer_paths(spark, sf).withColumn("path", path)
    return p.select("c_custkey", *[c.alias(n) for n, c in level_item("path").items()])


@query(
    "prj_22_repair_levels",
    f"""with {PATH_SQL}, l as (select c_custkey, case when c_custkey % 7 = 0 then '00' when c_custkey % 7 = 1 then r_name || '##5' else r_name end as level_0, n_name as level_1,
        case when c_custkey % 3 = 0 then '00' else c_mktsegment end as level_2, case when c_custkey % 3 = 2 then c_name else '00' end as level_3 from paths)
    select c_custkey, 'good' as kind, case when contains(level_0, '##') then level_0 else level_0 || '##0' end as level_0, level_1 || '##0' as level_1,
      case when level_2 = '00' then '00' else level_2 || '##0' end as level_2, case when level_3 = '00' then '00' else level_3 || '##0' end as level_3, '00' as level_4 from l where level_0 <> '00'
    union all select c_custkey, 'bad', level_0, level_1, level_2, level_3, '00' from l where level_0 = '00'""",
)
def _repair(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    rows = level_frame(spark, sf).withColumn(
        "level_0", F.when(k == 0, "00").when(k == 1, F.concat("level_0", F.lit("##5"))).otherwise(F.col("level_0"))
    )
    good, bad = repair_levels(rows)
    return good.withColumn("kind", F.lit("good")).unionByName(bad.withColumn("kind", F.lit("bad")))


@query(
    "prj_23_default_values",
    "select l.doc_id, cast(quality as varchar) as quality, case when toxic = 0 then 'clean' else cast(toxic as varchar) end as toxic, coalesce(nullif(d.source, 'src1'), 'unknown') as source from labels l join documents d on l.doc_id = d.doc_id",
)
def _defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        "doc_id", F.col("quality").cast("string").alias("quality"),
        F.nullif(F.col("toxic").cast("string"), F.lit("0")).alias("toxic"),
        F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("source"),
    )
    return extract.with_defaults(rows, ["toxic", "source"], ["clean", "unknown"])


@query(
    "prj_24_next_page_links",
    f"""with {ANCHOR_SQL}, l as (select page_id, {HOST_SQL} || href as page_link, min(pos) as first_pos from anchors group by all)
    select page_id, page_link, row_number() over (partition by page_id order by first_pos) - 1 as pos from l
    where page_link not in (select link from (select {HOST_SQL} || href as link from anchors where page_id % 10 = 0))""",
)
def _next_pages(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    found = extract.next_page_links(pages(spark, sf), LINK)
    visited = found.filter(F.col("page_id") % 10 == 0).select("page_link").distinct()
    new = found.join(visited, "page_link", "left_anti")
    # A page's own links, a bounded window.
    order = F.row_number().over(W.partitionBy("page_id").orderBy("pos")) - 1
    return new.select("page_id", "page_link", order.cast("bigint").alias("pos"))


@query(
    "prj_25_page_urls",
    """select p_partkey, n as page_no, case when n = 1 then base else base || case when contains(base, '?') then '&' else '?' end || 'page=' || n end as page_url,
       base || case when contains(base, '?') then '&' else '?' end || 'from=' || n * 20 as offset_url
    from (select p_partkey, unnest(generate_series(1, cast(p_size as bigint))) as n,
          'https://shop.example.com/list' || case when p_partkey % 2 = 0 then '?b=' || p_partkey else '' end as base from part)""",
)
def _page_urls(spark: SparkSession, sf: str) -> DataFrame:
    base = F.concat(
        F.lit("https://shop.example.com/list"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("?b="), F.col("p_partkey").cast("string"))).otherwise(""),
    )
    rows = table(spark, sf, "part").filter("p_size >= 1").select(
        "p_partkey", base.alias("base"), F.explode(F.sequence(F.lit(1), F.col("p_size")).cast("array<bigint>")).alias("page_no")
    )
    return rows.select(
        "p_partkey", "page_no", page_url("base", "page_no", "page", hide_value=1).alias("page_url"),
        page_url("base", "page_no", "from", offset_size=20).alias("offset_url"),
    )


@query(
    "prj_26_option_rows",
    """with b as (select p_partkey, case when p_partkey % 4 = 0 then [] else [p_brand, p_type, 'x'] end as names, ['https://shop.example.com/' || p_partkey, 'b'] as links from part),
    n as (select p_partkey, names, links, unnest(generate_series(1, greatest(len(names), len(links)))) as i from b)
    select p_partkey, cast(i - 1 as bigint) as pos, coalesce(names[i], '') as name, coalesce(links[i], '') as link from n""",
)
def _options(spark: SparkSession, sf: str) -> DataFrame:
    names = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit('["'), "p_brand", F.lit('","'), "p_type", F.lit('","x"]')))
    links = F.concat(F.lit('["https://shop.example.com/'), F.col("p_partkey").cast("string"), F.lit('","b"]'))
    rows = table(spark, sf, "part").select("p_partkey", names.alias("sku_color_names"), links.alias("sku_color_links"))
    return extract.option_rows(rows, {"name": "sku_color_names", "link": "sku_color_links"}, keep=("p_partkey",))
