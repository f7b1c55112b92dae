"""Queries for predicates, sorting and caps (FLT-*, SRT-*, WIN-03, WIN-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_more_caption
from ..functions.urls import order_query
from ..operators import caps, filters
from ..operators.dedup import parse_link_line
from ..operators.sequence import dense_position
from ..operators.skew import lookup_join, top_n_per_group
from ..specs import parse_indexes, parse_item_indexes, parse_range, parse_scope, parse_sort
from .catalog import query, table
from .extraction import parsed_parts
from .scalars import _PRICE_SQL, price_text
from .views import TEXT_SQL, seconds, texts

_TRIM = f"trim({_PRICE_SQL})"
# Plain prices next to the awkward ones, so that ranges have something to find.
_VALUE_SQL = f"case when p_partkey % 2 = 0 then ' ' || p_retailprice || ' ' else {_PRICE_SQL} end"
_IN = f"coalesce(try_cast(trim({_VALUE_SQL}) as decimal(38,10)) between {{}} and {{}}, false)"


def _value():
    return F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" "))).otherwise(price_text())


@query("flt_01_allow_range", f"select p_partkey from part where {_IN.format('950.5', '1000')}")
def _allow(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(filters.allow_range(_value(), parse_range("950.5-1000"))).select("p_partkey")


@query("flt_02_reject_range", f"select p_partkey from part where not {_IN.format('950.5', '1000')}")
def _reject(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(filters.reject_range(_value(), parse_range("950.5-1000"))).select("p_partkey")


_BLANK_SQL = "case when p_partkey % 3 = 0 then ' ' || chr(9) else p_name end"


def _blank():
    return F.when(F.col("p_partkey") % 3 == 0, " \t").otherwise(F.col("p_name"))


@query("flt_03_all_present", f"select p_partkey from part where p_partkey % 3 <> 0 and {_TRIM} <> ''")
def _all_present(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(filters.all_present([_blank(), price_text()])).select("p_partkey")


@query("flt_04_any_present", f"select p_partkey from part where p_partkey % 3 <> 0 or {_TRIM} <> ''")
def _any_present(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(filters.any_present([_blank(), price_text()])).select("p_partkey")


_RECORD_VALID = f"""(p_size between 5 and 40) and p_partkey % 3 <> 0
    and not (p_partkey % 3 <> 0 and coalesce(try_cast({_TRIM} as decimal(38,10)) between -20 and -10, false))"""


@query("flt_05_split_records", f"select p_partkey, case when {_RECORD_VALID} then 'valid' else 'invalid' end as kind from part")
def _split(spark: SparkSession, sf: str) -> DataFrame:
    rule = filters.RecordFilter(
        allow_field="cate_list_common_view_count_css", allow_range="5-40",
        reject_field="CATE_LIST_PRODUCT_PRICE", reject_range="-20--10",
        all_of=("CATE_LIST_COMMON_MAIN_TITLE", " ", "CATE_LIST_RAW_COMMON_ID"),
        any_of=("CATE_LIST_PRODUCT_SALES_COUNT", "CATE_LIST_COMMON_UNKNOWN"),
    )
    valid, invalid = rule.split(parsed_parts(spark, sf))
    return valid.withColumn("kind", F.lit("valid")).unionByName(invalid.withColumn("kind", F.lit("invalid"))).select("p_partkey", "kind")


@query(
    "flt_06_filter_fields",
    "select p_partkey, p_partkey % 3 <> 0 as has_price_currency, true as has_id, false as has_unknown, true as has_tags from part",
)
def _fields(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda n: filters.RecordFilter(any_of=(n,)).condition()
    return parsed_parts(spark, sf).select(
        "p_partkey", has("CATE_LIST_PRODUCT_PRICE_CURRENCY_XPATH").alias("has_price_currency"), has("CATE_LIST_COMMON_ID").alias("has_id"),
        has("CATE_LIST_COMMON_NOTHING").alias("has_unknown"), has("cate_list_raw_common_tags").alias("has_tags"),
    )


@query(
    "flt_07_range_texts",
    "select count(*) as everything, count_if(p_size = 7) as one, count_if(p_size between 7 and 9) as run, count_if(p_retailprice between 950.5 and 1000.25) as decimals from part",
)
def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda c, t: F.count_if(filters.allow_range(c, parse_range(t)))
    return table(spark, sf, "part").agg(
        count("p_size", "-1").alias("everything"), count("p_size", "7").alias("one"), count("p_size", "7-9").alias("run"),
        count("p_retailprice", "950.5 - 1000.25").alias("decimals"),
    )


@query(
    "flt_08_position_scope",
    "select c_custkey from customer where c_nationkey between 3 and 9 and c_custkey % 11 in (2, 4, 7)",
)
def _positions(spark: SparkSession, sf: str) -> DataFrame:
    scope = parse_scope("3-9>2,4,7")
    return table(spark, sf, "customer").filter(
        filters.allow_index("c_nationkey", scope.parents) & filters.allow_index(F.col("c_custkey") % 11, scope.children)
    ).select("c_custkey")


@query(
    "flt_09_id_scope",
    """select c_custkey, 'pair' as scope from customer where c_custkey % 4 <> 0 and c_nationkey in (0, 1, 2) and c_custkey % 11 in (1, 3)
    union all select c_custkey, 'parents' from customer where c_nationkey = 5
    union all select c_custkey, 'children' from customer where c_custkey % 4 <> 0 and c_custkey % 11 = 6
    union all select c_custkey, 'open' from customer""",
)
def _ids(spark: SparkSession, sf: str) -> DataFrame:
    first, second = F.col("c_nationkey").cast("int"), (F.col("c_custkey") % 11).cast("int")
    rows = table(spark, sf, "customer").withColumn(
        "ids", F.when(F.col("c_custkey") % 4 == 0, F.array(first)).otherwise(F.array(first, second))
    )
    scopes = {"pair": ("0-2>1,3", False), "parents": ("5>-1", False), "children": ("-1>6", False), "open": ("3>3", True)}
    named = F.array_compact(
        F.array(*[F.when(filters.in_scope("ids", parse_scope(t), index_empty=e), n) for n, (t, e) in scopes.items()])
    )
    return rows.select("c_custkey", F.explode(named).alias("scope"))


@query(
    "flt_10_index_specs",
    "select l_linenumber = 3 as one, l_linenumber in (1, 2, 4) as listed, l_linenumber between 0 and 2 as run, count(*) as n from lineitem group by all",
)
def _index_specs(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda t: parse_indexes(t).contains(F.col("l_linenumber"))
    return table(spark, sf, "lineitem").groupBy(
        has("3").alias("one"), has("1,2,4").alias("listed"), has("0-2").alias("run")
    ).agg(F.count("*").alias("n"))


@query("flt_11_scope_text", "select l_orderkey, l_partkey, cast(l_linenumber as bigint) as line from lineitem where l_linenumber in (1, 3) and l_suppkey between 0 and 20")
def _scope_text(spark: SparkSession, sf: str) -> DataFrame:
    scope = parse_scope("0-20>1,3")
    return table(spark, sf, "lineitem").filter(
        scope.parents.contains(F.col("l_suppkey")) & scope.children.contains(F.col("l_linenumber"))
    ).select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("line"))


@query(
    "flt_13_full_match",
    r"select page_id, regexp_full_match(url, '(?i)https?://(www|m)\.[a-z]+\.EXAMPLE\.(com|net)/.*') as matched, true as blank, false as broken from pages",
)
def _full_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", filters.full_match("url", r"https?://(www|m)\.[a-z]+\.EXAMPLE\.(com|net)/.*").alias("matched"),
        filters.full_match("url", " ").alias("blank"), filters.full_match("url", "(").alias("broken"),
    )


_START_SQL = "'https://shop.example.com/list?a=1&cat=' || case when p_partkey % 6 = 0 then p_brand else cast(p_partkey as varchar) end"


@query(
    "flt_14_start_id_gate",
    """select p_partkey, p_partkey % 6 = 0 or p_partkey between 100 and 900 as both, p_partkey % 6 = 0 or p_partkey >= 500 as low,
      p_partkey % 6 = 0 or p_partkey <= 500 as high, p_partkey not in (7, 11, 500) as denied, true as open from part""",
)
def _gate(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 6 == 0, F.col("p_brand")).otherwise(F.col("p_partkey").cast("string"))
    url = F.concat(F.lit("https://shop.example.com/list?a=1&cat="), tail)
    gate = lambda **k: filters.start_id_gate(url, **k)
    return table(spark, sf, "part").select(
        "p_partkey", gate(low=100, high=900).alias("both"), gate(low=500).alias("low"), gate(high=500).alias("high"),
        gate(low=1, high=2, denied=("7", "11", "500")).alias("denied"), gate().alias("open"),
    )


@query(
    "flt_15_more_captions",
    f"with {TEXT_SQL} select id from texts where contains(text, '更多') or contains(lower(text), 'more') or contains(text, '查看上级分类')",
)
def _more(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).filter(is_more_caption("text")).select("id")


_LINE_SQL = """case p_partkey % 6 when 0 then ' https://x.example.com/a--b/' || p_partkey || '-- 2 >>>-1>' || p_name when 1 then '' when 2 then 'https://x.example.com/--two>>>-1>n'
    when 3 then 'https://x.example.com/1--2' when 4 then '--1>>>x' else 'u' || p_partkey || '--0>>>5>>>>a' end"""


def _line():
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    return (
        F.when(k == 0, F.concat(F.lit(" https://x.example.com/a--b/"), key, F.lit("-- 2 >>>-1>"), "p_name")).when(k == 1, "")
        .when(k == 2, "https://x.example.com/--two>>>-1>n").when(k == 3, "https://x.example.com/1--2").when(k == 4, "--1>>>x")
        .otherwise(F.concat(F.lit("u"), key, F.lit("--0>>>5>>>>a")))
    )


@query(
    "flt_16_link_lines",
    """select p_partkey, case p_partkey % 6 when 0 then 'https://x.example.com/a--b/' || p_partkey when 5 then 'u' || p_partkey end as url,
       cast(case p_partkey % 6 when 0 then 2 when 5 then 0 end as bigint) as level from part""",
)
def _link_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", parse_link_line(_line()).alias("p"))
    return p.select("p_partkey", "p.url", "p.level")


@query(
    "flt_17_positional_pick",
    """with u as (select url, row_number() over (order by page_id) - 1 as index from pages)
    select s.i - 3 as spec_pos, s.i as index, url from generate_series(3, (select count(*) + 5 from pages)) s(i) left join u on u.index = s.i""",
)
def _pick(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes past the end stay in the frame with a NULL url: the report of skipped ones."""
    pages = table(spark, sf, "pages")
    numbered = dense_position(pages.select("page_id", "url"), ["page_id"], "index", start=0)
    spec = parse_item_indexes(f"3-{pages.count() + 5}")
    return spec.frame(spark).join(numbered.select("index", "url"), "index", "left")


@query("flt_18_open_levels", "select l_orderkey, l_partkey, cast(l_linenumber as bigint) as level from lineitem where l_linenumber in (0, 1, 3)")
def _levels(spark: SparkSession, sf: str) -> DataFrame:
    gate = filters.level_open("l_linenumber", [True, True, False, True, True], 3)
    return table(spark, sf, "lineitem").filter(gate).select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("level"))


@query("flt_19_level_limit", "select c_custkey from customer where c_custkey % 3 = 0 or c_nationkey = c_custkey % 25")
def _limit(spark: SparkSession, sf: str) -> DataFrame:
    limit = F.when(F.col("c_custkey") % 3 == 0, -1).otherwise(F.col("c_custkey") % 25)
    rows = table(spark, sf, "customer").withColumns({"limit": limit, "ids": F.array("c_nationkey")})
    return rows.filter(filters.within_limit("limit", "ids")).select("c_custkey")


# ---------------------------------------------------------------- sort, caps

_FIELDS = {"fields": ["l_extendedprice", "l_partkey"], "ordered_fields": ["l_extendedprice"], "orders": ["asc", "desc"]}


@query(
    "srt_01_sorted",
    """select rn, l_orderkey, l_partkey, cast(l_linenumber as bigint) as line, l_extendedprice from (
       select row_number() over (order by l_extendedprice desc, l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity) as rn, * from lineitem)""",
)
def _sorted(spark: SparkSession, sf: str) -> DataFrame:
    spec = parse_sort("l_extendedprice|desc", **_FIELDS)
    rows = table(spark, sf, "lineitem").withColumn("_neg", -F.col(spec.field) if spec.order == "desc" else F.col(spec.field))
    keys = ["_neg", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity"]
    # The global order as a number, so that it can be compared; buckets keep it parallel.
    return dense_position(rows, keys, "rn").select(
        "rn", "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_extendedprice"
    )


@query("srt_01_order_by", "select l_orderkey, l_partkey, l_extendedprice from lineitem")
def _order_by(spark: SparkSession, sf: str) -> DataFrame:
    spec = parse_sort("l_extendedprice|desc", **_FIELDS)
    return caps.sort_by(table(spark, sf, "lineitem"), spec).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("srt_02_last_first", "select row_number() over (order by page_id desc) as step, page_id, url from pages")
def _last_first(spark: SparkSession, sf: str) -> DataFrame:
    ordered = table(spark, sf, "pages").withColumn("_neg", -F.col("page_id"))
    return dense_position(ordered, ["_neg"], "step").select("step", "page_id", "url")


@query(
    "srt_03_truncate_lists",
    "select vec_id, cast(len(embedding) as bigint) as n_all, cast(len(embedding[1:5]) as bigint) as n_five, cast(embedding[1] + embedding[5] as double) as ends from embeddings",
)
def _truncate(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rules import cut

    e, five = cut(F.col("embedding"), -1), cut(F.col("embedding"), 5)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(e).cast("bigint").alias("n_all"), F.size(five).cast("bigint").alias("n_five"),
        (F.get(five, F.lit(0)) + F.element_at(five, -1)).cast("double").alias("ends"),
    )


@query(
    "srt_04_query_order",
    """select p_partkey, 'https://x.example.com/l?page=' || p_partkey || '&c=' || p_size || '&a=1&b=' || p_type || '#f' as listed,
      'https://x.example.com/l?a=1&b=' || p_type || '&c=' || p_size || '&page=' || p_partkey || '#f' as up,
      'https://x.example.com/l?page=' || p_partkey || '&c=' || p_size || '&b=' || p_type || '&a=1#f' as down,
      'https://x.example.com/l?b=' || p_type || '&a=1&c=' || p_size || '&page=' || p_partkey || '#f' as mixed from part""",
)
def _query_order(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    url = F.concat(F.lit("https://x.example.com/l?c="), s("p_size"), F.lit("&page="), s("p_partkey"), F.lit("&a=1&b="), "p_type", F.lit("#f"))
    rows = table(spark, sf, "part").select("p_partkey", url.alias("url"))
    return rows.select(
        "p_partkey", order_query("url", ["page", "c"]).alias("listed"), order_query("url", mode="asc").alias("up"),
        order_query("url", mode="desc").alias("down"), order_query("url", ["b"], "asc").alias("mixed"),
    )


@query(
    "srt_05_nested_caps",
    """with p as (select *, event_id % 50 as page_no from events), l as (select *, row_number() over (partition by user_id, event_type order by event_id) as k from p where page_no <= 40),
    u as (select *, row_number() over (partition by user_id order by event_id) as r from l where k <= 5)
    select event_id, user_id, event_type from u where r <= 12""",
)
def _caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 50).alias("page_no"))
    return caps.nested_caps(
        rows, user="user_id", link="event_type", order=["event_id"], page_no="page_no", max_page_no=40, per_link=5, per_user=12
    ).select("event_id", "user_id", "event_type")


@query(
    "win_03_cap_per_group",
    "select l_orderkey, l_partkey, rn from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_partkey, l_linenumber, l_quantity) as rn from lineitem) where rn <= 20",
)
def _cap(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")]]
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = top_n_per_group(rows, ["l_suppkey"], order, 20, spread=["l_orderkey", "l_partkey", "l_linenumber"], rank="rn")
    return out.select("l_orderkey", "l_partkey", F.col("rn").cast("bigint").alias("rn"))


_STOP_SQL = """e as (select event_id, event_type as link, cast(floor(epoch(ts) / 3600) as bigint) - (select cast(floor(min(epoch(ts)) / 3600) as bigint) from events) as page_no,
      user_id % 40 as item from events),
    f as (select *, row_number() over (partition by link, item order by page_no, event_id) = 1 as is_new from e),
    p as (select link, page_no, sum(is_new::int) as fresh from f group by all),
    w as (select *, sum(fresh) over (partition by link order by page_no rows between 2 preceding and current row) as s, count(*) over (partition by link order by page_no rows between 2 preceding and current row) as c from p),
    stops as (select link, min(page_no) as stop_page from w where c = 3 and s = 0 group by 1)"""


def _crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Events as pages of a link: the hour is the page, the item is new where it comes first."""
    e = table(spark, sf, "events")
    hour = F.floor(seconds("ts") / 3600)
    start = e.agg(F.min(hour).alias("h")).first()["h"]
    rows = e.select("event_id", F.col("event_type").alias("link"), (hour - start).alias("page_no"), (F.col("user_id") % 40).alias("item"))
    first = rows.groupBy("link", "item").agg(F.min(F.struct("page_no", "event_id")).alias("first"))
    joined = lookup_join(rows, first, ["link", "item"], "inner", spread=["event_id"])
    return joined.withColumn("is_new", F.struct("page_no", "event_id") == F.col("first")).drop("first")


@query(
    "win_06_stop_pages",
    f"with {_STOP_SQL} select f.event_id, f.link, f.page_no, f.is_new from f left join stops s on s.link = f.link where s.stop_page is null or f.page_no <= s.stop_page",
)
def _stop(spark: SparkSession, sf: str) -> DataFrame:
    rows = _crawl(spark, sf)
    stops = caps.stop_pages(rows, link="link", page_no="page_no", fresh="is_new", streak=3)
    return caps.until_stop(rows, stops, link="link", page_no="page_no", spread=["event_id"]).select("event_id", "link", "page_no", "is_new")
