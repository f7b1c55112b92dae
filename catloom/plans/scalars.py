"""Queries for the scalar functions (SCL-*)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, text, urls
from .catalog import lit, nested_replace, query, table
from .views import TEXT_SQL, texts, ws_trim

DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨"
HAN = r"[\x{4e00}-\x{9fff}]"
EMPTY = ws_trim("coalesce(text, '')") + " in ('', 'void(null)', 'void(0)')"


def on_texts(name: str, sql: dict[str, str], job: Callable[[], dict[str, Column]]) -> None:
    """One query over every caption and whole document: named columns and their SQL twins."""
    columns = ", ".join(f"{s} as {c}" for c, s in sql.items())

    @query(name, f"with {TEXT_SQL} select id, {columns} from texts")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return texts(spark, sf).select("id", *[c.alias(n) for n, c in job().items()])


def one(name: str, sql: str, job: Callable[[str], Column]) -> None:
    on_texts(name, {"result": sql}, lambda: {"result": job("text")})


def match(pattern: str, source: str = "text") -> str:
    return f"regexp_matches({source}, {lit(pattern)})"


one("scl_01_extract_regex_key", f"coalesce(regexp_extract({ws_trim('text')}, '(?i)([a-z]+)ti', 1), '')",
    lambda c: text.extract_regex_key(c, "([a-z]+)ti"))
one("scl_02_is_trim_empty", EMPTY, text.is_trim_empty)
one("scl_03_is_blank", "coalesce(text, '') = ''", text.is_blank)
one("scl_04_is_all_letter", match(r"^\p{L}+$"), text.is_all_letter)
one("scl_05_is_all_number", match(f"^[{DIGIT}]+$"), text.is_all_number)
one("scl_06_is_all_float", match(r"^[+-]?\p{Nd}+\.?\p{Nd}*\n?$"), text.is_all_float)
one("scl_07_is_all_letter_or_number", match(r"^[\p{L}\p{N}]+$"), text.is_all_letter_or_number)
one("scl_08_is_all_letter_or_float", match(r"^[a-zA-Z0-9.+\-]+\n?$"), text.is_all_letter_or_float)
one("scl_09_has_number", match(f"[{DIGIT}]"), text.has_number)
one("scl_10_has_chinese", match(HAN), text.has_chinese)
one("scl_11_is_all_chinese", match(f"^{HAN}+\\n?$"), text.is_all_chinese)
one("scl_12_is_all_english", f"not {match(HAN)}", text.is_all_english)
one("scl_13_has_letter", match("[A-Za-z]"), text.has_letter)
on_texts(
    "scl_14_one_char",
    {"is_letter": match(r"^\p{L}$", "left(text, 1)"), "is_number": match(f"^[{DIGIT}]$", "right(text, 1)"),
     "whole_is_letter": match(r"^\p{L}$")},
    lambda: {"is_letter": text.is_letter_char(F.left("text", F.lit(1))),
             "is_number": text.is_number_char(F.right("text", F.lit(1))), "whole_is_letter": text.is_letter_char("text")},
)
_OTHER_SQL = "case abs(id) % 3 when 0 then text when 1 then ' ' else upper(text) end"
one(
    "scl_15_is_same",
    f"case when {EMPTY} and {EMPTY.replace('text', '(' + _OTHER_SQL + ')')} then true "
    f"when {EMPTY} or {EMPTY.replace('text', '(' + _OTHER_SQL + ')')} then false else text = {_OTHER_SQL} end",
    lambda c: text.is_same(
        c, F.when(F.abs("id") % 3 == 0, F.col(c)).when(F.abs("id") % 3 == 1, " ").otherwise(F.upper(c))
    ),
)


@query(
    "scl_16_zero_fill",
    """select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey,
       case when v < 0 then '-' || lpad(cast(-v as varchar), cast(greatest(5, length(cast(-v as varchar))) as int), '0')
            else lpad(cast(v as varchar), cast(greatest(6, length(cast(v as varchar))) as int), '0') end as filled
       from (select *, l_orderkey * 97 - l_partkey * 53 as v from lineitem)""",
)
def _zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("l_orderkey") * 97 - F.col("l_partkey") * 53
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey",
        text.zero_fill(v, 6).alias("filled"),
    )


_LOWERED = ws_trim("lower(coalesce(text, ''))")
one(
    "scl_17_title_words",
    f"case when length(regexp_replace({_LOWERED}, '[^a-z]', '', 'g')) <= 3 then upper({_LOWERED}) else "
    f"array_to_string(list_transform(regexp_extract_all({_LOWERED}, '[a-z]+|[^a-z]+'), "
    "lambda r: case when regexp_matches(r, '^[a-z]') then upper(r[1]) || r[2:] else r end), '') end",
    text.title_words,
)
one("scl_18_to_space_replace", ws_trim(f"lower(regexp_replace(text, '[^\\p{{L}}{DIGIT}]+', ' ', 'g'))"), text.to_space_replace)
one("scl_19_path_key", r"replace(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')), 'ß', 'ss')", text.path_key)
_DECODED = nested_replace(
    f"case when contains(text, ';') then {nested_replace('text', text.ENTITY_CODES)} else text end", text.URL_CODES
)
one("scl_20_decode_codes", _DECODED, text.decode_codes)


def refs_sql(source: str) -> str:
    def fold(head: str) -> str:
        refs = f"regexp_extract_all({source}, '{head}([0-9]{{2,}});', 1)"
        char = "case when length(r) <= 7 and cast(r as bigint) <= 1114111 then chr(cast(r as integer)) else '" + head + "' || r || ';' end"
        return f"list_reduce(list_prepend({source}, {refs}), lambda t, r: replace(t, '{head}' || r || ';', {char}))"

    blank = ws_trim(f"coalesce({source}, '')")
    return (
        f"case when {blank} = '' then '' when not contains({source}, ';') then {source} "
        f"when contains({source}, '&#') then {fold('&#')} when contains({source}, '&') then {fold('&')} else {source} end"
    )


one("scl_21_decode_numeric_refs", refs_sql("text"), text.decode_numeric_refs)
one("scl_22_clean_category", ws_trim(nested_replace("text", text.CATEGORY_REPLACEMENTS)), text.clean_category)
_NUMERALS = f"translate(lower(text), {lit(text.NUMERALS_FROM)}, {lit(text.NUMERALS_TO)})"
one("scl_23_numbers_to_chinese", _NUMERALS, text.numbers_to_chinese)
one(
    "scl_24_compare_form",
    "lower(" + _NUMERALS.replace("lower(text)", f"lower({nested_replace('text', text.COMPARE_REPLACEMENTS)})") + ")",
    text.compare_form,
)
_PRODUCT = ws_trim(
    f"regexp_replace(regexp_replace({nested_replace('text', text.PRODUCT_REPLACEMENTS)}, '(?i)&amp;', '&', 'g'), '(?i)&nbsp;', ' ', 'g')"
)
on_texts(
    "scl_25_clean_product_name",
    {"result": f"(select case when left(p, 1) in (':', '：') and length(p) > 1 then p[2:] else p end from (select {_PRODUCT} as p))"},
    lambda: {"result": text.clean_product_name("text")},
)


@query(
    "scl_26_split_name_type",
    f"""with {TEXT_SQL},
    t as (select id, {ws_trim("coalesce(text, '')")} as t from texts),
    s as (select id, t, strpos(t, ' ') as sp, length(regexp_extract(t, '^(?:[\\x00-\\x7F]+|[^\\x00-\\x7F]+)')) as run from t)
    select id,
      case when t in ('', 'void(null)', 'void(0)') then ''
           when sp >= 2 and (ascii(t) < 128 or (ascii(t[sp - 1]) > 127 and ascii(t[sp + 1]) > 127)) then t[1:sp - 1]
           when run < length(t) then t[1:run] when sp > 0 then t[1:sp - 1] else '' end as name,
      case when t in ('', 'void(null)', 'void(0)') then ''
           when sp >= 2 and (ascii(t) < 128 or (ascii(t[sp - 1]) > 127 and ascii(t[sp + 1]) > 127)) then t[sp + 1:]
           when run < length(t) then case when t[run + 1] = ' ' then t[run + 2:] else t[run + 1:] end
           when sp > 0 then t[sp + 1:] else '' end as type
    from s""",
)
def _split_name_type(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", text.split_name_type("text").alias("s")).select("id", "s.name", "s.type")


_EDGES = (
    r"regexp_replace(regexp_replace(text, '([\x00-\x7F])([^\x00-\x7F])', '\1 \2', 'g'), "
    r"'([^\x00-\x7F])([\x00-\x7F])', '\1 \2', 'g')"
)
one("scl_27_space_scripts", f"case when {EMPTY} then '' else {ws_trim(f"regexp_replace({_EDGES}, ' +', ' ', 'g')")} end", text.space_scripts)
one("scl_28_ignore_case_replace", r"regexp_replace(text, '(?i)the ([a-z])', '<\1>', 'g')",
    lambda c: text.ignore_case_replace(c, "the ([a-z])", r"<\1>"))
one("scl_29_drop_countries", ws_trim(nested_replace("text", [(n, " ") for n in text.COUNTRY_NAMES])), text.drop_countries)

_OPENED = f"replace({_DECODED.replace('text', 't')}, '&#8249;', ' ')"
CAPTION_STEPS = f"""
    c0 as (select *, {ws_trim('text')} as t from texts),
    c1 as (select *, {_DECODED.replace('text', 't')} as coded from c0),
    c2 as (select *, replace(coded, '&#8249;', ' ') as opened from c1),
    c3 as (select *, {refs_sql('opened')} as chinese from c2),
    c4 as (select *, {ws_trim(nested_replace('chinese', text.CATEGORY_REPLACEMENTS))} as n0 from c3),
    c5 as (select *, split_part(split_part(case when n0 = '' then '其他' else n0 end, '（', 1), '(', 1) as n1 from c4),
    captions as (select *, case when contains(t, '更多') or contains(lower(t), 'more') or contains(t, '查看上级分类') then null
        when contains(coded, '&#8249;') and {ws_trim('opened')} = '' then null
        when {ws_trim('n1')} = '' then '其他' else {ws_trim('n1')} end as caption from c5)"""


@query("scl_30_clean_caption", f"with {TEXT_SQL}, {CAPTION_STEPS} select id, caption as result, 'shop||' || caption as prefixed from captions")
def _clean_caption(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(
        "id", text.clean_caption("text").alias("result"), text.clean_caption("text", prefix=" shop ").alias("prefixed")
    )


_ROLE_FREE = ws_trim(nested_replace(nested_replace("text", [(w, " ") for w in text.ROLE_WORDS]), [(n, " ") for n in text.COUNTRY_NAMES]))


@query(
    "scl_31_drop_role_words",
    f"""with {TEXT_SQL}, w as (select id, list_filter(string_split({_ROLE_FREE}, ' '), lambda x: length(x) > 1) as words from texts)
    select id, array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), ' ') as result from w""",
)
def _drop_role_words(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", text.drop_role_words("text").alias("result"))


one("scl_32_to_plain_chars", f"translate(text, {lit(text.PLAIN_FROM)}, {lit(text.PLAIN_TO)})", text.to_plain_chars)
_STOP = ["the", "of", "and", "un", "la", *text.ATTRIBUTE_KEYS]
one(
    "scl_33_drop_words",
    "array_to_string(list_filter(string_split(lower(text), ' '), lambda w: not list_contains(["
    + ", ".join(lit(w) for w in _STOP) + "], w)), ' ')",
    lambda c: F.array_join(text.drop_words(F.split(F.lower(c), " "), _STOP), " "),
)


# ---------------------------------------------------------------- urls and keys

def on_pages(name: str, sql: dict[str, str], job: Callable[[], dict[str, Column]]) -> None:
    columns = ", ".join(f"{s} as {c}" for c, s in sql.items())

    @query(name, f"select page_id, {columns} from pages")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in job().items()])


_AWKWARD_SQL = "(replace(url, '/en/', '/Ä b~*/100%25/ß+(x)/') || case page_id % 4 when 0 then '' when 1 then '?a=1&b=ü' when 2 then '#top' else ';v=1?' end)"


def _awkward() -> Column:
    tail = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, "?a=1&b=ü").when(F.col("page_id") % 4 == 2, "#top").otherwise(";v=1?")
    return F.concat(F.replace("url", F.lit("/en/"), F.lit("/Ä b~*/100%25/ß+(x)/")), tail)


def _normal_sql(encoded: bool) -> str:
    u = f"regexp_replace({_AWKWARD_SQL}, '#.*$', '')"
    head, query_part = f"regexp_extract({u}, '^(https?://[^/?]*)', 1)", f"regexp_extract({u}, '(\\?.+)$', 1)"
    path = f"regexp_extract({u}, '^https?://[^/?]*([^?]*)', 1)"
    plain, params = f"regexp_replace({path}, ';[^/;]*$', '')", f"regexp_extract({path}, '(;[^/;]*)$', 1)"
    if encoded:
        plain = f"replace(replace(url_encode({plain}), '%2F', '/'), '%25', '%')"
    return f"{head} || {plain} || {params} || {query_part}"


on_pages("scl_40_normalize_url", {"source": _AWKWARD_SQL, "result": _normal_sql(True)},
         lambda: {"source": _awkward(), "result": urls.normalize_url(_awkward())})
on_pages("scl_42_normalize_url_plain", {"result": _normal_sql(False)},
         lambda: {"result": urls.normalize_url(_awkward(), encode_path=False)})

# Links of a site, resolved the way a browser does; {} takes the page number.
_HREFS = {
    "/a/{}": "{host}/a/{}", "//cdn.example.org/{}": "{scheme}//cdn.example.org/{}", "https://x.example.org/{}#f": "https://x.example.org/{}#f",
    "mailto:a{}@b": "mailto:a{}@b", "/a/./b/../{}": "{host}/a/{}", "/../../{}": "{host}/{}", "/x//y/{}/..": "{host}/x//y/",
}


@query(
    "scl_41_url_join",
    "select page_id, href, joined from ("
    + " union all ".join(
        f"select page_id, replace({lit(h)}, '{{}}', cast(page_id as varchar)) as href, replace(replace(replace({lit(j)}, '{{}}', cast(page_id as varchar)), "
        "'{host}', regexp_extract(url, '^(https?://[^/?#]+)', 1)), '{scheme}', regexp_extract(url, '^(https?:)', 1)) as joined from pages"
        for h, j in _HREFS.items()
    )
    + ")",
)
def _url_join(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = F.explode(F.array(*[F.lit(h) for h in _HREFS]))
    rows = table(spark, sf, "pages").select("page_id", "url", hrefs.alias("href"))
    rows = rows.withColumn("href", F.replace("href", F.lit("{}"), F.col("page_id").cast("string")))
    return rows.select("page_id", "href", urls.url_join("url", "href").alias("joined"))


on_pages("scl_43_clean_url", {"result": "split_part(url || case page_id % 3 when 0 then '>>>1>x' when 1 then '>y' else '' end, '>', 1)"},
         lambda: {"result": urls.clean_url(F.concat("url", F.when(F.col("page_id") % 3 == 0, ">>>1>x").when(F.col("page_id") % 3 == 1, ">y").otherwise("")))})
one("scl_44_md5", "md5(text)", lambda c: F.md5(c))
on_texts(
    "scl_45_bucket",
    {"store_bucket": "'CONTENT-' || upper(right(md5(text), 2))", "store_bucket_3": "'C-' || upper(right(md5(text), 3))",
     "cache_key": "'content:' || right(md5(text), 2) || ':' || md5(text)"},
    lambda: {"store_bucket": urls.store_bucket(F.md5("text"), "CONTENT"), "store_bucket_3": urls.store_bucket(F.md5("text"), "C", 3),
             "cache_key": urls.cache_key(F.md5("text"), "content")},
)
_ORDER_SQL = "case when event_id % 3 = 0 then 'desc' when event_id % 3 = 1 then 'asc' end"


@query(
    "scl_46_keys",
    f"""select event_id, 'page:' || event_type || coalesce('-' || {_ORDER_SQL}, '') as head,
    'page:' || event_type || coalesce('-' || {_ORDER_SQL}, '') || ':' || user_id as key from events""",
)
def _keys(spark: SparkSession, sf: str) -> DataFrame:
    order = F.when(F.col("event_id") % 3 == 0, "desc").when(F.col("event_id") % 3 == 1, "asc")
    head = urls.head_key("page", "event_type", order)
    return table(spark, sf, "events").select("event_id", head.alias("head"), urls.make_key(head, "user_id").alias("key"))


@query(
    "scl_47_field_ttl",
    "select event_id, cast(case event_type when 'click' then 604800 when 'view' then 172800 when 'purchase' then 0 end as bigint) as ttl from events",
)
def _ttl(spark: SparkSession, sf: str) -> DataFrame:
    ttl = urls.field_ttl("event_type", {"click": 604800, "view": 172800, "purchase": 0})
    return table(spark, sf, "events").select("event_id", ttl.alias("ttl"))


# ---------------------------------------------------------------- conversions

_JSON_SQL = """case event_id % 7 when 0 then props when 1 then '["' || event_type || '", ' || user_id || ', true, null, 1.5]'
    when 2 then '' when 3 then 'x' || props when 4 then cast(user_id as varchar) when 5 then '[]' else '["' || event_type || '"' end"""


def _json() -> Column:
    k, user = F.col("event_id") % 7, F.col("user_id").cast("string")
    return (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit('["'), "event_type", F.lit('", '), user, F.lit(", true, null, 1.5]")))
        .when(k == 2, "").when(k == 3, F.concat(F.lit("x"), "props")).when(k == 4, user).when(k == 5, "[]")
        .otherwise(F.concat(F.lit('["'), "event_type", F.lit('"')))
    )


@query(
    "scl_50_json_list",
    f"""with j as (select event_id, {_JSON_SQL} as v from events)
    select event_id, case when v = '' then '' when not json_valid(v) then v when json_type(v) <> 'ARRAY' then ''
      else array_to_string(list_transform(list_transform(generate_series(0, cast(json_array_length(v) as int) - 1), lambda i: json_extract(v, '$[' || i || ']')),
        lambda e: case when json_type(e) = 'NULL' then 'None' when json_type(e) = 'BOOLEAN' then upper(left(cast(e as varchar), 1)) || right(cast(e as varchar), -1)
                       else json_extract_string(e, '$') end), '|') end as items,
      case when v = '' then 0 when not json_valid(v) then 1 when json_type(v) <> 'ARRAY' then 0 else cast(json_array_length(v) as bigint) end as n
    from j""",
)
def _json_list(spark: SparkSession, sf: str) -> DataFrame:
    items = convert.json_list(_json())
    return table(spark, sf, "events").select(
        "event_id", F.array_join(items, "|").alias("items"), F.size(items).cast("bigint").alias("n")
    )


_PRICE_SQL = """case p_partkey % 8 when 0 then '' when 1 then '￥' || p_retailprice when 2 then '1.2万' when 3 then '-' || p_size
    when 4 then ',' when 5 then cast(p_partkey as varchar) || ',456.50 USD' when 6 then '价格 １２' || p_size || '.5' else p_name end"""


def price_text() -> Column:
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    return (
        F.when(k == 0, "").when(k == 1, F.concat(F.lit("￥"), F.col("p_retailprice").cast("string"))).when(k == 2, "1.2万")
        .when(k == 3, F.concat(F.lit("-"), size)).when(k == 4, ",")
        .when(k == 5, F.concat(F.col("p_partkey").cast("string"), F.lit(",456.50 USD")))
        .when(k == 6, F.concat(F.lit("价格 １２"), size, F.lit(".5"))).otherwise(F.col("p_name"))
    )


def number_sql(pattern: str, kind: str, zero: str) -> str:
    plain = f"translate({_PRICE_SQL}, '０１２３４５６７８９', '0123456789')"
    return f"coalesce(try_cast(replace(regexp_extract({plain}, {lit(pattern)}), ',', '') as {kind}), {zero})"


@query("scl_51_to_integer", f"select p_partkey, {number_sql(r'-?[0-9,]+', 'bigint', '0')} as result from part")
def _to_integer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", convert.to_integer(price_text()).alias("result"))


@query("scl_52_to_number", f"select p_partkey, {number_sql(r'-?[0-9,]+(?:\.[0-9]+)?', 'double', '0.0')} as result from part")
def _to_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", convert.to_number(price_text()).alias("result"))


@query(
    "scl_53_epoch_seconds",
    "select event_id, cast(floor(epoch(ts)) as bigint) as result, cast(1700000000 as bigint) as crawl_time from events",
)
def _epoch(spark: SparkSession, sf: str) -> DataFrame:
    from .views import seconds

    # The job's clock is read once on the driver and passed in, so retried tasks agree.
    return table(spark, sf, "events").select("event_id", seconds("ts").alias("result"), F.lit(1700000000).cast("bigint").alias("crawl_time"))
