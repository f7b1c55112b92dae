"""Columns of extracted values to rows, records and links (PRJ-08 .. PRJ-16, PRJ-23 .. PRJ-26)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import JavaPattern, col, let
from ..functions.convert import json_list, to_integer, to_number
from ..functions.text import extract_regex_key
from ..functions.urls import join_parts, url_join, url_parts
from ..sources.html import page_nodes
from .rules import (
    COMMON_FIELDS,
    PRODUCT_FIELDS,
    FieldRule,
    RegionRule,
    cut,
    field_values,
    regions,
    strip_regex_prefix,
    text_tags,
    with_father,
)

# The variables a combine template may use, and the layer each belongs to.
NODE_VARIABLES = {
    "NODE_CATE_LIST_COMMON_ID": "CATE_LIST",
    "NODE_CATE_LIST_COMMON_SUB_OWNER_ID": "CATE_LIST",
    "NODE_CATE_LIST_COMMON_MAIN_OWNER_ID": "CATE_LIST",
    "NODE_DETAIL_COMMON_MAIN_OWNER_ID": "DETAIL",
    "NODE_DETAIL_COMMON_SUB_OWNER_ID": "DETAIL",
}
_VARIABLE = re.compile(r"#\{(NODE_[A-Za-z_][A-Za-z0-9_]*)\}")
COMBINED_BLOCK = 1024  # combinations numbered in one cell
_EMPTY = "array<string>"


def strings() -> Column:
    return F.array().cast(_EMPTY)


# ---------------------------------------------------------------- zip

def longest(*arrays: Column) -> Column:
    """AGG-06: size of the longest list."""
    sizes = [F.size(a) for a in arrays]
    return F.greatest(*sizes) if len(sizes) > 1 else sizes[0]


def zip_rows(arrays: dict[str, Column], max_count: int = -1) -> Column:
    """PRJ-08: lists to an array of records, short lists padded with ``''``.

    The record count is the longest list for -1, otherwise exactly ``max_count``.
    """
    names = list(arrays)
    count = longest(*arrays.values()) if max_count == -1 else F.lit(max_count)

    def record(i: Column) -> Column:
        return F.struct(
            i.cast("bigint").alias("pos"),
            *[F.coalesce(F.get(arrays[n], i), F.lit("")).alias(n) for n in names],
        )

    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count), record)


# ---------------------------------------------------------------- templates

def template_variables(template: str, layer: str) -> list[str]:
    """Names used by a combine template; unknown or other-layer names are an error."""
    names = _VARIABLE.findall(template)
    for name in names:
        if name not in NODE_VARIABLES:
            raise ValueError(f"unknown template variable: {name}")
        if NODE_VARIABLES[name] != layer:
            raise ValueError(f"{name} belongs to layer {NODE_VARIABLES[name]}, not {layer}")
    return names


def combine_template(template: str, variables: dict[str, Column], *, layer: str) -> Column:
    """PRJ-12: every combination of the variables' values, the last variable fastest."""
    names = template_variables(template, layer)
    fragments = _VARIABLE.split(template)[::2]
    out = F.array(F.lit(fragments[0]))
    for name, tail in zip(names, fragments[1:], strict=True):
        values = variables.get(name, strings())
        out = _append_each(out, values, tail)
    return out


def combine_rows(df: DataFrame, template: str, variables: dict[str, Column], *, layer: str, pos: str = "pos", name: str = "combined") -> DataFrame:
    """PRJ-12 as rows: ``df`` once for every combination, with its number ``pos`` and text ``name``, the last variable fastest.

    A combination is its number written in mixed radix, one digit for each variable, so no product lies in a
    cell: numbers are given out in blocks, and each row decodes its own. A row with an empty list gives none.
    """
    names = template_variables(template, layer)
    fragments = _VARIABLE.split(template)[::2]
    lists = {f"_v{i}": variables.get(n, strings()) for i, n in enumerate(names)}
    held = df.withColumns(lists) if lists else df
    count = F.lit(1).cast("bigint")
    for v in lists:
        count = count * F.coalesce(F.size(v), F.lit(0))
    last = F.floor((F.col("_count") - 1) / COMBINED_BLOCK).cast("bigint")
    blocks = held.withColumn("_count", count).filter("_count > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("_block") * COMBINED_BLOCK
    rows = blocks.withColumn(pos, F.explode(F.sequence(first, F.least(first + COMBINED_BLOCK, F.col("_count")) - 1)))
    text, rest = F.lit(fragments[-1]), F.col(pos)
    for v, fragment in zip(reversed(lists), reversed(fragments[:-1]), strict=True):
        text = F.concat(F.lit(fragment), F.get(F.col(v), (rest % F.size(v)).cast("int")), text)
        rest = F.floor(rest / F.size(v)).cast("bigint")
    return rows.withColumn(name, text).drop("_count", "_block", *lists)


def _append_each(heads: Column, values: Column, tail: str) -> Column:
    return F.flatten(
        F.transform(heads, lambda head: F.transform(values, lambda v: F.concat(head, v, F.lit(tail))))
    )


# ---------------------------------------------------------------- list records

def _scopes(nodes: Column, rules: list[RegionRule], page_fields: tuple[str, ...], page_max: int,
            page_combine: tuple[str, ...] = ()) -> list[tuple[int, RegionRule, Column]]:
    active, found = regions(nodes, rules)
    if found:
        return active
    page = F.array(F.struct(F.lit(-1).alias("node_id"), (F.size(nodes) - 1).alias("end_id")))
    whole = RegionRule(child_max_count=page_max, fields=page_fields, combine_fields=page_combine)
    return [(-1, whole, page)]


def _region_rows(pages: DataFrame, parts: list[Column], keep: list[str]) -> DataFrame:
    found = parts[0] if len(parts) == 1 else F.concat(*parts)
    return pages.select(*keep, F.explode(found).alias("r")).select(*keep, "r.*")


def _per_region(unit: int, found: Column, body: Callable[[Column, Column], list[Column]]) -> Column:
    return F.transform(
        found,
        lambda n, i: F.struct(
            F.lit(unit).alias("unit"), i.alias("region_seq"), *body(n["node_id"], n["end_id"])
        ),
    )


def list_records(
    pages: DataFrame,
    fields: dict[str, FieldRule],
    region_rules: list[RegionRule] | None = None,
    *,
    content_type: str = "product",
    max_count: int = -1,
    keep: tuple[str, ...] = ("page_id", "url"),
) -> DataFrame:
    """Parsed list records of each page, all strings, one row per record.

    ``fields`` maps names to rules: the common and product fields plus ``id``,
    ``raw_id`` and ``tags``. Region rules choose the regions and the fields read
    there; child mode 0 turns into a father search range. The last of the ``keep``
    columns is the page's URL. Nothing is shuffled.
    """
    names = [*COMMON_FIELDS, "id", "raw_id", "tags"] + (PRODUCT_FIELDS if content_type == "product" else [])
    if not set(names) & set(fields):
        raise ValueError("no field to extract")
    rules = dict(fields)
    for region in region_rules or []:
        if region.child_block != 1:
            for name in region.fields:
                rules[name] = with_father(rules[name], region)
    combine = tuple(n for n, r in rules.items() if r.combine)
    plain = tuple(n for n, r in rules.items() if not r.combine)
    variable_of = {"id": "ID", "main_owner_id": "MAIN_OWNER_ID", "sub_owner_id": "SUB_OWNER_ID"}

    parsed = page_nodes(pages, keep=keep, text_tags=text_tags(list(rules.values())))
    nodes, nothing = F.col("nodes"), strings()
    parts = []
    for unit, region, found in _scopes(nodes, region_rules or [], plain, max_count, combine):

        def body(lo: Column, hi: Column, region: RegionRule = region) -> list[Column]:
            values = {
                n: field_values(nodes, rules[n], lo, hi, region.child_max_count) if n in region.fields else nothing
                for n in names
            }
            return [
                F.lit(region.child_max_count).alias("max_count"),
                F.array(*[F.lit(n) for n in region.combine_fields]).cast(_EMPTY).alias("combined"),
                *[v.alias(n) for n, v in values.items()],
            ]

        parts.append(_per_region(unit, found, body))
    rows = _region_rows(parsed, parts, list(keep))

    # Combined fields are built from the region's own lists, then all lists are zipped.
    for name in combine:
        variables = {f"NODE_CATE_LIST_COMMON_{v}": F.col(f) for f, v in variable_of.items()}
        built = combine_template(rules[name].combine, variables, layer="CATE_LIST")
        rows = rows.withColumn(name, F.when(F.array_contains("combined", F.lit(name)), built).otherwise(F.col(name)))

    read = [n for n in names if n in rules]
    count = F.when(F.col("max_count") == -1, longest(*[F.col(n) for n in read])).otherwise(F.col("max_count"))
    index = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)
    out = rows.select(*keep, "unit", "region_seq", *read, F.explode(index).alias("record_seq"))
    page, blank = F.col(keep[-1]), F.lit("")

    def value(name: str) -> Column:
        if name not in rules:
            return blank
        v = F.coalesce(F.get(F.col(name), F.col("record_seq")), F.lit(""))
        return F.when(v != "", url_join(page, v)).otherwise("") if name == "link" else v

    return out.select(
        *keep, "unit", "region_seq", "record_seq",
        F.struct(*[value(n).alias(n) for n in COMMON_FIELDS]).alias("common"),
        *[value(n).alias(n) for n in ("raw_id", "id", "tags")],
        (
            F.struct(*[value(n).alias(n) for n in PRODUCT_FIELDS])
            if content_type == "product"
            else F.lit(None).cast("struct<" + ",".join(f"{n}:string" for n in PRODUCT_FIELDS) + ">")
        ).alias("product"),
    )


def content_records(parsed: DataFrame, *, crawl_time: int | Column, page_url: str = "url") -> DataFrame:
    """PRJ-13/14: typed content records from parsed list records.

    ``crawl_time`` is passed in so that a retried task writes the same record.
    """
    c = F.col("common")
    counts = ("view_count", "favorite_count", "comment_count")
    common = []
    for name in ["link", "id", *COMMON_FIELDS[1:]]:
        if name == "id":
            common.append(F.col("id").alias("id"))
        elif name == "sub_images":
            common.append(json_list(c[name]).alias(name))
        elif name in counts:
            common.append(to_integer(c[name]).alias(name))
        else:
            common.append(c[name].alias(name))
    p = F.col("product")
    product = F.when(
        p.isNotNull(),
        F.struct(
            to_number(p["price"]).alias("price"),
            p["price_currency"].alias("price_currency"),
            p["price_text"].alias("price_text"),
            to_integer(p["sales_count"]).alias("sales_count"),
            p["sales_text"].alias("sales_text"),
        ),
    )
    stamp = crawl_time if isinstance(crawl_time, Column) else F.lit(crawl_time)
    return parsed.withColumns(
        {
            "_id": F.md5(F.col("id")),
            "raw_url": c["link"],
            "crawl_url": F.col(page_url),
            "crawl_time": stamp.cast("bigint"),
            "content": F.struct(json_list(F.col("tags")).alias("tags"), product.alias("product")),
            "common": F.struct(*common),
        }
    ).drop("product", "tags")


# ---------------------------------------------------------------- category triples

def derive_ids(links: Column, link_id_regex: str) -> Column:
    """PRJ-15: ids read from links; no rule -> no ids, a rule that is only the prefix -> blanks."""
    if not link_id_regex:
        return strings()
    text = strip_regex_prefix(link_id_regex)
    if not text:
        return F.transform(links, lambda _: F.lit(""))
    pattern = JavaPattern(text)
    if not pattern.valid:
        raise ValueError(f"bad link id pattern: {link_id_regex!r}")
    return F.transform(
        links, lambda u: F.coalesce(F.regexp_extract(u, pattern.text, pattern.group), F.lit(""))
    )


def link_id_by_level(url, level, level_regex: dict[int, str]) -> Column:
    """PRJ-16: link id by the rule of its level; no rule -> ``''``."""
    out = F.lit("")
    for n in sorted(level_regex, reverse=True):
        out = F.when(col(level) == n, extract_regex_key(url, level_regex[n])).otherwise(out)
    return out


def category_links(
    pages: DataFrame,
    link: FieldRule,
    name: FieldRule,
    *,
    link_id_regex: str = "",
    region_rules: list[RegionRule] | None = None,
    max_count: int = -1,
    keep: tuple[str, ...] = ("page_id", "url"),
) -> DataFrame:
    """PRJ-09 with AGG-04: ``(link, name, id)`` rows per region, de-duplicated in their region.

    Lists of unequal length are left as they are; otherwise the first row of each
    id counts, or of each link where there are no ids.
    """
    parsed = page_nodes(pages, keep=keep, text_tags=text_tags([link, name]))
    nodes = F.col("nodes")
    parts = []
    for unit, region, found in _scopes(nodes, region_rules or [], ("link", "name"), max_count):

        def body(lo: Column, hi: Column, region: RegionRule = region) -> list[Column]:
            return [
                F.lit(region.child_max_count).alias("max_count"),
                field_values(nodes, link, lo, hi, region.child_max_count).alias("links"),
                field_values(nodes, name, lo, hi, region.child_max_count).alias("names"),
            ]

        parts.append(_per_region(unit, found, body))
    rows = _region_rows(parsed, parts, list(keep))
    rows = rows.withColumn("ids", derive_ids(F.col("links"), link_id_regex))
    rows = dedup_triples(rows)
    count = F.when(
        F.col("max_count") == -1, longest(F.col("links"), F.col("names"), F.col("ids"))
    ).otherwise(F.col("max_count"))
    index = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)
    at = lambda n: F.coalesce(F.get(F.col(n), F.col("pos")), F.lit(""))
    return rows.select(*keep, "unit", "region_seq", "links", "names", "ids", F.explode(index).alias("pos")).select(
        *keep, "unit", "region_seq", "pos", at("links").alias("link"), at("names").alias("name"), at("ids").alias("id")
    )


def dedup_triples(rows: DataFrame) -> DataFrame:
    """AGG-04 on the list columns ``links``, ``names``, ``ids`` of one region per row."""
    links, names, ids = F.col("links"), F.col("names"), F.col("ids")
    have_ids = F.size(ids) > 0
    even = (F.size(links) == F.size(names)) & (~have_ids | (F.size(ids) == F.size(links)))
    keys = F.when(have_ids, ids).otherwise(links)
    first = F.filter(
        F.transform(keys, lambda k, i: F.when(F.array_position(keys, k) == i + 1, i)), lambda i: i.isNotNull()
    )
    rows = rows.withColumn("_first", F.when(even, first))
    take = lambda a: F.transform(F.col("_first"), lambda i: F.get(a, i))
    picked = {"links": take(links), "names": take(names), "ids": F.when(have_ids, take(ids)).otherwise(ids)}
    return rows.withColumns(
        {n: F.when(F.col("_first").isNull(), F.col(n)).otherwise(c) for n, c in picked.items()}
    ).drop("_first")


# ---------------------------------------------------------------- small steps

def with_defaults(df: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """PRJ-23: blank fields take their default value."""
    if bool(names) != bool(values) or len(names) != len(values):
        raise ValueError("default names and values must pair up")
    return df.withColumns(
        {n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit(v)) for n, v in zip(names, values, strict=True)}
    )


def next_page_links(pages: DataFrame, rule: FieldRule, *, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """PRJ-24: page links found on each page, resolved, first occurrence of each."""
    parsed = page_nodes(pages, keep=keep, text_tags=text_tags([rule]))
    nodes, page = F.col("nodes"), F.col(keep[-1])
    found = field_values(nodes, rule, F.lit(-1), F.size(nodes) - 1)
    links = parsed.select(*keep, found.alias("found"))
    joined = let(
        url_parts(page),
        lambda base: F.transform(
            F.filter(F.col("found"), lambda h: h != ""), lambda h: join_parts(base, page, h)
        ),
    )
    return links.select(*keep, F.posexplode(F.array_distinct(joined)).alias("pos", "page_link"))


def option_rows(df: DataFrame, lists: dict[str, str], *, keep: tuple[str, ...]) -> DataFrame:
    """PRJ-26: JSON-list text columns of one entity to one row per option."""
    parsed = df.select(*keep, *[json_list(F.col(c)).alias(n) for n, c in lists.items()])
    return parsed.select(*keep, F.inline(zip_rows({n: F.col(n) for n in lists})))


def truncate_lists(df: DataFrame, column: str, count: int) -> DataFrame:
    """SRT-03 on a list column."""
    return df.withColumn(column, cut(F.col(column), count))


def all_combinations(*lists: list[str]) -> list[tuple[str, ...]]:
    """Driver-side order of :func:`combine_template`, for checks."""
    return list(itertools.product(*lists))
