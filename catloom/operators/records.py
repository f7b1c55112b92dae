"""The whole content record: header, common fields and dynamic content, and what a detail page adds to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import json_list, to_integer, to_number
from ..functions.urls import url_join
from ..sources.html import page_nodes
from .extract import strings, zip_rows
from .rules import FieldRule, field_values, text_tags

# Field names and defaults of the stored record.
SYSTEM_VERSION = "0.1"
STORE_VERSION = "0.0.1"
EXPORT_COUNTERS = [f"ects_{i}" for i in range(5)]
DETAIL_COMMON = (
    "summary description publish_time edited_time main_owner_name main_owner_id main_owner_link "
    "sub_owner_name sub_owner_id sub_owner_link"
).split()
DETAIL_PRODUCT = "price price_currency price_text sales_count sales_text".split()
OPTION_LISTS = {
    "sku_colors": {"name": "sku_color_names", "link": "sku_color_links"},
    "sku_types": {"name": "sku_type_names", "link": "sku_type_links"},
    "sku_plans": {"name": "sku_plan_names", "link": "sku_plan_links"},
    "other_authors": {"name": "other_author_names", "id": "other_author_ids", "link": "other_author_links"},
}
_TEXT, _LONG, _INT, _TEXTS = T.StringType(), T.LongType(), T.IntegerType(), T.ArrayType(T.StringType())


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


COMMON_TYPE = T.StructType([
    *_fields("link id main_title sub_title main_image", _TEXT), *_fields("sub_images", _TEXTS),
    *_fields("view_count favorite_count comment_count", _LONG), *_fields("summary description", _TEXT),
    *_fields("publish_time edited_time", _LONG),
    *_fields("main_owner_name main_owner_id main_owner_link sub_owner_name sub_owner_id sub_owner_link", _TEXT),
])
PRODUCT_TYPE = T.StructType([
    *_fields("price", T.DoubleType()), *_fields("price_currency price_text", _TEXT), *_fields("sales_count", _LONG), *_fields("sales_text", _TEXT),
])
CONTENT_TYPE = T.StructType([
    *_fields("tags", _TEXTS), T.StructField("product", PRODUCT_TYPE),
    *[T.StructField(n, T.ArrayType(T.StructType(_fields(" ".join(parts), _TEXT)))) for n, parts in OPTION_LISTS.items()],
])
RECORD = T.StructType([
    *_fields("_id", _TEXT), *_fields("iid", _LONG), *_fields("user_index", _INT), *_fields("user_name", _TEXT), *_fields("is_logged_in", _INT),
    *_fields("system_version mongodb_database_version raw_id raw_url crawl_url", _TEXT), *_fields("crawl_time", _LONG),
    *_fields("update_url", _TEXT), *_fields("update_time", _LONG), *_fields(" ".join(EXPORT_COUNTERS), _LONG),
    T.StructField("common", COMMON_TYPE), T.StructField("content", CONTENT_TYPE),
])


def _default(kind: T.DataType) -> Column:
    """What an unfilled field of the record holds: no list, no number, no text."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)


def _filled(struct: Column, kind: T.StructType, have: set[str]) -> Column:
    """A struct of the record's type from one that has some of its fields."""
    return F.struct(*[
        F.coalesce(struct[f.name], _default(f.dataType)).cast(f.dataType).alias(f.name) if f.name in have else _default(f.dataType).alias(f.name)
        for f in kind.fields
    ])


def whole_records(records: DataFrame, *, user_index: int = -1, user_name: str = "", logged_in: int = 1) -> DataFrame:
    """Content records (PRJ-13) with every field of the stored record but ``iid``; other columns stay.

    Fields that a list page doesn't give hold the record's empty value. ``product`` stays NULL where there is none.
    """
    have = lambda n: {f.name for f in records.schema[n].dataType.fields}
    product = F.col("content.product")
    return records.withColumns({
        "user_index": F.lit(user_index).cast("int"), "user_name": F.lit(user_name), "is_logged_in": F.lit(logged_in).cast("int"),
        "system_version": F.lit(SYSTEM_VERSION), "mongodb_database_version": F.lit(STORE_VERSION),
        "update_url": F.lit(""), "update_time": F.lit(0).cast("bigint"),
        **{c: F.lit(0).cast("bigint") for c in EXPORT_COUNTERS},
        "common": _filled(F.col("common"), COMMON_TYPE, have("common")),
        "content": F.struct(
            F.coalesce("content.tags", strings()).alias("tags"),
            F.when(product.isNotNull(), product).cast(PRODUCT_TYPE).alias("product"),
            *[_default(CONTENT_TYPE[n].dataType).alias(n) for n in OPTION_LISTS],
        ),
    })


# ---------------------------------------------------------------- detail pages

@dataclass(frozen=True)
class DetailRules:
    """Rules of the detail layer: common fields, product fields, the lists of options (JSON texts), tags and the id."""

    fields: dict[str, FieldRule]

    def __post_init__(self):
        lists = [p for parts in OPTION_LISTS.values() for p in parts.values()]
        unknown = set(self.fields) - {*DETAIL_COMMON, *DETAIL_PRODUCT, *lists, "tags", "id"}
        if unknown:
            raise ValueError(f"no detail field: {sorted(unknown)}")
        if "id" not in self.fields:
            raise ValueError("a detail page needs the rule of its id")


def detail_records(pages: DataFrame, rules: DetailRules, *, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per detail page: the first value of each field, ``''`` where a rule finds none or there is no rule.

    Of the option lists all values count: one value is a JSON list as it stands, several are the list. The last of the
    ``keep`` columns is the page's URL, against which the owners' links are resolved. Nothing is shuffled.
    """
    parsed = page_nodes(pages, keep=keep, text_tags=text_tags(list(rules.fields.values())))
    nodes, page = F.col("nodes"), F.col(keep[-1])
    found = {n: field_values(nodes, r, F.lit(-1), F.size(nodes) - 1) for n, r in rules.fields.items()}
    rows = parsed.select(*keep, *[v.alias(f"_{n}") for n, v in found.items()])

    def first(name: str) -> Column:
        if name not in found:
            return F.lit("")
        value = F.coalesce(F.get(F.col(f"_{name}"), F.lit(0)), F.lit(""))
        return F.when(value != "", url_join(page, value)).otherwise("") if name.endswith("_link") else value

    def listed(name: str) -> Column:
        if name not in found:
            return strings()
        return F.when(F.size(f"_{name}") == 1, json_list(F.get(F.col(f"_{name}"), F.lit(0)))).otherwise(F.col(f"_{name}"))

    def zipped(parts: dict[str, str]) -> Column:
        rows = zip_rows({p: listed(source) for p, source in parts.items()})
        return F.transform(rows, lambda r: F.struct(*[r[p].alias(p) for p in parts]))

    options = [zipped(parts).alias(n) for n, parts in OPTION_LISTS.items()]
    return rows.select(
        *keep, *[first(n).alias(n) for n in ("id", *DETAIL_COMMON, *DETAIL_PRODUCT)], listed("tags").alias("tags"), *options
    )


def with_details(stored: DataFrame, details: DataFrame, *, update_time: int, page_url: str = "url") -> DataFrame:
    """JN-10 on whole records: stored records with what their detail page (joined as ``d``) gives; filled values win.

    ``stored`` are rows of ``RECORD`` with ``_id``, ``details`` rows of :func:`detail_records` with ``_id``, one for each.
    """
    names = [c for c in details.columns if c != "_id"]
    both = stored.join(details.select("_id", F.struct(*names).alias("_d")), "_id")
    d = F.col("_d")
    whole = {f.name: f.dataType for f in COMMON_TYPE.fields}
    common = []
    for name, kind in whole.items():
        old = F.col(f"common.{name}")
        if name not in DETAIL_COMMON:
            common.append(old.alias(name))
        elif isinstance(kind, T.LongType):
            number = to_integer(d[name])
            common.append(F.when(number != 0, number).otherwise(old).alias(name))
        else:
            common.append(F.coalesce(F.nullif(d[name], F.lit("")), old).alias(name))
    old = F.col("content.product")
    kinds = {f.name: f.dataType for f in PRODUCT_TYPE.fields}

    def product(name: str) -> Column:
        read = {"price": to_number, "sales_count": to_integer}.get(name)
        value = F.when(d[name] != "", read(d[name]) if read else d[name]).cast(kinds[name])
        return F.coalesce(value, old[name], _default(kinds[name])).alias(name)

    any_product = F.exists(F.array(*[d[n] for n in DETAIL_PRODUCT]), lambda v: v != "")
    fuller = lambda n: F.when(F.size(d[n]) > 0, d[n]).otherwise(F.col(f"content.{n}")).alias(n)
    return both.withColumns({
        "common": F.struct(*common),
        "content": F.struct(
            fuller("tags"), F.when(old.isNotNull() | any_product, F.struct(*[product(n) for n in kinds])).alias("product"),
            *[fuller(n) for n in OPTION_LISTS],
        ),
        "update_url": d[page_url],
        "update_time": F.lit(update_time).cast("bigint"),
    }).drop("_d")
