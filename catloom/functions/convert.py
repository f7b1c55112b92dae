"""Parsed strings to typed values (SCL-50 .. SCL-53)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, let

_WIDE_DIGITS = "０１２３４５６７８９"


def json_list(value) -> Column:
    """Blank -> ``[]``; bad JSON -> the text itself; a JSON list -> strings; other JSON -> ``[]``."""
    return let(F.struct(col(value).alias("text"), F.try_parse_json(col(value)).alias("json")), _list_of)


def _list_of(v: Column) -> Column:
    empty = F.array().cast("array<string>")
    items = F.transform(
        v["json"].try_cast("array<variant>"),
        lambda e: F.when(F.is_variant_null(e), "None")
        .when(F.schema_of_variant(e) == "BOOLEAN", F.initcap(e.try_cast("string")))
        .otherwise(e.try_cast("string")),
    )
    return (
        F.when(F.coalesce(v["text"], F.lit("")) == "", empty)
        .when(v["json"].isNull(), F.array(v["text"]))
        .when(F.startswith(F.schema_of_variant(v["json"]), F.lit("ARRAY")), items)
        .otherwise(empty)
    )


def _number_text(value, pattern: str) -> Column:
    s = F.translate(col(value).cast("string"), _WIDE_DIGITS, "0123456789")
    return F.replace(F.regexp_extract(s, pattern, 0), F.lit(","), F.lit(""))


def to_integer(value) -> Column:
    """First run of digits and commas; nothing usable -> 0."""
    return F.coalesce(_number_text(value, r"-?[\d,]+").try_cast("bigint"), F.lit(0).cast("bigint"))


def to_number(value) -> Column:
    """First number with commas and decimals; nothing usable -> 0.0."""
    return F.coalesce(_number_text(value, r"-?[\d,]+(?:\.\d+)?").try_cast("double"), F.lit(0.0))
