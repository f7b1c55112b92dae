"""The text and URL functions as SQL functions, so they can be called from ``spark.sql``.

Each is a temporary SQL function whose body is a native expression; no Python runs
in the tasks. Bodies are built from the same fixed values as the Column versions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text
from .base import WHITE_SPACE
from .urls import NON_PAGE_PREFIXES


def _q(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def _trim(expr: str) -> str:
    return f"btrim({expr}, {_q(WHITE_SPACE)})"


def _replace(expr: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {_q(old)}, {_q(new)})"
    return expr


def _matches(pattern: str) -> str:
    return f"s rlike {_q(pattern)}"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, return type, body)."""
    one = "s STRING"
    blank = f"{_trim("coalesce(s, '')")} IN ('', 'void(null)', 'void(0)')"
    first_url_char = " OR ".join(f"startswith(lower({_trim('s')}), {_q(p)})" for p in NON_PAGE_PREFIXES)
    compare = f"lower(translate(lower({_replace('s', text.COMPARE_REPLACEMENTS)}), {_q(text.NUMERALS_FROM)}, {_q(text.NUMERALS_TO)}))"
    return {
        "trim_ws": (one, "STRING", _trim("s")),
        "is_trim_empty": (one, "BOOLEAN", blank),
        "is_blank": (one, "BOOLEAN", "coalesce(s, '') = ''"),
        "is_all_letter": (one, "BOOLEAN", _matches(r"\A\p{L}+\z")),
        "is_all_letter_or_number": (one, "BOOLEAN", _matches(r"\A[\p{L}\p{N}]+\z")),
        "is_all_float": (one, "BOOLEAN", _matches(r"(?dU)^[+-]?\d+\.?\d*$")),
        "has_letter": (one, "BOOLEAN", _matches("[A-Za-z]")),
        "has_chinese": (one, "BOOLEAN", _matches(r"[\u4e00-\u9fff]")),
        "is_all_chinese": (one, "BOOLEAN", _matches(r"(?d)^[\u4e00-\u9fff]+$")),
        "is_all_english": (one, "BOOLEAN", f"NOT ({_matches(r'[\u4e00-\u9fff]')})"),
        "path_key": (one, "STRING", f"replace(lower(regexp_replace(s, {_q(r'[^\p{L}\p{N}]+')}, '')), 'ß', 'ss')"),
        "decode_codes": (
            one, "STRING",
            _replace(f"CASE WHEN contains(s, ';') THEN {_replace('s', text.ENTITY_CODES)} ELSE s END", text.URL_CODES),
        ),
        "clean_category": (one, "STRING", _trim(_replace("s", text.CATEGORY_REPLACEMENTS))),
        "numbers_to_chinese": (one, "STRING", f"translate(lower(s), {_q(text.NUMERALS_FROM)}, {_q(text.NUMERALS_TO)})"),
        "compare_form": (one, "STRING", compare),
        "drop_countries": (one, "STRING", _trim(_replace("s", [(n, " ") for n in text.COUNTRY_NAMES]))),
        "to_plain_chars": (one, "STRING", f"translate(s, {_q(text.PLAIN_FROM)}, {_q(text.PLAIN_TO)})"),
        "is_page_href": (one, "BOOLEAN", f"NOT (coalesce({_trim('s')}, '') = '' OR coalesce({first_url_char}, true))"),
        "clean_url": (one, "STRING", "substring_index(s, '>', 1)"),
        "to_integer": (
            one, "BIGINT",
            f"coalesce(try_cast(replace(regexp_extract(translate(s, '０１２３４５６７８９', '0123456789'), {_q(r'-?[\d,]+')}, 0), ',', '') AS BIGINT), 0L)",
        ),
        "to_number": (
            one, "DOUBLE",
            f"coalesce(try_cast(replace(regexp_extract(translate(s, '０１２３４５６７８９', '0123456789'), {_q(r'-?[\d,]+(?:\.\d+)?')}, 0), ',', '') AS DOUBLE), 0D)",
        ),
        "store_bucket": ("s STRING, prefix STRING, n INT", "STRING", "concat(prefix, '-', upper(right(s, n)))"),
        "zero_fill": (
            "v BIGINT, n INT", "STRING",
            "CASE WHEN length(cast(v AS STRING)) >= n THEN cast(v AS STRING) "
            "WHEN v < 0 THEN concat('-', lpad(substr(cast(v AS STRING), 2), n - 1, '0')) ELSE lpad(cast(v AS STRING), n, '0') END",
        ),
    }


def register(spark: SparkSession, prefix: str = "cat_") -> list[str]:
    """Create the functions in this session and return their names."""
    names = []
    for name, (parameters, returns, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returns} RETURN {body}")
        names.append(prefix + name)
    return names
