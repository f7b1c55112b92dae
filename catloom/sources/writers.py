"""Sinks (SNK-01 .. SNK-05, SNK-09 .. SNK-13)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists, remove, scratch
from . import readers

# Default CSV columns, default output names, and how many customer exports there are.
DEFAULT_FIELDS = ["level_0", "level_1", "level_2", "level_3"]
DEFAULT_NAMES = {"csv": "data.csv", "json": "data.json", "jsonl": "data.jsonl", "excel": "data.xlsx"}
CUSTOMERS = 5


def write_lines(lines: DataFrame, path: str, *, append: bool = False, encoding: str = "utf-8") -> None:
    """SNK-01 / SNK-02: one text column as lines. Appending adds files, so no line is ever glued.

    The text writer puts out a value's bytes as they are, so other charsets are
    encoded first.
    """
    if not readers.is_utf8(encoding):
        readers.allow_charset(lines.sparkSession)
        column = lines.columns[0]
        lines = lines.select(F.encode(column, encoding).cast("string").alias(column))
    lines.write.mode("append" if append else "overwrite").text(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, *, append: bool = True) -> None:
    """SNK-03: listed columns with a header in every part file."""
    chosen = df.select(*(fields or DEFAULT_FIELDS))
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    chosen.write.mode("append" if append else "overwrite").options(**exact).csv(path)


def write_json(df: DataFrame, path: str, *, append: bool = True) -> None:
    """SNK-04 / SNK-05: JSON lines, non-ASCII text as it is, NULL fields kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    text = readers.read_csv(spark, path, schema.fieldNames())
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Format:
    """How one output type is written and read back."""

    write: Callable[[DataFrame, str], None]
    read: Callable[[SparkSession, str, T.StructType], DataFrame]


FORMATS: dict[str, Format] = {
    "csv": Format(lambda df, p: write_csv(df, p, df.columns), _read_csv),
    "json": Format(write_json, readers.read_json_lines),
    "jsonl": Format(write_json, readers.read_json_lines),
    "txt": Format(
        lambda df, p: write_lines(df.select(F.to_json(F.struct(*df.columns)).alias("value")), p, append=True),
        readers.read_json_lines,
    ),
    "parquet": Format(
        lambda df, p: df.write.mode("append").parquet(p), lambda s, p, t: readers.read_or_empty(s, p, t, "parquet")
    ),
}


def register_format(name: str, fmt: Format) -> None:
    """Extension point for more output types."""
    FORMATS[name] = fmt


def write_as(df: DataFrame, fmt: str, path: str) -> None:
    """SNK-09: write in the named format; an unknown name is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown output type: {fmt!r}")
    FORMATS[fmt].write(df, path)


def write_all(df: DataFrame, paths: dict[str, str]) -> None:
    """SNK-11: every enabled sink from one computation; the first failure stops the rest.

    The frame is written to the shared folder once, and removed from there in the end.
    """
    spark = df.sparkSession
    once = scratch(spark, "sinks")
    df.write.parquet(once)
    try:
        rows = spark.read.schema(df.schema).parquet(once)
        for fmt, path in paths.items():
            write_as(rows, fmt, path)
    finally:
        remove(spark, once)


def snapshot(df: DataFrame, root: str, name: str, *, at: datetime) -> str:
    """SNK-12: a dated copy before data is overwritten; an empty path means there was nothing to keep."""
    if df.isEmpty():
        return ""
    path = f"{root.rstrip('/')}/{at:%Y%m%d_%H%M%S}_{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def snapshot_path(spark: SparkSession, path: str, root: str, *, at: datetime, fmt: str = "parquet") -> str:
    """SNK-12 for a path: missing source -> ``''``."""
    if not path_exists(spark, path):
        return ""
    return snapshot(spark.read.format(fmt).load(path), root, path.rstrip("/").rsplit("/", 1)[-1], at=at)


def export_customers(df: DataFrame, fields: list[list[str]], saves: list[list[str]], root: str) -> dict[str, str]:
    """SNK-13: each customer's own columns in each of their formats; returns the paths."""
    if len(fields) > CUSTOMERS or len(saves) > CUSTOMERS:
        raise ValueError(f"at most {CUSTOMERS} customers")
    done = {}
    for i, (names, formats) in enumerate(zip(fields, saves, strict=True)):
        for fmt in formats if names else []:
            path = f"{root.rstrip('/')}/customer_{i}/{fmt.lower()}"
            write_as(df.select(*names), fmt.lower(), path)
            done[f"{i}:{fmt.lower()}"] = path
    return done
