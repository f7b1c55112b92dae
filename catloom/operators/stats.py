"""Statistics (AGG-01, AGG-02, AGG-07 .. AGG-09, AGG-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import text_class
from ..functions.urls import store_bucket
from .category import EMPTY_LEVEL, LEVEL_FIELDS


def _filled(c: str) -> Column:
    return F.when(~F.coalesce(F.col(c), F.lit("")).isin("", EMPTY_LEVEL), F.col(c))


def level_stats(items: DataFrame, *, exact: bool = True) -> DataFrame:
    """AGG-01: row count, and per level the filled rows and distinct values."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    facts = [F.count("*").alias("total_items")]
    for c in LEVEL_FIELDS:
        facts += [F.count(_filled(c)).alias(f"{c}_count"), distinct(_filled(c)).alias(f"unique_{c}")]
    return items.agg(*facts)


def level_rollup(items: DataFrame) -> DataFrame:
    """AGG-01 option: row counts per level path and all its prefixes."""
    return items.rollup(*LEVEL_FIELDS).agg(F.count("*").alias("n"))


def path_stats(items: DataFrame, fields: Sequence[str] = tuple(LEVEL_FIELDS[:4])) -> DataFrame:
    """AGG-02: total, unique and repeated level paths; a missing level counts as ``00``."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(EMPTY_LEVEL)) for c in fields])
    counted = items.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    total, unique = F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")
    return counted.agg(total.alias("total"), unique.alias("unique"), (total - unique).alias("duplicates"))


def file_size(frame: DataFrame) -> DataFrame:
    """Bytes of the files behind a file-based frame."""
    files = frame.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_size"))


def bucket_report(ids: DataFrame, *, prefix: str = "CONTENT", length: int = 2) -> DataFrame:
    """AGG-07: ids per bucket and the bucket's load against the mean."""
    sizes = ids.groupBy(store_bucket("_id", prefix, length).alias("bucket")).agg(F.count("*").alias("n"))
    # At most 16^length rows, 256 by default.
    mean = F.sum("n").over(W.partitionBy()) / 16**length
    return sizes.select("bucket", "n", (F.col("n") / mean).alias("load"))


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """AGG-08: how many texts fall into each class; :func:`with_class` keeps the texts themselves."""
    return df.groupBy(text_class(column).alias("text_class")).agg(F.count("*").alias("n"))


def with_class(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("text_class", text_class(column))


def batch_counts(df: DataFrame, valid: Column) -> DataFrame:
    """AGG-09: one row with the total, valid and invalid counts; a NULL condition is invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def observed(df: DataFrame, valid: Column, name: str = "batch") -> tuple[DataFrame, Observation]:
    """AGG-09: valid, invalid and total counts, taken while the frame passes by."""
    watch = Observation(name)
    ok = F.coalesce(valid, F.lit(False))
    return df.observe(
        watch, F.count("*").alias("rows"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid")
    ), watch


def export_counters(records: DataFrame, log: DataFrame, *, customers: int = 5) -> DataFrame:
    """AGG-11: how often each record went to each customer, as ``ects_0 ..``."""
    counts = log.groupBy("_id").agg(
        *[F.count_if(F.col("customer") == i).alias(f"ects_{i}") for i in range(customers)]
    )
    # Both sides have one row per _id.
    joined = records.join(counts, "_id", "left")
    return joined.fillna(0, [f"ects_{i}" for i in range(customers)])
