"""Registry of named queries: a Spark job over the given tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query registered twice: {name}")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def nested_replace(text: str, pairs: list[tuple[str, str]]) -> str:
    """SQL twin of ordered replacements."""
    for old, new in pairs:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    return text
