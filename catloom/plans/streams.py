"""Queries for the streaming behaviour (STR-*, SNK-10): tables played through Structured Streaming to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.store import new_store
from ..session import scratch, written
from ..streaming import batches, keyed, state
from .catalog import query, table
from .relations import link_events


def _as_stream(df: DataFrame, name: str, *, parts: int = 3, key: str = "event_id", files_per_batch: int = 1) -> DataFrame:
    """A frame as files of a folder, and the folder as a stream of several batches."""
    path = scratch(df.sparkSession, name)
    df.repartitionByRange(parts, key).write.parquet(path)
    return batches.file_stream(df.sparkSession, path, df.schema, files_per_batch=files_per_batch)


def _drain(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    target = scratch(spark, name)
    batches.run(stream, lambda batch, _: batch.write.mode("append").parquet(target), scratch(spark, "cp")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type")


@query("str_01_feed_dedup", "select user_id, event_type, 1::bigint as n from events group by all")
def _feed(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch(spark, "feed")
    stream = _as_stream(_events(spark, sf), "feed-in")
    batches.dedup_feed(stream, target, ["user_id", "event_type"], ["event_id"], scratch(spark, "cp"), buckets=8).awaitTermination()
    return spark.read.parquet(target).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("str_02_seen_set", "select user_id, count(*) as rows, 1::bigint as first_seen from events group by 1")
def _seen(spark: SparkSession, sf: str) -> DataFrame:
    target, wheel = scratch(spark, "seen"), scratch(spark, "wheel")
    stream = _as_stream(_events(spark, sf), "seen-in")
    # One second per batch: nothing expires between the batches of this run.
    keyed.seen_feed(stream, target, wheel, ["user_id"], ["event_id"], scratch(spark, "cp"), clock=lambda n: n, ttl_seconds=604_800).awaitTermination()
    return spark.read.parquet(target).groupBy("user_id").agg(F.count("*").alias("rows"), F.count_if("is_new").alias("first_seen"))


@query("str_03_page_gate", "select event_type as sort_field, user_id as page, count(*) as rows, 1::bigint as passed from events group by all")
def _gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("event_id", F.col("event_type").alias("sort_field"), F.lit("asc").alias("sort_order"), F.col("user_id").alias("page"))
    gated = state.first_seen(_as_stream(rows, "gate-in"), ["sort_field", "sort_order", "page"], ttl_seconds=172_800)
    return _drain(gated, "gate").groupBy("sort_field", "page").agg(F.count("*").alias("rows"), F.count_if("is_new").alias("passed"))


@query("str_03_page_gate_batches", "select event_type as sort_field, user_id as page, 1::bigint as passed from events group by all")
def _gate_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("event_id", F.col("event_type").alias("sort_field"), F.col("user_id").alias("page"))
    target, log = scratch(spark, "passed"), scratch(spark, "sightings")
    # One second per batch: nothing expires between the batches of this run.
    batches.gate_feed(
        _as_stream(rows, "gate-in"), target, log, ["sort_field", "page"], ["event_id"], scratch(spark, "cp"),
        clock=lambda batch_id: batch_id, ttl_seconds=172_800,
    ).awaitTermination()
    return spark.read.parquet(target).groupBy("sort_field", "page").agg(F.count("*").alias("passed"))


@query(
    "str_04_progress_states",
    """select user_id as link_index, arg_max(case when event_type = 'purchase' then 'COMPLETED_END' else 'https://x.example.com/' || event_type || '/' || event_id end, struct_pack(t := floor(epoch(ts)), e := event_id)) as state from events group by 1""",
)
def _progress(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of every link, after its events came in several batches."""
    spark_events = link_events(spark, sf)
    target, states = scratch(spark, "progress"), scratch(spark, "states")
    stream = _as_stream(spark_events, "progress-in")
    keyed.progress_feed(stream, target, states, scratch(spark, "cp"), clock=lambda n: n, length=1).awaitTermination()
    out = spark.read.parquet(target)
    last = F.max_by("state_after", F.struct("ts_sec", "event_id"))
    return out.groupBy("link_index").agg(last.alias("state"))


_ORDER = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])


@query("str_06_micro_batches", "select f as format, count(*) as n from orders, (values ('jsonl'), ('parquet')) v(f) group by 1")
def _micro(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "fan")
    orders = table(spark, sf, "orders").select(*_ORDER.fieldNames())
    stream = _as_stream(orders, "orders-in", key="o_orderkey")
    batches.fan_out(stream, {f: f"{root}/{f}" for f in ("jsonl", "parquet")}, scratch(spark, "cp")).awaitTermination()
    jsonl = spark.read.schema(_ORDER).json(f"{root}/jsonl").drop("batch").withColumn("format", F.lit("jsonl"))
    parquet = spark.read.schema(_ORDER).parquet(f"{root}/parquet").drop("batch").withColumn("format", F.lit("parquet"))
    return jsonl.unionByName(parquet).groupBy("format").agg(F.count("*").alias("n"))


@query("snk_10_one_flush", "select o_orderkey, o_orderstatus from orders")
def _one_flush(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(*_ORDER.fieldNames())
    return _drain(_as_stream(orders, "flush-in", key="o_orderkey", files_per_batch=-1), "flush")


_DOC = T.StructType([T.StructField("_id", T.StringType()), T.StructField("doc_id", T.LongType())])


@query("str_07_restart", "select md5(text) as _id, count(distinct 1) as n from documents group by 1")
def _restart(spark: SparkSession, sf: str) -> DataFrame:
    """The same feed twice with fresh checkpoints, as after a lost one: nothing is stored twice."""
    docs = table(spark, sf, "documents").select(F.md5("text").alias("_id"), "doc_id")
    store = new_store(spark, _DOC, length=1)
    stream = _as_stream(docs, "docs-in", key="doc_id")
    for _ in range(2):
        batches.store_feed(stream, store, ["doc_id"], scratch(spark, "cp")).awaitTermination()
    return written(store.read(), "stored").groupBy("_id").agg(F.count("*").alias("n"))
