"""Micro-batch jobs: endless de-duplication, buffered output and restartable inserts (STR-01, STR-06 .. STR-08, SNK-10)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import keep_first, unseen_in_history
from ..operators.store import ContentStore
from ..session import read_bytes, remove, scratch
from ..sources.writers import write_all
from .history import KeyHistory, TimingWheel, seeded


def check_batch_size(batch_size: int) -> int:
    """SNK-10: -1 writes everything at the end; 0 and below -1 are errors."""
    if batch_size == 0 or batch_size < -1:
        raise ValueError("batch size must be -1 or above 0")
    return batch_size


def file_stream(spark, path: str, schema, *, fmt: str = "parquet", files_per_batch: int = -1) -> DataFrame:
    """A folder as a stream; ``files_per_batch`` is the flush size, in files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if check_batch_size(files_per_batch) != -1:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work through all available input in micro-batches; a failed batch is retried from the checkpoint.

    Batches without data are switched off: state with a TTL would ask for one after
    another, and the run would never end.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query: a new checkpoint is a new feed, whose batches count from 0 again."""
    return json.loads(read_bytes(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"].replace("-", "")


def batch_folder(target: str, tag: tuple[str, int]) -> str:
    return f"{target.rstrip('/')}/feed={tag[0]}/batch={tag[1]}"


def dedup_feed(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, *, history: str | None = None, buckets: int = 64) -> StreamingQuery:
    """STR-01: the first row of every key not seen before goes to ``target``, in a folder per batch.

    Keys are remembered in ``history``, by default beside the target; a new history is seeded from what ``target``
    holds. A batch is probed against the history's filters and opens only the buckets where some key may be. A
    batch that runs again is compared with what was there before it and replaces what it wrote. Blank keys
    are never accepted.
    """
    fields = T.StructType([stream.schema[k] for k in keys])

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, scratch(batch.sparkSession, "feed")
        tag = (feed_id(spark, checkpoint), batch_id)
        try:
            keep_first(batch, keys, order).write.parquet(path)
            first = spark.read.parquet(path)
            seen = seeded(KeyHistory(spark, history or f"{target.rstrip('/')}-keys", fields, buckets=buckets), target, keys)
            folder = batch_folder(target, tag)
            seen.unseen(first, tag).select(*batch.columns).write.mode("overwrite").parquet(folder)
            seen.add(spark.read.schema(batch.schema).parquet(folder), tag)
        finally:
            remove(spark, path)

    return run(stream, each, checkpoint)


def gate_feed(
    stream: DataFrame, target: str, log: str, keys: list[str], order: list[str], checkpoint: str,
    *, clock: Callable[[int], int], ttl_seconds: int, width: int = 3600,
) -> StreamingQuery:
    """STR-02 / STR-03 without per-key state in one task: rows whose key was not seen within the TTL.

    A batch collapses to one row per key before it is shuffled, so a key with a
    third of the feed costs one row per task. Every sighting restarts the key's clock. Sightings lie
    on a timing wheel in ``log``, whose slots of ``width`` seconds are dropped whole when they are past, so a batch reads
    what is alive and no more. Both outputs are kept per batch, so a batch that runs again replaces what it
    wrote. ``clock`` gives the seconds at which a batch counts.
    """
    fields = T.StructType([stream.schema[k] for k in keys])

    def each(batch: DataFrame, batch_id: int) -> None:
        now, spark, path = clock(batch_id), batch.sparkSession, scratch(batch.sparkSession, "gate")
        tag = (feed_id(spark, checkpoint), batch_id)
        try:
            keep_first(batch, keys, order).write.parquet(path)
            first = spark.read.parquet(path)
            wheel = TimingWheel(spark, log, fields, width=width)
            passed = unseen_in_history(first, wheel.alive(now, tag), keys).select(*batch.columns)
            passed.write.mode("overwrite").parquet(batch_folder(target, tag))
            wheel.add(first, now, ttl_seconds, tag)
        finally:
            remove(spark, path)

    return run(stream, each, checkpoint)


def fan_out(stream: DataFrame, paths: dict[str, str], checkpoint: str) -> StreamingQuery:
    """SNK-11 / STR-06 on a stream: every batch to every enabled sink, in a folder of its own.

    A batch that runs again, after a sink failed, replaces what it wrote.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        own = {fmt: f"{path.rstrip('/')}/batch={batch_id}" for fmt, path in paths.items()}
        for path in own.values():
            remove(batch.sparkSession, path)
        write_all(batch, own)

    return run(stream, each, checkpoint)


def store_feed(
    stream: DataFrame, store: ContentStore, order: list[str], checkpoint: str, *, update_existing: bool = False
) -> StreamingQuery:
    """STR-07 / STR-08: insert new documents, and update known ones if asked to.

    Both ways give the same store when a batch is run again, so restarts are safe.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if update_existing:
            store.upsert(batch, order)
        else:
            store.insert_new(batch, order)

    return run(stream, each, checkpoint)
