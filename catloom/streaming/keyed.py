"""State by key in two levels without Python workers: partial states in the JVM, merged, then met with what is stored (STR-02, STR-04)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.progress import COMPLETED
from ..operators.store import ContentStore
from ..session import remove, scratch
from . import batches
from .history import TimingWheel

SALTS = 32
SWEEP = 64  # batches between two sweeps of expired states


def two_level(rows: DataFrame, keys: Sequence[str], law: Callable[[Column], Column], value: Column, *, spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """``(keys..., value)``: the rows of each key brought together by ``law``, an aggregate such as ``F.max`` for which order and grouping don't matter.

    First by key and salt, the salt a hash of the ``spread`` columns: a key with a third of the rows is the work of ``salts`` tasks.
    Then by key, with at most ``salts`` rows for each.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    partial = rows.select(*keys, value.alias("value"), salt.alias("salt")).groupBy(*keys, "salt").agg(law(F.col("value")).alias("value"))
    return partial.groupBy(*keys).agg(law(F.col("value")).alias("value"))


def seen_feed(
    stream: DataFrame, target: str, wheel: str, keys: list[str], order: list[str], checkpoint: str,
    *, clock: Callable[[int], int], ttl_seconds: int, width: int = 3600, salts: int = SALTS,
) -> StreamingQuery:
    """STR-02: every row of the feed with ``is_new``: the first in ``order`` of a key that was not seen within the TTL.

    Every sight restarts a key's clock. ``order`` is unique in a batch: rows are met with the first of their
    key by both, so a key's rows spread over all tasks. Keys with a null part are never new. Batches that run again replace what they wrote.
    """
    fields = T.StructType([stream.schema[k] for k in keys])
    rest = [o for o in order if o not in keys]
    if not rest:
        raise ValueError("the order tells the rows of a key apart")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, now, tag = batch.sparkSession, clock(batch_id), (batches.feed_id(batch.sparkSession, checkpoint), batch_id)
        path = scratch(spark, "seen")
        try:
            firsts = two_level(batch.dropna(subset=keys), keys, F.min, F.struct(*rest), spread=rest, salts=salts)
            firsts.select(*keys, *[F.col("value")[o].alias(o) for o in rest]).write.parquet(path)
            first = spark.read.parquet(path)
            seen = TimingWheel(spark, wheel, fields, width=width)
            known = seen.alive(now, tag).select(*keys).join(first.select(*keys), keys, "left_semi").distinct()
            fresh = first.join(known, keys, "left_anti").select(*[F.col(c).alias(f"_{c}") for c in [*keys, *rest]], F.lit(True).alias("is_new"))
            # All columns of the order are part of the join, so the rows of one key do not meet in one task.
            same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(o).eqNullSafe(F.col(f"_{o}")) for o in rest]
            marked = batch.join(fresh, same, "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
            marked.select(*batch.columns, "is_new").write.mode("overwrite").parquet(batches.batch_folder(target, tag))
            seen.add(first, now, ttl_seconds, tag)
        finally:
            remove(spark, path)

    return batches.run(stream, each, checkpoint)


def progress_feed(
    stream: DataFrame, target: str, states: str, checkpoint: str,
    *, clock: Callable[[int], int], key: str = "link_index", ttl_seconds: int | None = 864_000, salts: int = SALTS, length: int = 2,
) -> StreamingQuery:
    """STR-04: the progress state machine over a stream of page events (``event``, ``page_url``, ``ts_sec``, ``event_id``).

    none -> page URL (the clock restarts on every event) -> completed; expiry leads back to none. The state follows the event
    with the highest ``(ts_sec, event_id)``, a law without order, so a link's events are brought together in two levels. One row
    per link and batch goes to ``target``: the state before and after, and the stamp of the latter.

    States lie in a log-structured store with ``16 ** length`` buckets: a batch reads the buckets of its links and appends its own links. A batch
    that runs again reads the states as they were before it and replaces its run. Expired states are swept out now and then.
    """
    kind = stream.schema[key].dataType
    fields = T.StructType([
        T.StructField("_id", T.StringType()), T.StructField(key, kind), T.StructField("state", T.StringType()),
        T.StructField("ts_sec", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("touched", T.LongType()),
    ])

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, now, tag = batch.sparkSession, clock(batch_id), (batches.feed_id(batch.sparkSession, checkpoint), batch_id)
        store, own = ContentStore(spark, states, fields, length=length), f"{tag[0]}-{batch_id}"
        path = scratch(spark, "progress")
        alive = F.lit(True) if ttl_seconds is None else F.col("touched") + ttl_seconds > now
        try:
            state = F.when(F.col("event") == "completed", COMPLETED).otherwise(F.col("page_url")).alias("state")
            stamp = [F.col(c).cast("bigint").alias(c) for c in ("ts_sec", "event_id")]
            last = two_level(batch.filter(F.col(key).isNotNull()), [key], F.max, F.struct(*stamp, state), spread=["event_id", "ts_sec"], salts=salts)
            store._bucketed(last.select(F.md5(F.col(key).cast("string")).alias("_id"), key, "value")).write.parquet(path)
            fresh = spark.read.parquet(path)
            before = store.read_for(fresh, without=own).filter(alive).select("bucket", "_id", F.struct("ts_sec", "event_id", "state").alias("before"))
            met = fresh.join(before, ["bucket", "_id"], "left")
            stands = F.col("before").isNotNull() & (F.struct("before.ts_sec", "before.event_id") > F.struct("value.ts_sec", "value.event_id"))
            after = met.withColumn("after", F.when(stands, F.col("before")).otherwise(F.col("value")))
            out = after.select("_id", key, F.col("before.state").alias("state_before"), F.col("after.state").alias("state_after"), "after.ts_sec", "after.event_id")
            folder = batches.batch_folder(target, tag)
            out.drop("_id").write.mode("overwrite").parquet(folder)
            states_now = after.select("_id", key, F.col("after.state").alias("state"), "after.ts_sec", "after.event_id", F.lit(now).cast("bigint").alias("touched"))
            store.upsert(states_now, ["_id"], tag=own)
            if ttl_seconds is not None and batch_id % SWEEP == SWEEP - 1:
                store.compact(alive, but=own)
        finally:
            remove(spark, path)

    return batches.run(stream, each, checkpoint)
