"""Keys with values and an expiry as a log-structured table (STR-03, STR-05, JN-05 in batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .skew import lookup_join
from .store import FAN, ContentStore

FIELDS = T.StructType([
    T.StructField("_id", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("expires_at", T.LongType()),
])


def alive(now: int) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


class StateTable:
    """A key/value table whose writes cost what the batch holds, and whose expired rows go when the oldest runs are merged.

    Keys lie in hash buckets of their md5, so a batch opens only the buckets of its own keys. Clocks must not run backwards.
    A batch with a ``tag`` that comes again replaces what it wrote, and reads with ``without`` see the table as it was before it.
    """

    def __init__(self, spark: SparkSession, path: str, *, length: int = 2, fan: int = FAN):
        self.store = ContentStore(spark, path, FIELDS, prefix="STATE", length=length, fan=fan)

    def put(self, batch: DataFrame, *, now: int, ttl: int | None, order: str = "pos", tag: str | None = None) -> None:
        """STR-05: write ``(key, value, <order>)``. The last write of a key counts and starts its clock anew; rows
        without a key are skipped, and a missing or zero ``ttl`` never ends."""
        last = batch.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max_by("value", order).alias("value"))
        ends = F.lit(now + ttl if ttl else None).cast("bigint").alias("expires_at")
        self.store.upsert(last.select(F.md5("key").alias("_id"), "key", "value", ends), ["key"], tag=tag, keep=alive(now))

    def get(self, requests: DataFrame, *, now: int, without: str | None = None) -> DataFrame:
        """JN-05: every request (a row with ``key``) with its value, NULL where it is missing or expired."""
        keys = requests.select("key").filter(F.col("key").isNotNull()).distinct()
        asked = written(self.store._bucketed(keys.select(F.md5("key").alias("_id"), "key")), "asked")
        known = self.store.read_for(asked, without=without).filter(alive(now)).select("bucket", "_id", "value")
        found = asked.join(known, ["bucket", "_id"]).select("key", "value")
        return lookup_join(requests, found, ["key"], "left")

    def read(self, *, now: int) -> DataFrame:
        """All live keys."""
        return self.store.read(alive(now)).select("key", "value", "expires_at")
