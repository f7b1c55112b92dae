"""Progress of category links from a log of page events: the batch side (JN-08, STR-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import lookup_join

# States that replace a saved page URL.
COMPLETED = "COMPLETED_END"
SAME_ITEMS = "SAME_ITEMS_END"


def latest_state(events: DataFrame, *, now: Column | int, ttl_seconds: Column | int | None, key: str = "link_index") -> DataFrame:
    """STR-04 in batch: the state of each link after its last event, gone once its time is up.

    ``events`` has ``event`` (``page`` or ``completed``), ``page_url``, ``ts_sec`` and
    ``event_id`` as the tie-break. Events collapse per link before the shuffle.
    """
    value = F.when(F.col("event") == "completed", COMPLETED).otherwise(F.col("page_url"))
    last = events.groupBy(key).agg(
        F.max_by(F.struct(value.alias("state"), F.col("ts_sec").alias("seen_at")), F.struct("ts_sec", "event_id")).alias("s")
    )
    out = last.select(key, "s.state", "s.seen_at")
    if ttl_seconds is None:
        return out
    ttl = ttl_seconds if isinstance(ttl_seconds, Column) else F.lit(ttl_seconds)
    at_now = now if isinstance(now, Column) else F.lit(now)
    # A missing or zero TTL never expires.
    return out.filter(ttl.isNull() | (ttl == 0) | (F.col("seen_at") + ttl > at_now))


def resume_links(links: DataFrame, state: DataFrame, *, key: str = "link_index", first_url: str = "url") -> DataFrame:
    """JN-08: links still to do, with the URL to start from; completed ones are left out."""
    joined = lookup_join(links, state.select(key, "state"), [key], "left", spread=links.columns)
    return (
        joined.filter(F.col("state").isNull() | (F.col("state") != COMPLETED))
        .withColumn("start_url", F.coalesce("state", first_url))
        .drop("state")
    )


def put_keys(table: DataFrame, batch: DataFrame, *, now: int, ttl: int | None) -> DataFrame:
    """STR-05: key/value writes over a state table; a rewritten key restarts its clock.

    ``batch`` has ``key``, ``value`` and ``pos`` (the last write of a key counts).
    """
    expiry = F.lit(now + ttl if ttl else None).cast("bigint")
    fresh = batch.groupBy("key").agg(F.max_by("value", "pos").alias("value")).withColumn("expires_at", expiry)
    kept = table.join(fresh.select("key"), "key", "left_anti")
    return kept.select("key", "value", "expires_at").unionByName(fresh)


def get_keys(table: DataFrame, requests: DataFrame, *, now: int) -> DataFrame:
    """STR-05: one row per request; missing and expired keys read as NULL."""
    live = table.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key", "value")
    return lookup_join(requests, live, ["key"], "left", spread=["pos"])
