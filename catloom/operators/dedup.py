"""Keep-first de-duplication, tiers and set operations (AGG-03, AGG-05, JN-04 .. JN-06, JN-09, SET-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import col
from ..functions.urls import store_bucket
from ..session import written
from .extract import link_id_by_level
from .skew import lookup_join


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, drop_blank: bool = True) -> DataFrame:
    """AGG-03 / WIN-01: the first row of each key in ``order``; blank keys are never accepted.

    An aggregate rather than a window: copies of a key collapse before the
    shuffle, so a key with a third of all rows sends one row per task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if drop_blank:
        for k in keys:
            df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def accepted_flags(df: DataFrame, key: str, order: Sequence[str], *, spread: Sequence[str]) -> DataFrame:
    """Every row with ``accepted``: true for the first row of its (non-blank) key."""
    first = (
        df.filter(F.coalesce(F.col(key), F.lit("")) != "")
        .groupBy(key)
        .agg(F.min(F.struct(*order)).alias("_first"))
    )
    joined = lookup_join(df, first, [key], "left", spread=spread)
    return joined.withColumn(
        "accepted", F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False))
    ).drop("_first")


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-03: rows whose key is not in ``seen``."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def unseen_in_history(df: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-03 for a batch (already written down) against a much larger history.

    The history is first cut to the batch's keys. A batch small enough is broadcast
    by its known file size, and then the history is scanned but never shuffled.
    """
    keys = list(keys)
    known = history.select(*keys).join(df.select(*keys), keys, "left_semi").distinct()
    return df.join(known, keys, "left_anti")


def seen_keys(history: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """SET-02: all keys known after the fresh ones were added, blanks left out."""
    some = F.coalesce(F.col(key), F.lit("")) != ""
    return history.select(key).filter(some).union(fresh.select(key).filter(some)).distinct()


# ---------------------------------------------------------------- link lines

def parse_link_line(line) -> Column:
    """FLT-16: ``struct(url, level)`` of a well-formed link line, else NULL."""
    text = F.trim(col(line))
    head = F.regexp_extract(text, r"(?s)\A(.*?)>>>", 1)
    url = F.trim(F.regexp_extract(head, r"(?s)\A(.*)--", 1))
    level = F.trim(F.regexp_extract(head, r"(?s)\A.*--(.*)\z", 1)).try_cast("bigint")
    return F.when((url != "") & level.isNotNull(), F.struct(url.alias("url"), level.alias("level")))


def link_key(line, level_regex: dict[int, str]) -> Column:
    """AGG-05 key: ``id:<link id>``, or ``url:<url>`` where the level's rule finds none."""
    parsed = parse_link_line(line)
    link_id = F.trim(link_id_by_level(parsed["url"], parsed["level"], level_regex))
    key = F.when(link_id != "", F.concat(F.lit("id:"), link_id)).otherwise(F.concat(F.lit("url:"), parsed["url"]))
    return F.when(parsed.isNotNull(), key)


def new_links(lines: DataFrame, history: DataFrame, level_regex: dict[int, str], *, order: str = "pos") -> DataFrame:
    """AGG-05: link lines not yet in ``history``, first of each key; malformed lines drop out."""
    keyed = lines.withColumn("link_key", link_key("line", level_regex)).filter(F.col("link_key").isNotNull())
    known = history.select(link_key("line", level_regex).alias("link_key")).filter(F.col("link_key").isNotNull())
    return unseen_in_history(written(keep_first(keyed, ["link_key"], [order]), "links"), known, ["link_key"])


# ---------------------------------------------------------------- lookups and tiers

def with_bucket(df: DataFrame, *, prefix: str = "CONTENT", length: int = 2, doc_id: str = "_id") -> DataFrame:
    return df.withColumn("bucket", store_bucket(doc_id, prefix, length))


def in_buckets(batch: DataFrame) -> Column:
    """The condition that a stored row lies in a bucket of the batch: a partition filter with literal names.

    Buckets are the last characters of a digest, so there are at most 16 to the power of their length.
    """
    names = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
    return F.col("bucket").isin(*names) if names else F.lit(False)


def get_documents(store: DataFrame, ids: DataFrame, *, prefix: str = "CONTENT", length: int = 2) -> DataFrame:
    """JN-04: stored documents of the listed ids. Only the buckets of these ids are read."""
    wanted = written(with_bucket(ids.select("_id").distinct(), prefix=prefix, length=length), "wanted")
    return store.filter(in_buckets(wanted)).join(wanted, ["bucket", "_id"], "left_semi")


def get_cached(requests: DataFrame, cache: DataFrame, *, now: int, order: str = "pos") -> DataFrame:
    """JN-05: one row per request with the cached value, NULL where it is missing or expired."""
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("_id", "value")
    return lookup_join(requests, live, ["_id"], "left", spread=[order])


def tiers(batch: DataFrame, cache: DataFrame, store: DataFrame, *, now: int, order: Sequence[str]) -> DataFrame:
    """JN-06: first row of each ``_id`` with the tier that knows it: ``cache``, ``store`` or ``new``.

    ``new`` rows are to be inserted, ``store`` rows to be put back into the cache.
    The batch collapses and is written down; the cache is cut to the batch's ids before it is shuffled, and the
    store, by bucket where it has one, to the ids that the cache lacks.
    """
    first = written(keep_first(batch, ["_id"], order), "first")
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    cached = written(live.select("_id").join(first.select("_id"), "_id", "left_semi").distinct(), "cached")
    asked = written(first.select("_id").join(cached, "_id", "left_anti"), "asked")
    if "bucket" in store.columns:
        stored = get_documents(store, asked).select("_id")
    else:
        stored = store.select("_id").join(asked, "_id", "left_semi")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    joined = first.join(flag(cached, "_cached"), "_id", "left").join(flag(stored, "_stored"), "_id", "left")
    tier = F.when(F.col("_cached"), "cache").when(F.col("_stored"), "store").otherwise("new")
    return joined.withColumn("tier", tier).drop("_cached", "_stored")


def refill_cache(cache: DataFrame, tiered: DataFrame, *, now: int, ttl: int) -> DataFrame:
    """The cache after a batch: live rows, plus the batch's store and new ids with a fresh clock."""
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    fresh = tiered.filter(F.col("tier") != "cache").select(
        "_id", F.lit("1").alias("value"), F.lit(now + ttl).cast("bigint").alias("expires_at")
    )
    return live.select("_id", "value", "expires_at").unionByName(fresh)


def requested(keys: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JN-09 / SET-04: requested keys that exist, and those that do not."""
    have = known.select(key).distinct()
    return keys.join(have, key, "left_semi"), keys.join(have, key, "left_anti")


def merge_details(listed: DataFrame, details: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """JN-10: list-page and detail-page fields of one entity; a non-blank detail value wins."""
    a, b = listed.select(key, *fields), details.select(key, *fields)
    return a.alias("l").join(b.alias("d"), key, "full_outer").select(
        key,
        *[F.coalesce(F.nullif(F.col(f"d.{f}"), F.lit("")), F.col(f"l.{f}"), F.lit("")).alias(f) for f in fields],
    )
