"""Keyed state with expiry on Structured Streaming (STR-02 .. STR-04).

State lives in the RocksDB store of the query's checkpoint, partitioned by key or
bucket of keys; a lost executor resumes from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import COMPLETED
from ..session import ship_with_tasks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 1024  # of keys, for one Python call each; a checkpoint needs the number that it began with
REMEMBERED = 100_000  # keys of a bucket in one batch
_CODE_COLUMN, _BUCKET_COLUMN = "catloom_key_code", "catloom_key_bucket"
_CODE = T.StructType([T.StructField("code", T.StringType())])
_MARK = T.StructType([T.StructField("value", T.StringType())])
_PROGRESS = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("ts_sec", T.LongType()),
        T.StructField("event_id", T.LongType()),
    ]
)


class SeenSet(StatefulProcessor):
    """First sight of keys, a bucket of keys at a time; every sight restarts a key's clock.

    The state is a map from a key's code to a mark, each with a clock of its own. Rows of a bucket end with their key's code and the
    bucket. A chunk asks the map once for each of its keys; keys met in earlier chunks of the batch are remembered, ``REMEMBERED`` at
    most, and those beyond are asked for again.
    """

    def __init__(self, ttl_ms: int | None, columns: list[str]):
        # Names are set again on every chunk: Spark loses those with a leading underscore.
        self.ttl_ms, self.columns = ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", _CODE, _MARK, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        met: set[str] = set()
        for chunk in rows:  # one chunk at a time, however many copies a key has
            codes = chunk.iloc[:, len(self.columns)]
            first = ~codes.duplicated().to_numpy()
            is_new = first.copy()
            for at in first.nonzero()[0]:
                is_new[at] = self._is_new(codes.iat[at], met)
            yield chunk.iloc[:, : len(self.columns)].set_axis(self.columns, axis=1).assign(is_new=is_new)

    def _is_new(self, code: str, met: set[str]) -> bool:
        if code in met:
            return False
        if len(met) >= REMEMBERED:
            met.clear()
        met.add(code)
        fresh = not self.seen.containsKey((code,))
        if fresh or self.ttl_ms is not None:
            self.seen.updateValue((code,), ("1",))
        return fresh

    def close(self) -> None:
        pass


class LinkProgress(StatefulProcessor):
    """none -> page URL (the clock restarts on every event) -> completed; expiry leads back to none.

    The state follows the event with the highest ``(ts_sec, event_id)``, so the order
    in which a batch delivers a link's events does not matter. One row per link
    and batch comes out: the state before and after, and the stamp of the latter.
    """

    def __init__(self, ttl_ms: int | None, key: str):
        self.ttl_ms, self.key = ttl_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", _PROGRESS, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        saved = self.state.get() if self.state.exists() else None
        best = saved
        for chunk in rows:
            last = chunk.sort_values(["ts_sec", "event_id"]).iloc[-1]
            seen = (
                COMPLETED if last["event"] == "completed" else last["page_url"],
                int(last["ts_sec"]),
                int(last["event_id"]),
            )
            if best is None or seen[1:] >= tuple(best)[1:]:
                best = seen
        if best is not None:
            self.state.update(tuple(best))
            before = saved[0] if saved is not None else None
            names = [self.key, "state_before", "state_after", "ts_sec", "event_id"]
            yield pd.DataFrame([[key[0], before, *best]], columns=names)

    def close(self) -> None:
        pass


def _with_state(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    # TTL state needs the RocksDB provider; the setting is read when the query starts.
    events.sparkSession.conf.set(PROVIDER_SETTING, ROCKSDB)
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="ProcessingTime"
    )


def _code(column: Column, kind: T.DataType) -> Column:
    """A value as a text that tells its own length."""
    if isinstance(kind, T.StructType):
        text = F.concat(F.lit(""), *[_code(column[f.name], f.dataType) for f in kind])
        text = F.when(column.isNotNull(), text)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        raise ValueError(f"no keys of type {kind.simpleString()}")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = (column + F.lit(0.0)).cast("string")  # one zero
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(column).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(column)
    else:
        text = column.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def key_code(frame: DataFrame, keys: list[str]) -> Column:
    """One text for the values of some columns, the same where ``groupBy`` has one group and nowhere else."""
    return F.concat(*[_code(frame[k], frame.select(k).schema[0].dataType) for k in keys])


def first_seen(events: DataFrame, keys: list[str], *, ttl_seconds: int | None = 604_800) -> DataFrame:
    """STR-02: flag the rows that bring a key for the first time within its TTL.

    With keys ``(sort_field, sort_order, page_url)`` this is the page gate STR-03.
    Of several copies in one batch the first to arrive is flagged. Keys with a null part are keys like others.

    Python is called by bucket of keys and reads the rows chunk by chunk, because a call for each key costs far more than the
    key's rows. The state stays one entry a key, so a batch touches the entries of its own keys only.
    """
    ttl = ttl_seconds * 1000 if ttl_seconds else None
    schema = T.StructType([*events.schema.fields, T.StructField("is_new", T.BooleanType())])
    coded = events.withColumn(_CODE_COLUMN, key_code(events, keys)).withColumn(_BUCKET_COLUMN, F.pmod(F.xxhash64(_CODE_COLUMN), F.lit(BUCKETS)).cast("int"))
    return _with_state(coded, [_BUCKET_COLUMN], SeenSet(ttl, events.columns), schema)


def link_progress(events: DataFrame, *, key: str = "link_index", ttl_seconds: int | None = 864_000) -> DataFrame:
    """STR-04: the progress state machine over a stream of page events."""
    ttl = ttl_seconds * 1000 if ttl_seconds else None
    states = [T.StructField(n, T.StringType()) for n in ("state_before", "state_after")]
    stamp = [T.StructField(n, T.LongType()) for n in ("ts_sec", "event_id")]
    schema = T.StructType([events.schema[key], *states, *stamp])
    return _with_state(events, [key], LinkProgress(ttl, key), schema)


ship_with_tasks(__name__)
