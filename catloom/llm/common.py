"""Registry of this package's queries, and helpers for text columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_with_tasks

ship_with_tasks(__name__)

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes in DuckDB: a byte joins the remainder, then eight shifts by one bit."""
    code = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(length({code}) // 2), lambda b: [cast('0x' || substr({code}, 2 * b + 1, 2) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    shift = "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), {shift}), 4294967295)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts back to back, and their borders. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, borders, data = column.buffers()
    ends = np.frombuffer(borders, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def row_blocks(borders: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each; a longer row stands alone."""
    first, n = 0, len(borders) - 1
    while first < n:
        last = int(np.searchsorted(borders, borders[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def with_columns(batch: pa.RecordBatch, keep: list[str], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch, and new ones behind them."""
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + list(extra.values()), names=keep + list(extra))


_random = np.random.default_rng(20240901)
# One odd number per byte; capitals A-Z have those of their small letters.
BYTE_CODES = _random.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
BYTE_CODES_LOWER = BYTE_CODES.copy()
BYTE_CODES_LOWER[65:91] = BYTE_CODES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64)]

# Bytes of words: all but ASCII white space; letters, digits and all that is not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd base modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        _powers[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE))])
    return _powers[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, borders: np.ndarray, kind: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie back to back: first byte, end, row and 64-bit hash of each.

    ``kind`` marks the bytes that words are made of. Words end at the borders of texts.
    """
    inside = kind[data]
    at_start = inside.copy()
    at_start[1:] &= ~inside[:-1]
    firsts = borders[:-1][borders[:-1] < borders[1:]]
    at_start[firsts] = inside[firsts]
    starts = np.flatnonzero(at_start)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at_end = inside.copy()
    at_end[:-1] &= ~inside[1:]
    lasts = firsts[1:] - 1
    at_end[lasts] = inside[lasts]
    ends = np.flatnonzero(at_end) + 1
    lengths = ends - starts
    chars = np.flatnonzero(inside)
    place = chars - np.repeat(starts, lengths)
    coded = codes[data[chars]] * powers(int(lengths.max()))[place]
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    row = np.searchsorted(borders, starts, side="right") - 1
    return starts, ends, row, mixed(np.add.reduceat(coded, heads) + lengths.astype(np.uint64))
