"""Best-fit-decreasing packing of indivisible groups into shards of nearly equal size."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import dense_position
from ..session import ship_with_tasks, written
from .common import query, table

ship_with_tasks(__name__)

SHARDS = 16
# Groups are first packed into bricks of this part of a shard, so the driver packs a few thousand bricks however many groups there are.
BRICKS = 256
_LEAF = 64


class Capacities:
    """Open bins by what is left in them: a two-level B+ tree of ``(left, bin)``.

    All leaves are equally deep; a full leaf is split in two, an empty one removed.
    """

    def __init__(self) -> None:
        self._leaves: list[list[tuple[int, int]]] = []
        self._last: list[tuple[int, int]] = []  # greatest entry of each leaf

    def add(self, left: int, bin_: int) -> None:
        entry = (left, bin_)
        if not self._leaves:
            self._leaves, self._last = [[entry]], [entry]
            return
        i = min(bisect_left(self._last, entry), len(self._leaves) - 1)
        leaf = self._leaves[i]
        leaf.insert(bisect_left(leaf, entry), entry)
        if len(leaf) > _LEAF:
            half = len(leaf) // 2
            self._leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self._last[i : i + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self._last[i] = leaf[-1]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the entry with the least room that holds ``size``."""
        i = bisect_left(self._last, (size, -1))
        if i == len(self._leaves):
            return None
        leaf = self._leaves[i]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self._last[i] = leaf[-1]
        else:
            del self._leaves[i], self._last[i]
        return entry


def best_fit(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each item; items come largest first. Without ``bins`` a new one is opened whenever none has room.

    With ``bins`` an item for which no bin has room makes the answer empty.
    """
    tree, out, opened = Capacities(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if bins is not None and (opened == bins or size > capacity):
                return []
            found, opened = (max(capacity, size), opened), opened + 1
        out.append(found[1])
        tree.add(found[0] - size, found[1])
    return out


def pack(sizes: list[int], bins: int) -> list[int]:
    """Best fit decreasing into ``bins`` bins of the least capacity for which it succeeds; sizes come largest first.

    What is larger than its even part of the rest fills a bin alone.
    """
    if not sizes:
        return []
    total = sum(sizes)
    if bins > 1 and sizes[0] * bins > total + bins:
        return [0, *(1 + b for b in pack(sizes[1:], bins - 1))]
    low, high = max(sizes[0], -(-total // bins)), total
    best = best_fit(sizes, high, bins)
    while low < high:
        mid = (low + high) // 2
        if tried := best_fit(sizes, mid, bins):
            best, high = tried, mid
        else:
            low = mid + 1
    return best


def _bricks(capacity: int):
    def fill(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["bytes", "unit"], ascending=[False, True], ignore_index=True)
        return cell.assign(brick=best_fit(cell["bytes"].tolist(), capacity))

    return fill


def assign_shards(docs: DataFrame, *, shards: int = SHARDS, key: str = "doc_id", text: str = "text", group: str | None = None, bricks: int = BRICKS, cell_rows: int = 20_000, most_bricks: int | None = None) -> DataFrame:
    """``docs`` as rows ``(row, size, shard, slot)``, ``row`` holding all columns of ``docs``.

    The size of a document is the bytes of its text plus 1; a null text has none. Documents with equal texts (or equal
    values of the column ``group``) are indivisible; null texts are equal to each other. Groups are dealt
    out by hash into cells of about ``cell_rows`` groups. Each cell packs its groups best fit decreasing into
    bricks of ``1 / bricks`` of a shard; groups larger than that are bricks of their own. While there are more than
    ``most_bricks`` (four times ``shards * bricks``), what the cells left open is packed again in fewer cells, so what the
    driver packs at last, best fit decreasing into ``shards`` shards of the least capacity that works, doesn't grow with the table. A group larger than a shard's even part fills a shard alone.
    Slots count the rows of a shard from 0 in the order of the key, nulls first; rows alike in all that counts may swap places.
    """
    value = F.col(group) if group else F.col(text)
    sized = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.sha2(value.cast("string"), 256), F.lit("")).alias("unit"),
    )
    return _numbered(_sharded(sized, shards, bricks, cell_rows, most_bricks))


def _sharded(sized: DataFrame, shards: int, bricks: int, cell_rows: int, most: int | None = None) -> DataFrame:
    most = most or 4 * shards * bricks
    units = written(sized.groupBy("unit").agg(F.sum("size").alias("bytes")), "units")
    total = units.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    capacity = max(1, -(-total["bytes"] // (shards * bricks)))
    cells = max(1, -(-total["n"] // cell_rows))
    small = units.filter(F.col("bytes") < capacity).withColumn("cell", F.pmod(F.xxhash64("unit"), F.lit(cells)))
    filled = small.groupBy("cell").applyInPandas(_bricks(capacity), "unit string, bytes bigint, cell bigint, brick bigint")
    large = units.filter(F.col("bytes") >= capacity).select("unit", "bytes", F.lit(-1).cast("bigint").alias("cell"), F.xxhash64("unit").alias("brick"))
    placed = written(filled.unionByName(large), "bricks")
    # At most shards * bricks bricks are full; each cell leaves some open, so their number grows with the cells.
    sums, round_ = written(placed.groupBy("cell", "brick").agg(F.sum("bytes").alias("bytes")), "sums"), 0
    while sums.count() > most:
        # The open bricks are packed like groups, in far fewer cells: at most one brick in each is less than half full.
        round_ += 1
        open_ = sums.filter(F.col("bytes") < capacity)
        fewer = max(1, -(-open_.count() // cell_rows))
        name = F.concat_ws(":", F.col("cell").cast("string"), F.col("brick").cast("string"))
        dealt = open_.select(name.alias("unit"), "bytes", (F.pmod(F.xxhash64("cell", "brick"), F.lit(fewer)) + F.lit(round_ << 40)).alias("cell"))
        packed = dealt.groupBy("cell").applyInPandas(_bricks(capacity), "unit string, bytes bigint, cell bigint, brick bigint")
        moved = written(packed.select(F.col("unit").alias("was"), F.col("cell").alias("_cell"), F.col("brick").alias("_brick")), "moved")
        joined = placed.join(moved, name == F.col("was"), "left")
        placed = written(joined.select("unit", "bytes", F.coalesce("_cell", "cell").alias("cell"), F.coalesce("_brick", "brick").alias("brick")), "bricks")
        before, sums = sums.count(), written(placed.groupBy("cell", "brick").agg(F.sum("bytes").alias("bytes")), "sums")
        if fewer == 1 or sums.count() >= before:
            break
    sums = sums.orderBy(F.desc("bytes"), "cell", "brick").collect()
    where = pack([r["bytes"] for r in sums], shards)
    spark = sized.sparkSession
    plan = spark.createDataFrame([(r["cell"], r["brick"], s) for r, s in zip(sums, where, strict=True)], "cell bigint, brick bigint, shard int")
    of_unit = placed.join(F.broadcast(plan), ["cell", "brick"]).select("unit", "shard")
    return sized.join(of_unit, "unit").drop("unit")


def _numbered(rows: DataFrame) -> DataFrame:
    """Gapless slots within each shard, from one sort by range over all rows; ties go by a hash of the row."""
    placed = dense_position(rows.withColumn("_tie", F.xxhash64("row")), ["shard", "_key", "_tie"], "_pos", start=0)
    firsts = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))
    # One row per shard.
    out = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_pos") - F.col("_first"))
    return out.select("row", "size", "shard", "slot")


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes the documents of each shard to a folder of its own, in as many files as tasks had rows of it."""
    assigned.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


@query("op1_shards")
def op1(spark, sf):
    """Every document with its shard, by the law of bytes, and its slot there."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("unit"),
    )
    narrow = docs.select(F.struct("doc_id", "text_crc32").alias("row"), F.col("doc_id").alias("_key"), "size", "unit")
    out = _numbered(_sharded(narrow, SHARDS, BRICKS, 20_000))
    return out.select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
