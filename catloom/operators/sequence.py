"""Dense positions and id blocks without a global window (WIN-02, WIN-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..manifest import Manifest
from ..session import written

MOST_SPLITS = 100_000  # about 15 MB of paths and numbers
_LOCAL = (1 << 33) - 1  # the bits of a monotonically increasing id that count inside a partition


def _ranged(df: DataFrame, order: Sequence[str], parts: int | None) -> DataFrame:
    """Rows in ordered ranges, each with its range and its place there, in the shared folder.

    Borders come from a sample and would differ in a second run, so the ranges are
    written down before anything is derived from them.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))
    return written(ranged.withColumns({"_range": F.spark_partition_id(), "_local": local}), "ranges")


def _numbered(ranged: DataFrame, name: str, start: int) -> DataFrame:
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    # One small row per range: as many as there are shuffle partitions.
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_before") + F.col("_local") + start).cast("bigint"))
        .drop("_range", "_local", "_before")
    )


def dense_position(
    df: DataFrame, order: Sequence[str], name: str = "pos", *, start: int = 1, parts: int | None = None
) -> DataFrame:
    """Consecutive numbers from ``start`` in a total order (``order`` must be unique).

    One range shuffle sorts the rows; the sizes of the ranges give each its offset,
    and the place inside a range is known from the sort. There is no global window,
    and the numbers do not depend on where the borders fall.
    """
    return _numbered(_ranged(df, list(order), parts), name, start)


def allocate_ids(
    rows: DataFrame, store: DataFrame, order: Sequence[str], name: str = "iid", *, parts: int | None = None
) -> tuple[DataFrame, int, int]:
    """WIN-02: number new rows after the store's highest id.

    Returns the rows with their ids and the inclusive block ``[first, last]``; an
    empty batch gives ``last == first - 1``.
    """
    top = store.agg(F.coalesce(F.max(name), F.lit(0)).cast("bigint").alias("top")).first()["top"]
    ranged = _ranged(rows, list(order), parts)
    return _numbered(ranged, name, top + 1), top + 1, top + ranged.count()


class IdLeases:
    """Blocks of ids from a counter in a shared folder.

    The counter is a manifest whose next version is the lease: of two runs that ask at once one is told and asks
    again behind the other, so blocks never overlap. Nothing else is read. The ids of a run that is lost are not given
    out again.
    """

    def __init__(self, spark: SparkSession, folder: str, *, first: int = 1):
        self.counter, self.first = Manifest(spark, folder), first

    def lease(self, count: int) -> tuple[int, int]:
        """The inclusive block of the next ``count`` ids; ``last == first - 1`` for none."""
        if count < 0:
            raise ValueError("a block has no negative size")
        after = self.counter.change(lambda c: {"next": c.get("next", self.first) + count})["next"]
        return after - count, after - 1


def lease_ids(
    rows: DataFrame, leases: IdLeases, order: Sequence[str], name: str = "iid", *, parts: int | None = None
) -> tuple[DataFrame, int, int]:
    """WIN-02 against a counter: number new rows with a leased block, without a look at what is stored.

    Returns the rows with their ids and the inclusive block ``[first, last]``. ``order`` must be unique.
    """
    ranged = _ranged(rows, list(order), parts)
    first, last = leases.lease(ranged.count())
    return _numbered(ranged, name, first), first, last


def read_positions(lines: DataFrame, name: str = "pos", *, start: int = 0) -> DataFrame:
    """WIN-05: position over ``(_path, _block, _row)`` as the text readers mark it, without a shuffle or sort of the lines.

    The lines are written down where they are read, each with its split and the running id of its task, since another
    read might cut the files differently. A split is read by one task in order, so its lines have consecutive ids, whatever
    else the task reads. The lines and first ids of the splits are counted, their sums from the first split on give each
    split its offset, and a line adds the distance of its id from its split's first. The sums go through one task, with one
    row for each split of 128 MB; they are broadcast up to ``MOST_SPLITS`` splits, beyond it the join shuffles.
    """
    marked = written(lines, "lines")
    splits = marked.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = written(splits.select("_path", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before")), "splits")
    small = offsets.count() <= MOST_SPLITS
    return (
        marked.join(F.broadcast(offsets) if small else offsets, ["_path", "_block"])
        .withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first") + start).cast("bigint"))
        .drop("_path", "_block", "_row", "_first", "_before")
    )
