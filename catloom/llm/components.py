"""Connected components of a link table, with large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf, ship_with_tasks

ship_with_tasks(__name__)


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. ``a`` is the greater end."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is the smallest node that can be reached.

    Both steps aggregate per node, so a node with many links is combined before the shuffle, and each round is
    written to the shared folder, where it takes the place of the one before. Links of a node with itself and links with null ends are left out.
    """
    shelf = Shelf(links.sparkSession)
    now = shelf.put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        last, shelf = shelf, Shelf(links.sparkSession)
        now = shelf.put(_small_star(_large_star(now).distinct()).distinct(), "links")
        last.clear()
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
        if mark == before:
            break
        before = mark
    # All links now lead from a node to the root of its component.
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
