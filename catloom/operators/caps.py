"""Caps, stop rules and the sort step (WIN-06, SRT-01, SRT-02, SRT-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..specs import SortSpec
from .sequence import dense_position
from .skew import lookup_join, top_n_per_group


def nested_caps(
    pages: DataFrame,
    *,
    user: str,
    link: str,
    order: Sequence[str],
    page_no: str | None = None,
    max_page_no: int = -1,
    per_link: int = -1,
    per_user: int = -1,
) -> DataFrame:
    """SRT-05: page number limit, then a cap per link and user, then a cap per user; -1 is off."""
    by = [F.col(c) for c in order]
    if max_page_no != -1:
        pages = pages.filter(F.col(page_no) <= max_page_no)
    if per_link != -1:
        pages = top_n_per_group(pages, [user, link], by, per_link, spread=order)
    if per_user != -1:
        pages = top_n_per_group(pages, [user], by, per_user, spread=order)
    return pages


def stop_pages(items: DataFrame, *, link: str, page_no: str, fresh: str, streak: int, pages: DataFrame | None = None) -> DataFrame:
    """WIN-06: per link, the page that ends the first ``streak`` pages in a row without new items.

    ``items`` has one row per item. ``pages`` lists the pages that were read (``link``, ``page_no``); pages
    without items count as nothing new, and pages in a row are those next to each other in the list, whatever their
    numbers. Without ``pages`` the pages that have items are the list. A page's count is sent
    to the ``streak`` windows it belongs to, so no task ever holds the whole history of a link.
    """
    counts = items.groupBy(link, page_no).agg(F.sum(F.col(fresh).cast("int")).alias("_new"))
    if pages is not None:
        counts = pages.select(link, page_no).distinct().join(counts, [link, page_no], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    # Numbered over all links; a window across two links is not full for either.
    placed = dense_position(counts, [link, page_no], "_pos")
    ends = F.transform(F.sequence(F.lit(0), F.lit(streak - 1)), lambda j: F.col("_pos") + j)
    spans = placed.select(link, page_no, "_new", "_pos", F.explode(ends).alias("_end"))
    full = spans.groupBy(link, "_end").agg(
        F.sum("_new").alias("_new"), F.count("*").alias("_pages"), F.max(F.when(F.col("_pos") == F.col("_end"), F.col(page_no))).alias("_last")
    )
    return (
        full.filter((F.col("_pages") == streak) & (F.col("_new") == 0) & F.col("_last").isNotNull())
        .groupBy(link)
        .agg(F.min("_last").alias("stop_page"))
    )


def until_stop(pages: DataFrame, stops: DataFrame, *, link: str, page_no: str, spread: Sequence[str]) -> DataFrame:
    """Rows up to and including the stop page of their link."""
    joined = lookup_join(pages, stops, [link], "left", spread=spread)
    return joined.filter(F.col("stop_page").isNull() | (F.col(page_no) <= F.col("stop_page"))).drop("stop_page")


def sort_by(df: DataFrame, spec: SortSpec, *, ascending: str = "asc", default: Sequence[str] = ()) -> DataFrame:
    """SRT-01: order a frame by a validated spec; mode ``none`` leaves it alone."""
    if spec.mode in ("none", "user") or (spec.mode == "default" and not default):
        return df
    if spec.mode == "default":
        return df.orderBy(*default)
    column = F.col(spec.field)
    return df.orderBy(column.asc() if spec.order in (None, ascending) else column.desc())


def last_first(df: DataFrame, index: str) -> DataFrame:
    """SRT-02: process links from the last to the first."""
    return df.orderBy(F.col(index).desc())
