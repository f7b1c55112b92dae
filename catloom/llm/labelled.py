"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import ship_with_tasks
from .common import held_out

ship_with_tasks(__name__)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, text: str = "text", key: str = "doc_id", rows: int, text_bytes: int
) -> tuple[list[Row], float]:
    """Up to ``rows`` labelled texts of at most ``text_bytes`` bytes together, half of each class where there
    are enough, as rows ``(text, label)``; and the share of label 1 among all rows that may be learnt from.

    Rows that are held out, and rows without a text, key or label of 0 or 1, are never taken; a key labelled
    both ways counts as 1. The sample goes by a hash of the key, so reruns agree and every part of the table can be in it.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(key).agg(F.max(label).cast("int").alias("label"))
        .withColumn("_hash", F.xxhash64(F.col(key), F.lit(label)))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    few = min(counts.get(0, 0), counts.get(1, 0), rows // 2)
    take = {0: rows - few, 1: few} if counts.get(1, 0) == few else {0: few, 1: rows - few}
    if few == rows // 2:
        take = {0: few, 1: few}
    # Twice the rows of each class, so that others stand in for texts that are missing or too long. The bound on what is broadcast.
    pool = [known.filter(F.col("label") == k).orderBy("_hash", key).limit(2 * n) for k, n in take.items()]
    own = docs.select(F.col(key), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    texts = own.join(F.broadcast(pool[0].unionByName(pool[1])), key).withColumn("_text", F.xxhash64("text"))
    # Keys may repeat among the documents, so the bounds are drawn again; equal copies count once.
    sizes = texts.select("label", "_hash", "_text", F.octet_length("text").alias("size")).distinct()
    found = {k: sizes.filter(F.col("label") == k).orderBy("_hash", "_text").limit(2 * n).collect() for k, n in take.items()}
    picked, left = [], text_bytes
    # The smaller class first: it may take half of the bytes, the other what is left.
    for k in sorted(take, key=lambda k: take[k]):
        best = fitting([r["size"] for r in found[k]], take[k], left if picked or not take[1 - k] else text_bytes // 2)
        picked += [(found[k][i]["_hash"], found[k][i]["_text"]) for i in best]
        left -= sum(found[k][i]["size"] for i in best)
    if not picked:
        return [], share
    names = docs.sparkSession.createDataFrame(picked, "_hash bigint, _text bigint")
    rest = texts.join(F.broadcast(names), ["_hash", "_text"]).groupBy("_hash", "_text").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    return rest.orderBy("_hash", "_text").select("text", "label").collect(), share


def fitting(sizes: list[int], rows: int, limit: int) -> list[int]:
    """Places of up to ``rows`` sizes whose sum is at most ``limit``: the first ones if they fit, else those up to
    four times an even part before longer ones. One that doesn't fit is left out, and the next stands in."""
    order = list(range(len(sizes)))
    if sum(sizes[:rows]) > limit:
        order.sort(key=lambda i: sizes[i] * rows > 4 * limit)
    taken = []
    for i in order:
        if len(taken) < rows and sizes[i] <= limit:
            taken.append(i)
            limit -= sizes[i]
    return taken
