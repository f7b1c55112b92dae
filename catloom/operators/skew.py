"""Joins and per-group picks that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    *,
    spread: Sequence[str] | None = None,
    salts: int = 32,
    hot: list[int] | None = None,
) -> DataFrame:
    """Equi-join against a side that is unique on ``keys``.

    Adaptive execution splits the partitions of hot left keys and may broadcast a small right side, so no
    more is needed as a rule. For keys that are known to be hot, ``hot`` gives their ``xxhash64`` values: their rows go
    to ``salts`` places by the hash of their ``spread`` columns (all columns by default; name a row id if rows may
    repeat), and the one matching right row is copied to each.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot do {how!r}")
    keys = list(keys)
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(*hot)
    place = F.pmod(F.xxhash64(*(spread or left.columns), F.lit(17)), F.lit(salts)).cast("int")
    salted_left = left.withColumn("_salt", F.when(is_hot, place).otherwise(0))
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(places))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    *,
    spread: Sequence[str],
    salts: int | None = None,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows of each group in a total order.

    Every group is first cut to ``n`` rows in each of ``salts`` parts (as many as there are shuffle partitions, if
    not given), so the final window sees at most ``salts * n`` rows of a group however large it is.
    """
    parts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*spread), F.lit(parts))
    in_part = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    cut = (
        df.withColumn("_part", part)
        .withColumn("_rn", in_part)
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("_rn") <= n)
        .drop("_part")
    )
    return cut.withColumnRenamed("_rn", rank) if rank else cut.drop("_rn")
