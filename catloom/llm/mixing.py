"""Mixing sources to target weights: repetition rates per source, copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import dense_position
from ..session import written
from .common import query, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# u is taken from this many leading hex digits of an md5, so it is exact in a double.
_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """One row per source: ``(source, source_size, target)``.

    Sources take ``weights`` in turn in the order of their code points, null last, and share
    ``share`` times all sizes. A target stops at ``most`` times its source's size; what is over
    goes to the other sources by weight until none is above. Each round is one aggregate over
    the table of sources, which is written once; only its sums reach the driver.

    An empty table gives an empty result; sources of size 0 have target 0.
    """
    if share > most:
        raise ValueError("sources cannot be repeated often enough for this share")
    totals = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    # ``_none`` sorts null last and keeps it apart from the empty name.
    named = totals.withColumns({"_none": F.col(source).isNull().cast("int"), "_name": F.coalesce(source, F.lit(""))})
    placed = dense_position(named, ["_none", "_name"], "_pos", start=0)
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = written(placed.select(source, "source_size", F.get(turn, (F.col("_pos") % len(weights)).cast("int")).alias("_weight")), "sources")
    goal, level = F.col("source_size") * float(most), 0.0
    everything = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"] * share
    while True:
        over = F.col("_weight") * F.lit(level) > goal
        sums = ranked.agg(F.sum(F.when(over, goal).otherwise(0.0)).alias("capped"), F.sum(F.when(~over, F.col("_weight")).otherwise(0)).alias("w")).first()
        if not sums["w"]:
            break
        nxt = (everything - sums["capped"]) / sums["w"]
        if nxt <= level:
            break
        level = nxt
    return ranked.select(source, "source_size", F.least(F.col("_weight") * F.lit(level), goal).alias("target"))


def unit_hash(key: Column, seed: str) -> Column:
    """A number from 0 up to but not 1 that depends on the key's text and the seed only."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint") / F.lit(float(16**_DIGITS))


def mix_plan(docs: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "size", seed: str = ":mix") -> DataFrame:
    """``docs`` (with a ``size`` column) plus ``source_size``, ``target`` and ``copies``.

    A document is taken ``floor(rate)`` times and once more with the chance of the fraction,
    where ``rate`` is its source's target over its size. The chance is drawn from a hash of the
    key, so reruns agree; rows that repeat a key are drawn alike. A null key counts as ''.
    Columns of ``docs`` with the names of the three new columns are replaced.

    The table of sources has been written, so Spark knows its size: it is broadcast under Spark's
    threshold; beyond it the join shuffles, and adaptive execution splits a hot source.
    """
    docs = docs.drop("source_size", "target", "copies")
    targets = written(source_targets(docs, source=source, size=size), "targets")
    targets = targets.withColumnRenamed(source, "_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + (unit_hash(F.col(key), seed) < rate - whole).cast("bigint")
    joined = docs.join(targets, F.col(source).eqNullSafe(F.col("_of"))).drop("_of")
    return joined.withColumn("copies", copies)


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = ":mix") -> DataFrame:
    """The mix itself: every document as often as ``mix_plan`` says, columns as in ``docs``.

    A null text has no words; a null source is a source of its own, behind the others; a null key is drawn as ''. Repeated rows are
    drawn alike, each for itself. An empty table gives an empty mix. The row travels as one struct, so its columns may have any name.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"))
    plan = mix_plan(packed, key="_key", source="_source", size="_size", seed=seed)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return plan.select("_row", copies).select("_row.*")


OP4_SQL = r"""
with sized as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
totals as (select source, sum(size) as n from sized group by source),
ranked as (
    select source, n, [5, 2, 1][(row_number() over (order by source is null, encode(coalesce(source, ''))) - 1) % 3 + 1] as w from totals),
-- Sources reach their cap in the order of cap over weight.
steps as (
    select *, coalesce(sum(2 * n) over (order by 2 * n / w, source is null, source rows between unbounded preceding and 1 preceding), 0) as capped,
           sum(w) over (order by 2 * n / w, source is null, source rows between current row and unbounded following) as open_w from ranked),
level as (
    select coalesce(max((1.5 * (select sum(n) from totals) - capped) / open_w)
                    filter (where (1.5 * (select sum(n) from totals) - capped) / open_w <= 2 * n / w), 0) as l from steps),
targets as (select source, n, case when 2 * n < w * l then 2.0 * n else w * l end as target from ranked, level),
rates as (
    select doc_id, size, n, target, case when n > 0 then target / n else 0 end as rate,
           cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':mix'), 1, 13) as bigint) / 4503599627370496.0 as u
    from sized join targets on sized.source is not distinct from targets.source)
select doc_id, size, cast(n as bigint) as source_size, cast(target as double) as target,
       cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from rates"""


@query("op4_mix_sources", OP4_SQL)
def op4(spark, sf):
    """Every document with its source's target and the words that the mix takes from it."""
    docs = table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    plan = mix_plan(written(docs, "sizes"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
