"""From raw documents to packed training shards: one stage after another, each written as Parquet and read again.

An empty table goes through all stages and stays empty. Texts that are null or empty are documents like others: they are scored by the
classifier's bias, are near copies of nothing, hold no benchmark words and take no words of a source. Rows without a
doc_id pass the near duplicates; of rows that repeat one, one passes. Further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catloom.llm.common import table
from catloom.llm.decontamination import decontaminate
from catloom.llm.mixing import mix
from catloom.llm.near_dedup import one_of_each
from catloom.llm.quality import QualityModel, keep_good
from catloom.llm.shards import assign_shards
from catloom.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return keep_good(docs, QualityModel.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words to a shingle, a similarity of 0.8 or more."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which ten consecutive words of a benchmark item occur."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target weight asks for."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into shards of nearly equal bytes, copies of a text together.

    Columns of the documents called ``bytes``, ``shard`` or ``slot`` give way to those of the shards.
    """
    out = assign_shards(docs)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("bytes", "shard", "slot")]
    return out.select(*own, F.col("size").alias("bytes"), "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixing", mixing),
    ("sharding", sharding),
]
# Classifier, suffix search and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
