"""The pipeline's stages on empty tables, nulls and clashing names; operators on workers without this package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catloom.llm.mixing import mix
from catloom.session import written

SF = "/root/testdata/sf0.001"
CLASHES = ["_size", "_row", "_i", "_of", "_key", "source_size", "target", "copies", "bytes", "shard", "slot", "size", "unit", "score", "found", "id", "component_id", "same"]


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0 if rows == "none" else 40)
    if rows == "odd":
        odd = docs.limit(1).select(F.explode(F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" \n"), F.lit("a " * 50_000))).alias("text"))
        odd = odd.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("n_chars"))
        docs = docs.unionByName(odd).unionByName(docs.limit(5))
    docs = written(docs.withColumns({c: F.lit(77) for c in CLASHES}), "odd")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), f"odd-{name}")
        if name == "sharding":
            assert set(docs.columns) == set(before.columns)
        else:
            assert docs.columns == before.columns
            assert docs.filter(" or ".join(f"{c} <> 77" for c in CLASHES)).count() == 0
    assert (docs.count() == 0) == (rows == "none")


def test_a_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 77, 5), (2, "d", None, 78, 6)], "doc_id bigint, text string, source string, _size int, _i int")
    out = mix(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["_size"], r["_i"]) for r in out.collect()} <= {(1, 77, 5), (2, 78, 6)}


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from another folder, with the package on the driver's path only."""
    code = """
import sys
root, out = sys.argv[1:3]
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", out + "/shared").config("spark.sql.warehouse.dir", out + "/warehouse").getOrCreate())
spark.range(1).collect()
sys.path.insert(0, root)
from catloom.llm import queries
for name in sorted(queries.JOBS):
    if name != "op8_nearest":
        print(name, queries.JOBS[name](spark, "%s").count())
""" % SF
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split("\n")) >= 12
