"""The driver's contract, and a cross-section of the named queries against their SQL twins."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_catalog", "scl_21_decode_numeric_refs", "scl_30_clean_caption", "scl_41_url_join", "scl_50_json_list", "prj_06_block_regions",
    "prj_09_category_triples", "prj_13_content_records", "prj_18_build_links", "flt_05_split_records", "flt_14_start_id_gate",
    "srt_01_sorted", "srt_05_nested_caps", "jn_02_prefix_links", "jn_06_three_tiers", "jn_07_containment", "agg_01_level_stats",
    "agg_05_link_distinct", "win_02_id_block", "win_04_category_index", "win_06_stop_pages", "snk_07_insert_if_absent", "src_10_link_list",
    "str_01_feed_dedup",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    frame = contract.queries()[name](spark, SF)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, cursor.fetchall())
