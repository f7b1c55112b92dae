"""Queries for sources and sinks (SRC-*, SNK-*): tables written out, read back and compared."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sequence
from ..operators.store import ContentStore, apply_one, new_store, one_target
from ..session import scratch, written
from ..sources import readers, writers
from .catalog import query, table
from .extraction import level_frame
from .views import CAPTION_SQL, PATH_SQL, captions, ws_trim

# Captions as single lines of text: no line breaks, no NULL.
_FLAT_SQL = f"lines as (select id, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') as value from ({CAPTION_SQL}) c)"


def flat_lines(spark: SparkSession, sf: str) -> DataFrame:
    return captions(spark, sf).select("id", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("value"))


@query("src_01_utf8_lines", f"with {_FLAT_SQL} select value, count(*) as n from lines group by 1")
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "lines")
    writers.write_lines(flat_lines(spark, sf).select("value"), path)
    return readers.read_lines(spark, path, "utf-8").groupBy("value").agg(F.count("*").alias("n"))




@query(
    "src_01_gbk_lines",
    f"with {_FLAT_SQL} select value, count(*) as n from lines group by 1",
)
def _gbk(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts in GB18030, which extends GBK to all characters, so none is lost."""
    path = scratch(spark, "gbk")
    writers.write_lines(flat_lines(spark, sf).select("value"), path, encoding="GB18030")
    return readers.read_lines(spark, path, "GB18030").groupBy("value").agg(F.count("*").alias("n"))


@query(
    "src_02_whole_files",
    "select lang, cast(sum(length(text)) + count(*) as bigint) as chars, count(*) as lines from (select lang, regexp_replace(text, '[\\n\\r]', ' ', 'g') as text from documents) d group by 1",
)
def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language as text files; the whole text of every file comes back as one row."""
    path = scratch(spark, "whole")
    docs = table(spark, sf, "documents").select("lang", F.regexp_replace("text", r"[\n\r]", " ").alias("value"))
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 200).text(path)
    files = spark.read.text(path, wholetext=True)
    return files.groupBy("lang").agg(
        F.sum(F.length("value").cast("bigint")).alias("chars"),
        F.sum(F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).cast("bigint").alias("lines"),
    )


_PARTS = ["p_partkey", "p_name", "p_brand", "p_type"]


def _part_text(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as text with the values CSV and trimming find hard."""
    k = F.col("p_partkey") % 5
    name = (
        F.when(k == 0, "").when(k == 1, F.concat(F.lit(' "'), "p_name", F.lit('", x '))).when(k == 2, "  ")
        .when(k == 3, F.concat("p_name", F.lit("小说,\nb"))).otherwise(F.col("p_name"))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), name.alias("p_name"), "p_brand", "p_type")


_PART_SQL = "parts as (select cast(p_partkey as varchar) as p_partkey, case p_partkey % 5 when 0 then '' when 1 then ' \"' || p_name || '\", x ' when 2 then '  ' when 3 then p_name || '小说,' || chr(10) || 'b' else p_name end as p_name, p_brand, p_type from part)"


@query("src_03_csv", f"with {_PART_SQL} select * from parts")
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    writers.write_csv(_part_text(spark, sf), path, _PARTS)
    return readers.read_csv(spark, path, _PARTS)


@query("src_04_level_csv", f"with {_PART_SQL} select p_partkey, case when p_name = '' then '00' else {ws_trim('p_name')} end as p_name, p_brand, p_type from parts")
def _level_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "levels")
    writers.write_csv(_part_text(spark, sf), path, _PARTS)
    return readers.read_level_csv(spark, path, _PARTS)


_ORDER_SCHEMA = T.StructType(
    [T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())]
)


@query("src_05_json_array", "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders")
def _json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Files that each hold one JSON array of at most a thousand orders."""
    path = scratch(spark, "arrays")
    orders = table(spark, sf, "orders")
    schema = T.StructType([T.StructField("o_custkey", T.LongType()), *_ORDER_SCHEMA.fields])
    item = F.to_json(F.struct(*schema.fieldNames()))
    arrays = orders.groupBy((F.col("o_orderkey") / 1000).cast("bigint").alias("g")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_array(spark, path, schema)


@query("src_06_json_lines", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 10 > 1")
def _json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth line is blank and every tenth one cut off."""
    path = scratch(spark, "jsonl")
    whole = F.to_json(F.struct(*_ORDER_SCHEMA.fieldNames()))
    k = F.col("o_orderkey") % 10
    line = F.when(k == 0, "").when(k == 1, F.left(whole, F.lit(20))).otherwise(whole)
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return readers.read_json_lines(spark, path, _ORDER_SCHEMA)


@query("src_10_link_list", f"with {_FLAT_SQL}, kept as (select id, {ws_trim('value')} as value from lines where {ws_trim('value')} <> '') select value, row_number() over (order by id) - 1 as pos from kept")
def _link_list(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "links")
    ordered = flat_lines(spark, sf).repartitionByRange(4, "id").sortWithinPartitions("id")
    writers.write_lines(ordered.select("value"), path)
    return readers.read_numbered_lines(spark, path)


@query("win_05_file_positions", "select row_number() over (order by p_partkey) - 1 as pos, cast(p_partkey as varchar) as value from part")
def _positions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "positions")
    keys = table(spark, sf, "part").select("p_partkey").repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey")
    writers.write_lines(keys.select(F.col("p_partkey").cast("string").alias("value")), path)
    return readers.read_numbered_lines(spark, path)


@query("src_11_history", "select 'stored' as kind, count(*) as n from orders union all select 'missing', 0 union all select 'broken', 0")
def _history(spark: SparkSession, sf: str) -> DataFrame:
    good, broken = scratch(spark, "good"), scratch(spark, "broken")
    orders = table(spark, sf, "orders").select(*_ORDER_SCHEMA.fieldNames())
    orders.write.parquet(good)
    orders.select("o_orderstatus").write.text(broken)
    out = None
    for kind, path in (("stored", good), ("missing", scratch(spark, "none")), ("broken", broken)):
        frame = readers.read_history(spark, path, _ORDER_SCHEMA)
        row = frame.agg(F.count("o_orderkey").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("src_12_all_formats", "select f as format, o_orderkey, o_orderstatus, o_totalprice from orders, (values ('csv'), ('json'), ('jsonl'), ('parquet'), ('txt')) v(f)")
def _formats(spark: SparkSession, sf: str) -> DataFrame:
    return _written_everywhere(spark, sf)[0]


@query("snk_11_fan_out_differences", "select o_orderkey from orders where 1 = 0")
def _differences(spark: SparkSession, sf: str) -> DataFrame:
    return readers.differences(_written_everywhere(spark, sf)[1]).select("o_orderkey")


def _written_everywhere(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    root = scratch(spark, "formats")
    paths = {f: f"{root}/{f}" for f in ("csv", "json", "jsonl", "parquet", "txt")}
    writers.write_all(table(spark, sf, "orders").select(*_ORDER_SCHEMA.fieldNames()), paths)
    frames = readers.read_all_formats(spark, paths, _ORDER_SCHEMA)
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn("format", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out, frames


# ---------------------------------------------------------------- the document store

_DOC = T.StructType([T.StructField("_id", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())])


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.md5("text").alias("_id"), "doc_id", "lang")


def _whole_store(spark: SparkSession, sf: str) -> ContentStore:
    store = new_store(spark, _DOC, length=1)
    store.insert_new(_documents(spark, sf), ["doc_id"])
    return store


def _half_store(spark: SparkSession, sf: str) -> ContentStore:
    store = new_store(spark, _DOC, length=1)
    store.insert_new(_documents(spark, sf).filter("doc_id % 2 = 0"), ["doc_id"])
    return store


_FIRST = "select md5(text) as _id, min(doc_id) as doc_id, arg_min(lang, doc_id) as lang from documents where {} group by 1"


@query("src_13_full_scan", f"select 'CONTENT-' || upper(right(_id, 1)) as bucket, _id, doc_id, lang from ({_FIRST.format('true')}) s")
def _scan(spark: SparkSession, sf: str) -> DataFrame:
    return _whole_store(spark, sf).read().select("bucket", "_id", "doc_id", "lang")


@query("src_14_find_one", f"select _id, doc_id from ({_FIRST.format('true')}) s where doc_id = (select min(doc_id) from documents)")
def _find_one(spark: SparkSession, sf: str) -> DataFrame:
    wanted = _documents(spark, sf).agg(F.min(F.struct("doc_id", "_id")).alias("m")).first()["m"]
    store = _whole_store(spark, sf)
    bucket = f"CONTENT-{wanted['_id'][-1:].upper()}"
    return store.find_one((F.col("bucket") == bucket) & (F.col("_id") == wanted["_id"])).select("_id", "doc_id")


@query(
    "snk_01_overwrite_lines",
    f"with {_FLAT_SQL} select value, count(*) as n from lines where id % 2 = 1 group by 1",
)
def _overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "overwrite")
    lines = flat_lines(spark, sf)
    writers.write_lines(lines.filter("id % 2 = 0").select("value"), path)
    writers.write_lines(lines.filter("id % 2 = 1").select("value"), path)
    return readers.read_lines(spark, path, "utf-8").groupBy("value").agg(F.count("*").alias("n"))


@query("snk_02_append_lines", f"with {_FLAT_SQL} select value, count(*) as n from lines group by 1")
def _append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "append")
    lines = flat_lines(spark, sf)
    writers.write_lines(lines.filter("id % 2 = 0").select("value"), path)
    writers.write_lines(lines.filter("id % 2 = 1").select("value"), path, append=True)
    return readers.read_lines(spark, path, "utf-8").groupBy("value").agg(F.count("*").alias("n"))


@query(
    "snk_03_csv_levels",
    f"with {PATH_SQL} select r_name as level_0, n_name as level_1, case when c_custkey % 3 = 0 then '00' else c_mktsegment end as level_2, case when c_custkey % 3 = 2 then c_name else '00' end as level_3 from paths",
)
def _csv_levels(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csvlevels")
    levels = level_frame(spark, sf)
    writers.write_csv(levels.filter("c_custkey % 2 = 0"), path)
    writers.write_csv(levels.filter("c_custkey % 2 = 1"), path)
    return readers.read_level_csv(spark, path, writers.DEFAULT_FIELDS)


def _json_round_trip(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = scratch(spark, name)
    orders = table(spark, sf, "orders").select(*_ORDER_SCHEMA.fieldNames())
    writers.write_json(orders.filter("o_orderkey % 2 = 0"), path)
    writers.write_json(orders.filter("o_orderkey % 2 = 1"), path)
    return readers.read_json_lines(spark, path, _ORDER_SCHEMA)


_ORDERS_SQL = "select o_orderkey, o_orderstatus, o_totalprice from orders"


@query("snk_04_json_append", _ORDERS_SQL)
def _json_append(spark: SparkSession, sf: str) -> DataFrame:
    return _json_round_trip(spark, sf, "json")


@query("snk_05_jsonl_append", f"select id, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') as value from ({CAPTION_SQL}) c")
def _jsonl_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "captions")
    writers.write_json(flat_lines(spark, sf), path)
    return readers.read_json_lines(spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.StringType())]))


@query("snk_06_bulk_insert", "select 'CONTENT-' || upper(right(md5(text), 2)) as bucket, count(*) as n from documents group by 1")
def _bulk(spark: SparkSession, sf: str) -> DataFrame:
    store = new_store(spark, _DOC)
    docs = _documents(spark, sf)
    store.insert(docs.filter("doc_id % 2 = 0"))
    store.insert(docs.filter("doc_id % 2 = 1"))
    return store.read().groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "snk_07_insert_if_absent",
    f"select _id, doc_id, 'inserted' as kind from ({_FIRST.format('doc_id % 5 <> 0')}) f where _id not in (select md5(text) from documents where doc_id % 2 = 0) "
    f"union all select _id, doc_id, 'before' from ({_FIRST.format('doc_id % 2 = 0')}) b",
)
def _insert(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents are stored; then most documents come again, every fifth without an id."""
    store = _half_store(spark, sf)
    before = written(store.read().select("_id", "doc_id"), "before")
    docs = _documents(spark, sf).withColumn("_id", F.when(F.col("doc_id") % 5 != 0, F.col("_id")))
    fresh = store.insert_new(docs, ["doc_id"]).select("_id", "doc_id", F.lit("inserted").alias("kind"))
    return fresh.unionByName(before.withColumn("kind", F.lit("before")))


@query(
    "snk_08_update_delete",
    """with t as (select min(c_name) filter (c_acctbal < 0) as upd, min(c_name) filter (c_acctbal > 9000) as del from customer)
    select c_name as _id, case when c_name = upd then 'patched' else c_mktsegment end as c_mktsegment from customer, t where c_name <> del""",
)
def _update_delete(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "customer").select(F.col("c_name").alias("_id"), "c_mktsegment", "c_acctbal")
    patched = apply_one(docs, one_target(docs, F.col("c_acctbal") < 0), {"c_mktsegment": F.lit("patched")})
    return apply_one(patched, one_target(docs, F.col("c_acctbal") > 9000), None).select("_id", "c_mktsegment")


@query(
    "snk_08_store_rewrite",
    f"""with s as ({_FIRST.format('true')}), t as (select min(_id) filter (lang = 'en') as upd, min(_id) filter (lang = 'fr') as del from s)
    select _id, doc_id, case when _id = upd then 'xx' else lang end as lang from s, t where _id <> del""",
)
def _rewrite(spark: SparkSession, sf: str) -> DataFrame:
    store = _whole_store(spark, sf)
    store.update_one(F.col("lang") == "en", {"lang": F.lit("xx")})
    store.delete_one(F.col("lang") == "fr")
    return store.read().select("_id", "doc_id", "lang")


@query(
    "str_08_update_existing",
    "select md5(text) as _id, arg_min(doc_id, case when doc_id % 2 = 1 or doc_id % 3 = 0 then doc_id else 1000000000000 + doc_id end) as doc_id from documents group by 1",
)
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    store = _half_store(spark, sf)
    # Odd documents are new, every sixth replaces what is stored.
    store.upsert(_documents(spark, sf).filter("doc_id % 2 = 1 or doc_id % 3 = 0"), ["doc_id"])
    return store.read().select("_id", "doc_id")


@query("snk_09_writer_by_type", "select f as format, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders, (values ('csv'), ('jsonl'), ('parquet')) v(f) group by 1")
def _by_type(spark: SparkSession, sf: str) -> DataFrame:
    root, out = scratch(spark, "bytype"), None
    orders = table(spark, sf, "orders").select(*_ORDER_SCHEMA.fieldNames())
    for fmt in ("csv", "jsonl", "parquet"):
        writers.write_as(orders, fmt, f"{root}/{fmt}")
        back = writers.FORMATS[fmt].read(spark, f"{root}/{fmt}", _ORDER_SCHEMA)
        row = back.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("format", F.lit(fmt))
        out = row if out is None else out.unionByName(row)
    return out


@query("snk_12_snapshot", "select 'kept' as kind, count(*) as n from orders union all select 'missing', 0")
def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    root, source = scratch(spark, "snapshots"), scratch(spark, "orders")
    table(spark, sf, "orders").write.parquet(source)
    at = datetime(2024, 1, 2, 3, 4, 5)
    kept = writers.snapshot_path(spark, source, root, at=at)
    missing = writers.snapshot_path(spark, scratch(spark, "gone"), root, at=at)
    n = spark.read.parquet(kept).agg(F.count("*").alias("n")).select(F.lit("kept").alias("kind"), "n")
    return n.unionByName(spark.range(1).select(F.lit("missing").alias("kind"), F.lit(len(missing)).cast("bigint").alias("n")))


@query(
    "snk_13_customer_exports",
    "select '0:csv' as export, o_orderkey, o_orderstatus, null::double as o_totalprice from orders union all select '1:jsonl', o_orderkey, null, o_totalprice from orders union all select '1:txt', o_orderkey, null, o_totalprice from orders",
)
def _exports(spark: SparkSession, sf: str) -> DataFrame:
    fields = [["o_orderkey", "o_orderstatus"], ["o_orderkey", "o_totalprice"], []]
    done = writers.export_customers(table(spark, sf, "orders"), fields, [["CSV"], ["JSONL", "TXT"], ["CSV"]], scratch(spark, "exports"))
    out = None
    for name, path in done.items():
        customer, fmt = name.split(":")
        schema = T.StructType([f for f in _ORDER_SCHEMA if f.name in fields[int(customer)]])
        frame = writers.FORMATS[fmt].read(spark, path, schema).withColumn("export", F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


@query("agg_02_file_stats", "select count(*) as total, count(distinct p_brand || '|' || p_type) as unique, count(*) - count(distinct p_brand || '|' || p_type) as duplicates, true as has_size from part")
def _file_stats(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.stats import file_size, path_stats

    path = scratch(spark, "stats")
    writers.write_csv(_part_text(spark, sf), path, ["p_brand", "p_type"])
    rows = readers.read_level_csv(spark, path, ["p_brand", "p_type"])
    size = file_size(spark.read.text(path)).first()["file_size"]
    return path_stats(rows, ["p_brand", "p_type"]).withColumn("has_size", F.lit(size > 0))


@query("win_02_positions_any_buckets", "select l_orderkey, l_partkey, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as pos from lineitem")
def _dense(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return sequence.dense_position(table(spark, sf, "lineitem").select(*keys), keys).select("l_orderkey", "l_partkey", "pos")
