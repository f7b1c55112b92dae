from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catloom.operators import dedup
from catloom.operators.store import new_store
from catloom.session import scratch
from catloom.sources import readers, writers
from catloom.streaming import batches, state

DOC = T.StructType([T.StructField("_id", T.StringType()), T.StructField("v", T.LongType())])


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def content(store):
    return {r["_id"]: r.v for r in store.read().collect()}


def test_store(spark):
    store = new_store(spark, DOC, length=1)
    assert content(store) == {}
    assert {r["_id"] for r in store.insert_new(docs(spark, [("a1", 1), ("b1", 2), ("a1", 3), ("", 4), (None, 5)]), ["v"]).collect()} == {"a1", "b1"}
    assert {r["_id"] for r in store.insert_new(docs(spark, [("a1", 9), ("c2", 6)]), ["v"]).collect()} == {"c2"}
    assert content(store) == {"a1": 1, "b1": 2, "c2": 6}
    store.update_one(F.col("v") > 1, {"v": F.lit(20)})
    assert content(store) == {"a1": 1, "b1": 20, "c2": 6}
    store.delete_one(F.col("_id") == "c2")  # the last document of its bucket
    assert content(store) == {"a1": 1, "b1": 20}
    store.delete_one(F.col("_id") == "gone")
    store.upsert(docs(spark, [("a1", 7), ("c2", 8), ("d4", 9)]), ["v"])
    assert content(store) == {"a1": 7, "b1": 20, "c2": 8, "d4": 9}
    assert store.find_one(F.col("_id") == "d4").first().v == 9


def test_missing_sources(spark):
    gone = scratch(spark, "gone")
    assert readers.read_lines(spark, gone).count() == 0 and readers.read_string(spark, gone).count() == 0
    assert readers.read_csv(spark, gone, ["a"]).count() == 0 and readers.read_json_lines(spark, gone, DOC).count() == 0
    assert readers.read_or_empty(spark, gone, DOC).columns == ["_id", "v"]
    broken = scratch(spark, "broken")
    docs(spark, []).limit(0).write.json(broken)
    spark.range(1).select(F.lit("no parquet").alias("v")).write.mode("overwrite").text(broken)
    with pytest.raises(Exception):
        readers.read_or_empty(spark, broken, DOC).collect()
    assert readers.read_history(spark, broken, DOC).count() == 0
    assert writers.snapshot_path(spark, gone, scratch(spark, "s"), at=datetime(2024, 1, 1)) == ""
    with pytest.raises(ValueError):
        writers.write_as(docs(spark, []), "excel", gone)


def test_files(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿level_0,level_1\n a ,\n\"x,y\",  \n".encode())
    got = readers.read_level_csv(spark, str(tmp_path / "bom.csv"), ["level_0", "level_1"])
    assert [tuple(r) for r in got.collect()] == [("a", "00"), ("x,y", "")]
    (tmp_path / "gbk.txt").write_bytes("中文\r\n\r\n b ".encode("gbk"))
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "gbk.txt")).collect()] == ["中文", "", " b "]
    assert readers.read_string(spark, str(tmp_path / "gbk.txt")).first().value == "中文\r\n\r\n b "
    (tmp_path / "rows.jsonl").write_text('{"_id":"a","v":1}\n\n{"_id":\n{"_id":"b","v":2}\n')
    assert sorted(r["_id"] for r in readers.read_json_lines(spark, str(tmp_path / "rows.jsonl"), DOC).collect()) == ["a", "b"]
    (tmp_path / "links.txt").write_text("  one \n\n\ttwo\nthree\n")
    assert [tuple(r) for r in readers.read_numbered_lines(spark, str(tmp_path / "links.txt")).orderBy("pos").collect()] == [
        ("one", 0), ("two", 1), ("three", 2),
    ]


def test_batch_size():
    assert batches.check_batch_size(-1) == -1 and batches.check_batch_size(5) == 5
    for bad in (0, -2):
        with pytest.raises(ValueError):
            batches.check_batch_size(bad)


def drain(spark, stream, name, checkpoint=None):
    target = scratch(spark, name)
    run = batches.run(stream, lambda b, _: b.write.mode("append").parquet(target), checkpoint or scratch(spark, "cp"))
    run.awaitTermination(120)
    return spark.read.parquet(target).collect()


def test_seen_set_over_restarts(spark):
    folder, target, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "cp")
    for rows in ([("a", 1), ("a", 2), ("b", 3)], [("a", 4), ("c", 5)]):
        docs(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = state.first_seen(batches.file_stream(spark, folder, DOC), ["_id"])
        batches.run(stream, lambda b, _: b.write.mode("append").parquet(target), checkpoint).awaitTermination(120)
    got = spark.read.parquet(target).collect()
    assert len(got) == 5 and sorted(r["_id"] for r in got if r.is_new) == ["a", "b", "c"]


def test_seen_set_forgets(spark):
    import time

    folder, target, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "cp")
    for v in (1, 2):
        docs(spark, [("a", v)]).coalesce(1).write.mode("append").parquet(folder)
        stream = state.first_seen(batches.file_stream(spark, folder, DOC), ["_id"], ttl_seconds=1)
        batches.run(stream, lambda b, _: b.write.mode("append").parquet(target), checkpoint).awaitTermination(120)
        time.sleep(2)
    assert [r.is_new for r in spark.read.parquet(target).collect()] == [True, True]


def test_seen_set_is_called_by_bucket(spark, monkeypatch, tmp_path):
    """A Python call for each key cost more than the keys' rows (str_03_page_gate)."""
    handle, log = state.SeenSet.handleInputRows, str(tmp_path / "calls")

    def counted(self, key, rows, timer_values):
        with open(log, "a") as f:
            f.write("x")
        yield from handle(self, key, rows, timer_values)

    monkeypatch.setattr(state.SeenSet, "handleInputRows", counted)
    monkeypatch.setattr(state, "BUCKETS", 16, raising=False)
    monkeypatch.setattr(state, "REMEMBERED", 7, raising=False)
    folder, target, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "cp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # several chunks for a bucket
    try:
        for start in (0, 500):  # half of the keys come again
            spark.range(start, start + 1000).selectExpr("concat('k', id) as _id", "id as v").unionAll(
                spark.range(start, start + 1000).selectExpr("concat('k', id) as _id", "-id as v")
            ).coalesce(1).write.mode("append").parquet(folder)
            stream = state.first_seen(batches.file_stream(spark, folder, DOC), ["_id"])
            batches.run(stream, lambda b, _: b.write.mode("append").parquet(target), checkpoint).awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.parquet(target)
    assert got.count() == 4000 and got.filter("is_new").count() == got.filter("is_new").select("_id").distinct().count() == 1500
    with open(log) as f:
        assert len(f.read()) <= 2 * 16


def test_keys_of_the_seen_set(spark):
    """Codes tell keys apart where ``groupBy`` does, and nowhere else."""
    rows = spark.sql("""
        select * from values
            ('a', 'bc', 9007199254740993L, 0.0D, timestamp_micros(1), x'00', struct('x', '')),
            ('ab', 'c', 9007199254740993L, 0.0D, timestamp_micros(1), x'00', struct('x', '')),
            ('ab', 'c', 9007199254740992L, 0.0D, timestamp_micros(1), x'00', struct('x', '')),
            ('ab', 'c', 9007199254740992L, -0.0D, timestamp_micros(1), x'00', struct('x', '')),
            ('ab', 'c', 9007199254740992L, double('nan'), timestamp_micros(2), x'0000', struct('', 'x')),
            ('ab', 'c', 9007199254740992L, double('nan'), timestamp_micros(1), x'00', struct('', 'x')),
            ('ab', 'c', null, 0.0D, null, null, null),
            ('ab', null, null, null, null, null, struct(null, null)),
            ('', null, null, null, null, null, null),
            (null, '', null, null, null, null, null),
            (null, null, null, null, null, null, null),
            (null, null, null, null, null, null, null)
        as t(a, b, n, d, t, x, s)""")
    for keys in (["a", "b"], ["n"], ["d"], ["t"], ["x"], ["s"], ["s", "a"], rows.columns):
        assert rows.select(state.key_code(rows, keys)).distinct().count() == rows.select(*keys).distinct().count(), keys
    folder, keys = scratch(spark, "in"), ["n", "a"]
    rows.select(*keys).coalesce(1).write.parquet(folder)
    got = drain(spark, state.first_seen(batches.file_stream(spark, folder, rows.select(*keys).schema), keys), "out")
    assert len(got) == 12 and sum(r.is_new for r in got) == rows.select(*keys).distinct().count()
    with pytest.raises(ValueError, match="array"):
        state.first_seen(rows.withColumn("l", F.array("a")), ["l"])


def test_store_feed_twice(spark):
    folder = scratch(spark, "in")
    docs(spark, [("a", 1), ("b", 2), ("a", 3)]).write.parquet(folder)
    store = new_store(spark, DOC, length=1)
    for _ in range(2):
        batches.store_feed(batches.file_stream(spark, folder, DOC), store, ["v"], scratch(spark, "cp")).awaitTermination(120)
    assert content(store) == {"a": 1, "b": 2}


def test_gate_forgets_and_repeats(spark):
    folder, target, log = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "log")
    checkpoint = scratch(spark, "cp")
    for rows in ([("a", 1), ("a", 2), ("b", 3)], [("a", 4)], [("a", 5), ("b", 6)]):
        docs(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = batches.file_stream(spark, folder, DOC)
        # Batch n counts at second 10 n; "a" is seen every time, "b" expires before it comes again.
        batches.gate_feed(stream, target, log, ["_id"], ["v"], checkpoint, clock=lambda n: 10 * n, ttl_seconds=15).awaitTermination(120)
    assert sorted((r["_id"], r.v, r.batch) for r in spark.read.parquet(target).collect()) == [("a", 1, 0), ("b", 3, 0), ("b", 6, 2)]


def test_fan_out_repeats(spark):
    """A batch that runs again, here with a fresh checkpoint, replaces what it wrote to every sink."""
    folder, root = scratch(spark, "in"), scratch(spark, "fan")
    docs(spark, [("a", 1), ("b", 2)]).write.parquet(folder)
    paths = {f: f"{root}/{f}" for f in ("jsonl", "parquet")}
    for _ in range(2):
        batches.fan_out(batches.file_stream(spark, folder, DOC), paths, scratch(spark, "cp")).awaitTermination(120)
    assert spark.read.schema(DOC).json(paths["jsonl"]).count() == spark.read.parquet(paths["parquet"]).count() == 2


def test_batches_read_their_buckets_only(spark):
    store = new_store(spark, DOC, length=1)
    store.insert(docs(spark, [(c * 4, i) for i, c in enumerate("0123456789abcdef")]))
    asked = docs(spark, [("aaaa", 0), ("b000", 0)])
    found = dedup.get_documents(store.read(), asked, length=1)
    assert [r["_id"] for r in found.collect()] == ["aaaa"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "CONTENT-A" in plan


# The log of the store


def names(store):
    return [(r["level"], r["changes"]) for r in store.manifest.read()[1]["runs"]]


def rows_written(spark, store, run):
    return spark.read.parquet(f"{store.path}/data/run={run['name']}").count()


def test_a_change_writes_its_own_rows(spark):
    store = new_store(spark, DOC, length=1)
    store.insert(docs(spark, [(f"{i:x}", i) for i in range(200)]))
    store.update_one(F.col("_id") == "a", {"v": F.lit(-1)})
    store.delete_one(F.col("_id") == "b")
    store.upsert(docs(spark, [("c", -2), ("new", -3), (None, 9), ("", 9)]), ["v"])
    store.delete(docs(spark, [("d", 0), ("gone", 0), (None, 0)]))
    assert [rows_written(spark, store, r) for r in store.manifest.read()[1]["runs"]] == [200, 1, 1, 2, 2]
    want = {f"{i:x}": i for i in range(200)} | {"a": -1, "c": -2, "new": -3}
    del want["b"], want["d"]
    assert content(store) == want
    store.insert_new(docs(spark, [("b", 5), ("a", 5)]), ["v"])
    assert content(store) == want | {"b": 5}
    store.compact()
    assert names(store) == [(0, False)] and content(store) == want | {"b": 5}
    assert rows_written(spark, store, store.manifest.read()[1]["runs"][0]) == len(want) + 1


def test_store_against_a_dictionary(spark):
    """Any order of changes, merged as they come, leaves what a dictionary holds."""
    import random

    rng, want = random.Random(7), {}
    store = new_store(spark, DOC, length=1, fan=2)
    for step in range(14):
        ids = rng.sample("abcdefghij", 3)
        kind = rng.choice(["insert_new", "upsert", "delete", "update_one"])
        if kind == "insert_new":
            store.insert_new(docs(spark, [(i, step) for i in ids]), ["v"])
            want = {i: step for i in ids} | want
        elif kind == "upsert":
            store.upsert(docs(spark, [(i, step) for i in ids]), ["v"])
            want |= {i: step for i in ids}
        elif kind == "delete":
            store.delete(docs(spark, [(i, 0) for i in ids]))
            want = {k: v for k, v in want.items() if k not in ids}
        else:
            store.update_one(F.col("_id").isin(ids), {"v": F.lit(-step)})
            want |= {min(set(ids) & set(want)): -step} if set(ids) & set(want) else {}
        assert content(store) == want, (step, kind)
    levels = [level for level, _ in names(store)]
    assert levels == sorted(levels, reverse=True) and len(levels) <= 5


def test_a_lost_writer_changes_nothing(spark, monkeypatch):
    store = new_store(spark, DOC, length=1, fan=2)
    store.insert(docs(spark, [("a", 1), ("b", 2)]))
    before = store.read()

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.manifest, "commit", lost)
        for change in (
            lambda: store.upsert(docs(spark, [("a", 9)]), ["v"]), lambda: store.delete_one(F.col("_id") == "a"), lambda: store.insert(docs(spark, [("c", 3)]))
        ):
            with pytest.raises(RuntimeError):
                change()
    assert content(store) == {"a": 1, "b": 2}
    # Lost while merging: the change before it is committed, the runs stay as they were and are merged next time.
    with monkeypatch.context() as m:
        m.setattr(store, "_merge", lost)
        with pytest.raises(RuntimeError):
            store.upsert(docs(spark, [("a", 9)]), ["v"])
    assert content(store) == {"a": 9, "b": 2} and len(names(store)) == 2
    store.insert(docs(spark, [("c", 3)]))
    assert content(store) == {"a": 9, "b": 2, "c": 3} and names(store) == [(1, False)]
    # A frame from before the changes still reads the runs it was made from.
    assert {r["_id"]: r.v for r in before.collect()} == {"a": 1, "b": 2}


def test_two_writers(spark, monkeypatch):
    one = new_store(spark, DOC, length=1)
    two = type(one)(spark, one.path, DOC, length=1)
    one.insert(docs(spark, [("a", 1)]))
    write = one._write

    def late(rows):
        name = write(rows)
        monkeypatch.setattr(one, "_write", write)
        two.insert_new(docs(spark, [("b", 7), ("c", 7)]), ["v"])
        return name

    monkeypatch.setattr(one, "_write", late)
    fresh = one.insert_new(docs(spark, [("b", 2), ("d", 3)]), ["v"])
    assert {r["_id"] for r in fresh.collect()} == {"d"}
    assert content(one) == content(two) == {"a": 1, "b": 7, "c": 7, "d": 3}


def test_manifest(spark):
    from catloom.manifest import Conflict, Manifest

    folder = scratch(spark, "manifest")
    m = Manifest(spark, folder, keep=3)
    assert m.read() == (0, {})
    m.commit(1, {"a": "é"})
    with pytest.raises(Conflict):
        Manifest(spark, folder).commit(1, {"a": 2})
    assert m.read() == (1, {"a": "é"})
    for _ in range(5):
        m.change(lambda c: {"n": c.get("n", 0) + 1})
    assert m.read() == (6, {"n": 5}) and m.versions() == [4, 5, 6]


def test_leases_are_disjoint(spark):
    from concurrent.futures import ThreadPoolExecutor

    from catloom.operators.sequence import IdLeases, lease_ids

    folder = scratch(spark, "ids")
    with ThreadPoolExecutor(4) as pool:
        blocks = list(pool.map(lambda k: IdLeases(spark, folder, first=5).lease(k), [3, 0, 10, 1] * 6))
    assert [b - a + 1 for a, b in blocks] == [3, 0, 10, 1] * 6
    ids = sorted(i for a, b in blocks for i in range(a, b + 1))
    assert ids == list(range(5, 5 + 14 * 6))
    rows, first, last = lease_ids(docs(spark, [("x", 2), ("y", 1)]), IdLeases(spark, folder), ["v"])
    assert (first, last) == (89, 90) and {r["_id"]: r.iid for r in rows.collect()} == {"y": 89, "x": 90}
    assert lease_ids(docs(spark, []), IdLeases(spark, folder), ["v"])[1:] == (91, 90)
    with pytest.raises(ValueError):
        IdLeases(spark, folder).lease(-1)
