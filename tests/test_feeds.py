"""What feeds remember: filters before histories, expiry on a wheel, states in two levels; batches that come again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catloom.operators.store import ContentStore
from catloom.session import scratch, written
from catloom.streaming import batches, keyed
from catloom.streaming.history import KeyHistory, TimingWheel, seeded

KEY = T.StructType([T.StructField("k", T.StringType())])
ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
EVENT = T.StructType([
    T.StructField("link_index", T.LongType()), T.StructField("event", T.StringType()), T.StructField("page_url", T.StringType()),
    T.StructField("ts_sec", T.LongType()), T.StructField("event_id", T.LongType()),
])


def keys(spark, ids):
    return written(spark.createDataFrame([(i,) for i in ids], KEY), "keys")


def ids(frame):
    return sorted(r["k"] for r in frame.collect())


# Filters


def test_new_keys_open_nothing(spark):
    history = KeyHistory(spark, scratch(spark, "history"), KEY, buckets=4)
    assert history.unseen(keys(spark, ["a"])).count() == 1
    history.add(keys(spark, [f"old{i}" for i in range(3000)]))
    history.add(keys(spark, [f"more{i}" for i in range(2000)]), ("f", 0))
    fresh = keys(spark, [f"new{i}" for i in range(500)])
    assert len(history.suspects(fresh)) <= 2 and history.unseen(fresh).count() == 500
    few = keys(spark, [f"new{i}" for i in range(30)])
    assert history.suspects(few) == [] and history.unseen(few) is few
    some = keys(spark, ["old7", "old2999", "more0", "new1", "more1"])
    assert len(history.suspects(some)) <= 4 and ids(history.unseen(some)) == ["new1"]
    # Without the run of a tag, as its batch saw it.
    assert ids(history.unseen(some, ("f", 0))) == ["more0", "more1", "new1"]
    assert {b for _, b in history.suspects(keys(spark, ["old7"]))} <= {0, 1, 2, 3}


def test_filters_of_many_blocks_and_false_alarms(spark):
    """With two bits a key filters err often, and the rows stay right."""
    for bits, probes in ((2, 1), (64, 7)):
        history = KeyHistory(spark, scratch(spark, "history"), KEY, buckets=1, bits=bits, probes=probes)
        history.add(spark.range(40_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("k")))
        assert history.runs()[0]["chunks"] == -(-40_000 * bits // 32_768)
        asked = written(spark.range(39_000, 41_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("k")), "asked")
        known = history._probed(asked, history.runs()).count()
        assert known > 1100 if bits == 2 else 1000 <= known <= 1003
        assert history.unseen(asked).count() == 1000


def test_runs_of_a_history_are_merged(spark):
    history = KeyHistory(spark, scratch(spark, "history"), KEY, buckets=2, fan=2)
    for n in range(6):
        history.add(keys(spark, [f"{n}-{i}" for i in range(5)]), ("f", n))
        history.add(keys(spark, [f"{n}-{i}" for i in range(5)]), ("f", n))  # comes again
    # The last batch may come again, so it is not merged yet.
    assert sorted(r["level"] for r in history.runs()) == [0, 0, 2] and sum(r["keys"] for r in history.runs()) == 30
    assert ids(history.unseen(keys(spark, ["0-0", "3-4", "5-1", "6-0"]))) == ["6-0"]
    again = KeyHistory(spark, history.path, KEY, buckets=99)
    assert again.buckets == 2 and ids(again.unseen(keys(spark, ["1-1", "x"]))) == ["x"]


# Feeds


def feed(spark, folder, rows, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return batches.file_stream(spark, folder, schema)


def test_a_feed_that_is_lost_and_comes_again(spark, monkeypatch):
    folder, target, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "cp")
    run = lambda rows: batches.dedup_feed(feed(spark, folder, rows), target, ["k"], ["v"], checkpoint).awaitTermination(120)
    run([("a", 2), ("a", 1), ("b", 3), (None, 4), ("", 5)])
    add = KeyHistory.add
    for when in ("before", "after"):

        def lost(self, rows, tag=None, when=when):
            if when == "after":
                add(self, rows, tag)
            raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr(KeyHistory, "add", lost)
            with pytest.raises(Exception, match="lost"):
                run([("b", 1), (when, 1)])
        run([("b", 1), (when, 2)])
    got = sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect())
    assert got == [("a", 1), ("after", 1), ("b", 3), ("before", 1)]
    # A new checkpoint is a new feed: it keeps what is there and adds nothing.
    batches.dedup_feed(batches.file_stream(spark, folder, ROW), target, ["k"], ["v"], scratch(spark, "cp")).awaitTermination(120)
    assert spark.read.parquet(target).count() == 4


def test_a_history_learns_from_an_output(spark):
    target = scratch(spark, "out")
    spark.createDataFrame([("a", 1), ("b", 2)], ROW).write.parquet(target)
    history = seeded(KeyHistory(spark, scratch(spark, "history"), KEY), target, ["k"])
    assert ids(seeded(history, target, ["k"]).unseen(keys(spark, ["a", "c"]))) == ["c"] and len(history.runs()) == 1


def test_wheel(spark):
    wheel = TimingWheel(spark, scratch(spark, "wheel"), KEY, width=10)
    sizes = []
    for n in range(12):
        now = 5 * n
        alive = {r["k"]: r["expires_at"] for r in wheel.alive(now).groupBy("k").agg(F.max("expires_at").alias("expires_at")).collect()}
        # A sighting counts until 25 seconds later.
        assert alive == {f"k{m}": 5 * m + 25 for m in range(n) if 5 * m + 25 > now} | ({"x": 5 * n + 20} if n else {})
        wheel.add(keys(spark, ["x", f"k{n}"]), now, 25, ("f", n))
        wheel.add(keys(spark, ["x", f"k{n}"]), now, 25, ("f", n))
        sizes.append(len(wheel.folders()))
    # Neither folders nor rows grow with the age of the feed.
    assert max(sizes) <= 6 and wheel.alive(55).count() <= 12
    assert wheel.alive(60, ("f", 11)).filter("k = 'k11'").count() == 0


def test_seen_feed(spark, monkeypatch):
    folder, target, wheel, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "wheel"), scratch(spark, "cp")

    def run(rows):
        keyed.seen_feed(feed(spark, folder, rows), target, wheel, ["k"], ["v"], checkpoint, clock=lambda n: 10 * n, ttl_seconds=15).awaitTermination(120)

    run([("a", 2), ("a", 1), ("b", 3), (None, 4)])
    with monkeypatch.context() as m:
        m.setattr(TimingWheel, "turn", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run([("a", 5)])
    run([("b", 6), ("c", 7), ("c", 8)])  # batch 1 again with what it had, then batch 2
    got = sorted((r["v"], r["k"], r["is_new"], r["batch"]) for r in spark.read.parquet(target).collect())
    # "b" expired at second 15, before batch 2.
    assert got == [(1, "a", True, 0), (2, "a", False, 0), (3, "b", True, 0), (4, None, False, 0), (5, "a", False, 1), (6, "b", True, 2), (7, "c", True, 2), (8, "c", False, 2)]
    with pytest.raises(ValueError):
        keyed.seen_feed(batches.file_stream(spark, folder, ROW), target, wheel, ["k"], ["k"], checkpoint, clock=lambda n: n, ttl_seconds=1)


def test_a_hot_key_is_spread(spark):
    """A key with a third of the rows leaves the first level as one row for each salt, which many tasks made."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    out = keyed.two_level(rows, ["k"], F.max, F.struct("v"), spread=["v"], salts=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "salt" in plan and "Python" not in plan
    assert out.filter("k = 'hot'").first()["value"]["v"] == 29_997 and out.count() == 20_001


def brute_progress(groups, ttl):
    """State, stamp and time of the last event of each link, batch after batch; the clock is 10 a batch."""
    states, out = {}, []
    for n, events in enumerate(groups):
        now, fresh = 10 * n, {}
        for link, event, url, ts, event_id in events:
            value = (ts, event_id, "COMPLETED_END" if event == "completed" else url)
            fresh[link] = max(fresh.get(link, value), value)
        for link, value in fresh.items():
            before = states.get(link)
            before = before[0] if before and (ttl is None or before[1] + ttl > now) else None
            after = before if before and before[:2] > value[:2] else value
            out.append((link, before and before[2], after[2], after[0], after[1], n))
            states[link] = (after, now)
    return sorted(out, key=repr)


@pytest.mark.parametrize("ttl", [None, 15])
def test_progress_feed(spark, monkeypatch, ttl):
    import random

    rng = random.Random(3)
    groups = [
        [(rng.randint(0, 3) if rng.random() < 0.6 else 9, rng.choice(["page", "page", "completed"]), f"u{n}-{i}", rng.randint(0, 9), 100 * n + i) for i in range(12)]
        for n in range(5)
    ]
    folder, target, states, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "states"), scratch(spark, "cp")
    monkeypatch.setattr(keyed, "SWEEP", 2)
    for n, group in enumerate(groups):
        stream = feed(spark, folder, group, EVENT)
        start = lambda: keyed.progress_feed(stream, target, states, checkpoint, clock=lambda b: 10 * b, ttl_seconds=ttl, salts=4).awaitTermination(120)  # noqa: B023, E731
        if n == 2:  # lost with its states written; the batch comes again and sees the states before it
            upsert = ContentStore.upsert

            def lost(self, *args, upsert=upsert, **options):
                upsert(self, *args, **options)
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                m.setattr(ContentStore, "upsert", lost)
                with pytest.raises(Exception, match="lost"):
                    start()
        start()
    got = [(r["link_index"], r["state_before"], r["state_after"], r["ts_sec"], r["event_id"], r["batch"]) for r in spark.read.parquet(target).collect()]
    assert sorted(got, key=repr) == brute_progress(groups, ttl)
