"""What a feed has seen: all its keys behind membership filters, or its last sightings on a timing wheel (STR-01 .. STR-03)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..manifest import Manifest
from ..session import path_exists, remove, written

BLOCK_BITS = 32_768  # of one bitmap of Spark's bitmap functions
Tag = tuple[str, int]  # a feed and the number of its batch


class KeyHistory:
    """The keys of an endless feed: runs of keys in hash buckets, each run with a Bloom filter for every bucket.

    A batch is first compared with the filters, about ``bits / 8`` bytes a key. Only the buckets of runs where a filter
    knows some key of the batch are opened, and there the keys are compared exactly, so a filter's mistakes, fewer than one in a thousand
    at the defaults, cost a look and never a row. A batch of new keys opens nothing.

    A filter is an aggregate: a key sets ``probes`` bits in one block of 32,768, blocks are put together by bucket, and
    a run has as many as its keys need. When a level has ``fan`` runs they are merged into one of the next. A
    manifest names the runs; a run is tagged with its feed and batch, and a batch that comes again replaces
    it. Keys with a null part are never known.
    """

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType, *, buckets: int = 64, bits: int = 20, probes: int = 7, fan: int = 8):
        self.spark, self.path, self.keys, self.fan = spark, path.rstrip("/"), keys, fan
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        version, content = self.manifest.read()
        if not version:
            content = {"runs": [], "buckets": buckets, "bits": bits, "probes": probes}
            self.manifest.commit(1, content)
        self.buckets, self.bits, self.probes = content["buckets"], content["bits"], content["probes"]

    @property
    def _names(self) -> list[str]:
        return self.keys.fieldNames()

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *self._names)

    def _bucket(self) -> Column:
        return F.pmod(self._hash(1), F.lit(self.buckets)).cast("int")

    def _chunk(self, chunks: int | Column) -> Column:
        return F.pmod(self._hash(2), F.lit(chunks) if isinstance(chunks, int) else chunks).cast("int")

    def _bits(self) -> Column:
        """The places of a key in its block, from 0: steps of an odd size, so they differ."""
        start, step = self._hash(3), self._hash(4).bitwiseOR(F.lit(1))
        return F.array(*[F.pmod(F.pmod(start, F.lit(BLOCK_BITS)) + F.pmod(step, F.lit(BLOCK_BITS)) * i, F.lit(BLOCK_BITS)).cast("int") for i in range(self.probes)])

    def runs(self, without: Tag | None = None) -> list[dict]:
        return [r for r in self.manifest.read()[1]["runs"] if without is None or r["tag"] != list(without)]

    def _write(self, keys: DataFrame, level: int, tag: Sequence | None) -> dict:
        name = uuid.uuid4().hex
        some = keys.select(*self._names).dropna().withColumn("bucket", self._bucket())
        some.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/keys/run={name}")
        stored = self.spark.read.schema(T.StructType([*self.keys.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/keys/run={name}")
        n = stored.count()
        chunks = max(1, -(-n * self.bits // (self.buckets * BLOCK_BITS)))
        places = stored.select("bucket", self._chunk(chunks).alias("chunk"), F.explode(self._bits()).alias("at"))
        places.groupBy("bucket", "chunk").agg(F.bitmap_construct_agg("at").alias("block")).write.parquet(f"{self.path}/filters/{name}")
        return {"name": name, "level": level, "tag": list(tag) if tag else None, "keys": n, "chunks": chunks}

    def add(self, keys: DataFrame, tag: Tag | None = None) -> None:
        """Adds keys that are not known, each once; a run of the same tag is replaced."""
        self._merge_full_levels(tag)
        entry = self._write(keys, 0, tag)
        self.manifest.change(lambda c: {**c, "runs": [*[r for r in c["runs"] if tag is None or r["tag"] != list(tag)], entry]})

    def _merge_full_levels(self, but: Tag | None) -> None:
        level = 0
        while len(full := [r for r in self.runs(but) if r["level"] == level]) >= self.fan:
            merged = self._write(self._keys([(r["name"], None) for r in full]), level + 1, None)
            gone = {r["name"] for r in full}
            self.manifest.change(lambda c: {**c, "runs": [*[r for r in c["runs"] if r["name"] not in gone], merged]})  # noqa: B023
            for name in gone:
                remove(self.spark, f"{self.path}/keys/run={name}")
                remove(self.spark, f"{self.path}/filters/{name}")
            level += 1

    def _keys(self, folders: list[tuple[str, int | None]]) -> DataFrame:
        """The keys in the named runs, or in single buckets of them."""
        paths = [f"{self.path}/keys/run={name}" + ("" if bucket is None else f"/bucket={bucket}") for name, bucket in folders]
        if not paths:
            return self.spark.createDataFrame([], self.keys)
        return self.spark.read.schema(self.keys).option("basePath", f"{self.path}/keys").parquet(*paths).select(*self._names)

    def _probed(self, batch: DataFrame, runs: list[dict]) -> DataFrame:
        """``(run, bucket, keys...)`` of the batch's keys that a run's filter knows."""
        filters = None
        for r in runs:
            one = self.spark.read.schema("bucket int, chunk int, block binary").parquet(f"{self.path}/filters/{r['name']}").withColumn("run", F.lit(r["name"]))
            filters = one if filters is None else filters.unionByName(one)
        per_run = F.array(*[F.struct(F.lit(r["name"]).alias("run"), self._chunk(r["chunks"]).alias("chunk")) for r in runs])
        asked = batch.select(*self._names).dropna().withColumns({"_bucket": self._bucket(), "_at": self._bits(), "_in": F.explode(per_run)})
        on = (F.col("_in.run") == F.col("run")) & (F.col("_bucket") == F.col("bucket")) & (F.col("_in.chunk") == F.col("chunk"))

        def is_set(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring("block", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        return asked.join(filters, on).filter(F.forall("_at", is_set)).select("run", "bucket", *self._names)

    def suspects(self, batch: DataFrame, without: Tag | None = None) -> list[tuple[str, int]]:
        """The buckets of runs that may hold a key of the batch: at most all buckets of the few runs."""
        runs = [r for r in self.runs(without) if r["keys"]]
        if not runs:
            return []
        return [(r["run"], r["bucket"]) for r in self._probed(batch, runs).select("run", "bucket").distinct().collect()]

    def unseen(self, batch: DataFrame, without: Tag | None = None) -> DataFrame:
        """The rows of a batch, already written down, whose key is not known, leaving out the run of a tag."""
        folders = self.suspects(batch, without)
        if not folders:
            return batch
        known = self._keys(folders).join(batch.select(*self._names), self._names, "left_semi").distinct()
        return batch.join(known, self._names, "left_anti")


class TimingWheel:
    """Sightings that expire, in slots of ``width`` seconds by the time they expire.

    A slot that is past is dropped as a whole, unread. A slot that takes no more sightings is merged once, to
    one row a key. So what a batch reads are the sightings that are alive, however long the feed has run. A
    manifest names the folders of each slot; a batch that comes again replaces its own. ``now`` never falls.
    """

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType, *, width: int = 3600):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width
        self.names = keys.fieldNames()
        self.schema = T.StructType([*keys.fields, T.StructField("expires_at", T.LongType())])
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def folders(self) -> list[dict]:
        return self.manifest.read()[1].get("folders", [])

    def _read(self, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/slots/{f['slot']}/{f['name']}" for f in folders])

    def _write(self, sightings: DataFrame, slot: int, tag: Sequence | None) -> dict:
        name = uuid.uuid4().hex
        sightings.write.parquet(f"{self.path}/slots/{slot}/{name}")
        return {"slot": slot, "name": name, "tag": list(tag) if tag else None}

    def alive(self, now: int, without: Tag | None = None) -> DataFrame:
        """``(keys..., expires_at)`` of the sightings that have not expired, leaving out those of a tag."""
        some = [f for f in self.folders() if (f["slot"] + 1) * self.width > now and (without is None or f["tag"] != list(without))]
        return self._read(some).filter(F.col("expires_at") > now)

    def add(self, keys: DataFrame, now: int, ttl_seconds: int, tag: Tag) -> None:
        """Adds a sighting of each key, and turns the wheel."""
        expiry = now + ttl_seconds
        entry = self._write(keys.select(*self.names, F.lit(expiry).cast("bigint").alias("expires_at")), expiry // self.width, tag)
        self.manifest.change(lambda c: {"folders": [*[f for f in c.get("folders", []) if f["tag"] != list(tag)], entry]})
        self.turn(now, expiry // self.width)

    def turn(self, now: int, open_slot: int) -> None:
        """Drops the slots that are past and merges those before ``open_slot`` that have several folders."""
        past = {f["slot"] for f in self.folders() if (f["slot"] + 1) * self.width <= now}
        if past:
            self.manifest.change(lambda c: {"folders": [f for f in c["folders"] if f["slot"] not in past]})
            for slot in past:
                remove(self.spark, f"{self.path}/slots/{slot}")
        for slot in sorted({f["slot"] for f in self.folders() if f["slot"] < open_slot}):
            several = [f for f in self.folders() if f["slot"] == slot]
            if len(several) > 1:
                gone = {f["name"] for f in several}
                merged = self._write(self._read(several).groupBy(*self.names).agg(F.max("expires_at").alias("expires_at")), slot, None)
                self.manifest.change(lambda c: {"folders": [*[f for f in c["folders"] if f["name"] not in gone], merged]})  # noqa: B023
                for name in gone:
                    remove(self.spark, f"{self.path}/slots/{slot}/{name}")


def seeded(history: KeyHistory, output: str, keys: Sequence[str]) -> KeyHistory:
    """A history without runs learns the keys of an output that is there."""
    spark = history.spark
    if not history.runs() and path_exists(spark, output):
        history.add(written(spark.read.parquet(output).select(*keys).distinct(), "seed"))
    return history
