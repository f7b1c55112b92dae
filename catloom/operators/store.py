"""The bucketed document store as a log of Parquet runs (SNK-06 .. SNK-08, SRC-13, SRC-14, STR-08)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..manifest import Conflict, Manifest
from ..session import remove, scratch, written
from .dedup import in_buckets, keep_first, unseen_in_history, with_bucket

INSERT, PUT, DELETE = 0, 1, 2
FAN = 8  # runs of a level that are merged into one of the next


class ContentStore:
    """Documents by ``_id`` in hash buckets: a log of runs, of which the newest version of a document wins.

    Every change appends a run with its own rows only, one folder per bucket: documents that were inserted, whole
    new versions of documents, or marks of deleted ones. A manifest lists the runs from old to new; making its next
    version is the commit, so a reader sees a change whole or not at all, and a job that is lost before it leaves
    files that no manifest names. Of two writers who started from the same version one is told and tries again.

    A read takes the runs of one manifest. Only where some run has new versions or marks, their ids are gathered and joined
    to the rows, older rows of these ids drop out; a store that was only inserted into is read as it is. When a level has
    ``fan`` runs they are merged, so their number grows with the logarithm of the changes, and a row is
    rewritten once a level. The files of merged runs stay until no kept manifest names them.

    ``_id`` is an md5, so buckets stay even. Reads for a batch name its buckets, at most ``16 ** length`` short
    texts, so folders without any of its ids are not opened.
    """

    def __init__(self, spark: SparkSession, path: str, schema, *, prefix: str = "CONTENT", length: int = 2, fan: int = FAN):
        if fan < 2:
            raise ValueError("at least two runs are merged")
        self.spark, self.path, self.prefix, self.length, self.fan = spark, path.rstrip("/"), prefix, length, fan
        self.schema = schema
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    # -------------------------------------------------------------- reading

    def _full_schema(self):
        return self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit("")).schema

    def _fields(self) -> list[str]:
        return [f.name for f in self._full_schema()]

    def _rows(self, runs: list[dict]) -> DataFrame:
        """All rows of runs, with what they are (``_op``) and the age of their run, from 0 for the oldest."""
        extra = [T.StructField("_op", T.ByteType()), T.StructField("run", T.StringType())]
        schema = T.StructType([*self._full_schema().fields, *extra])
        if runs:
            paths = [f"{self.path}/data/run={r['name']}" for r in runs]
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        else:
            rows = self.spark.createDataFrame([], schema)
        ages = F.create_map(*[F.lit(x) for i, r in enumerate(runs) for x in (r["name"], i)]) if runs else F.create_map(F.lit(""), F.lit(0))
        return rows.filter(F.col("_id").isNotNull()).withColumn("_age", ages[F.col("run")]).drop("run")

    def _newest(self, runs: list[dict], condition: Column | None = None) -> DataFrame:
        """The rows that no newer run of these replaces or deletes, and the newest marks."""
        rows = self._rows(runs)
        rows = rows if condition is None else rows.filter(condition)
        changed = [r for r in runs if r["changes"]]
        if not changed:
            return rows
        # Ages are those of the whole list, so only the names of the other runs are left out here.
        marks = self._rows(runs).filter(F.col("_age").isin([i for i, r in enumerate(runs) if r["changes"]]) & (F.col("_op") != INSERT))
        last = marks.groupBy("bucket", "_id").agg(F.max("_age").alias("_last"))
        last = last if condition is None else last.filter(condition)
        joined = rows.join(last, ["bucket", "_id"], "left")
        return joined.filter(F.col("_last").isNull() | (F.col("_age") >= F.col("_last"))).drop("_last")

    def _read(self, runs: list[dict], buckets: Column | None = None) -> DataFrame:
        return self._newest(runs, buckets).filter(F.col("_op") != DELETE).select(*self._fields())

    def _runs(self) -> tuple[int, list[dict]]:
        version, content = self.manifest.read()
        return version, content.get("runs", [])

    def read(self, condition: Column | None = None) -> DataFrame:
        """SRC-13: all documents, or those that meet a condition, as they are now."""
        docs = self._read(self._runs()[1])
        return docs if condition is None else docs.filter(condition)

    def read_for(self, batch: DataFrame, *, without: str | None = None) -> DataFrame:
        """The documents in the buckets of a batch, as they were without the run of a tag."""
        return self._read([r for r in self._runs()[1] if without is None or r.get("tag") != without], in_buckets(batch))

    def find_one(self, condition: Column) -> DataFrame:
        """SRC-14: at most one matching document."""
        return self.read(condition).limit(1)

    # -------------------------------------------------------------- writing

    def _write(self, rows: DataFrame) -> str:
        """A new run of rows ``(fields, _op)`` that no manifest names yet."""
        name = uuid.uuid4().hex
        # One writer per bucket where that is enough; AQE splits buckets that outgrow a task.
        rows.select(*self._fields(), "_op").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/run={name}")
        return name

    def _append(self, docs: DataFrame, op: int, version: int | None = None, tag: str | None = None) -> None:
        """Writes a run and commits it, behind ``version`` if one is given: then a ``Conflict`` if there is a newer one.

        A run with a tag takes the place of the one that has it, which is not merged before another tag comes;
        full levels are merged before such a run is made, not after it.
        """
        entry = {"name": self._write(docs.withColumn("_op", F.lit(op).cast("byte"))), "level": 0, "changes": op != INSERT}
        if tag is not None:
            entry["tag"] = tag

        def added(content: dict) -> dict:
            runs = content.get("runs", [])
            return {**content, "runs": [*[r for r in runs if tag is None or r.get("tag") != tag], entry]}

        if version is None:
            self.manifest.change(added)
        else:
            content = self.manifest.read()[1]
            try:
                self.manifest.commit(version + 1, added(content))
            except Conflict:
                remove(self.spark, f"{self.path}/data/run={entry['name']}")
                raise
        if tag is None:
            self._merge_full_levels()

    def _bucketed(self, docs: DataFrame) -> DataFrame:
        return with_bucket(docs, prefix=self.prefix, length=self.length)

    def insert(self, docs: DataFrame) -> None:
        """SNK-06: append without a check."""
        self._append(self._bucketed(docs), INSERT)

    def insert_new(
        self, docs: DataFrame, order: list[str], *, tag: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """SNK-07: insert documents whose ``_id`` the store lacks; returns exactly those.

        Rows without ``_id`` are skipped and the first of several equal ids counts.
        The batch and the new rows are written to the shared folder first: the batch
        so that the store is only scanned for its ids, the new rows so that those
        returned and those stored are the same even if tasks are retried. If another writer
        commits meanwhile, the rows are looked up again. ``finish`` may add what only new documents get, such as their
        numbers, before they are stored. With a ``tag`` a repeated insert replaces the one before it.
        """
        batch = written(self._bucketed(keep_first(docs, ["_id"], order)), "batch")
        if tag is not None:
            self._merge_full_levels(but=tag)
        while True:
            version, runs = self._runs()
            before = [r for r in runs if tag is None or r.get("tag") != tag]
            fresh = unseen_in_history(batch, self._read(before, in_buckets(batch)), ["bucket", "_id"]).select(*batch.columns)
            fresh = written(fresh if finish is None else finish(written(fresh, "fresh")), "insert")
            try:
                self._append(fresh, INSERT, version, tag)
            except Conflict:
                continue
            return fresh

    def upsert(self, docs: DataFrame, order: list[str], *, tag: str | None = None, keep: Column | None = None) -> None:
        """STR-08: insert new documents and replace known ones. The batch's own rows are all that is written.

        With a ``tag``, such as the number of a batch, a repeated upsert replaces the one before it. Rows that don't
        meet ``keep`` leave when the oldest runs are merged.
        """
        if tag is not None or keep is not None:
            self._merge_full_levels(but=tag, keep=keep)
        self._append(self._bucketed(keep_first(docs, ["_id"], order)), PUT, tag=tag)

    def delete(self, ids: DataFrame) -> None:
        """Marks of deleted documents for a frame of ``_id``; ids that the store lacks don't matter."""
        fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._full_schema() if f.name not in ("_id", "bucket")]
        self._append(self._bucketed(ids.select("_id").filter("_id is not null").distinct()).select("_id", "bucket", *fields), DELETE)

    def update_one(self, condition: Column, changes: dict[str, Column]) -> None:
        """SNK-08: change fields of one matching document (the lowest ``_id``)."""
        self._change_one(condition, changes)

    def delete_one(self, condition: Column) -> None:
        """SNK-08: delete one matching document (the lowest ``_id``)."""
        self._change_one(condition, None)

    def _change_one(self, condition: Column, changes: dict[str, Column] | None) -> None:
        while True:
            version, runs = self._runs()
            docs = self._read(runs)
            target = docs.filter(condition).agg(F.min(F.struct("_id", "bucket")).alias("t")).first()["t"]
            if target is None:
                return
            row = docs.filter((F.col("bucket") == target["bucket"]) & (F.col("_id") == target["_id"])).dropDuplicates(["_id"])
            row = written(row if changes is None else row.withColumns(changes), "change")
            try:
                self._append(row, DELETE if changes is None else PUT, version)
            except Conflict:
                continue
            return

    # -------------------------------------------------------------- merging

    def _merge_full_levels(self, but: str | None = None, keep: Column | None = None) -> None:
        level = 0
        while level <= max((r["level"] for r in self._runs()[1]), default=-1):
            full = [r for r in self._runs()[1] if r["level"] == level and (but is None or r.get("tag") != but)]
            if len(full) >= self.fan:
                self._merge(full, level + 1, keep)
            level += 1

    def compact(self, keep: Column | None = None, *, but: str | None = None) -> None:
        """Merges all runs, but that of a tag, into one without marks; of the documents those that meet ``keep`` stay."""
        runs = [r for r in self._runs()[1] if but is None or r.get("tag") != but]
        if len(runs) > 1 or any(r["changes"] for r in runs) or keep is not None and runs:
            self._merge(runs, max(r["level"] for r in runs), keep)

    def _merge(self, some: list[dict], level: int, keep: Column | None = None) -> None:
        """Puts one run in the place of neighbours in the list; nothing if another writer was first."""
        names = [r["name"] for r in some]
        oldest = names[0] == self._runs()[1][0]["name"]
        rows = self._newest(some)
        if oldest:
            # Nothing older is left that a version or a mark could stand against.
            rows = rows.filter(F.col("_op") != DELETE).withColumn("_op", F.lit(INSERT).cast("byte"))
            rows = rows if keep is None else rows.filter(keep)
        entry = {"name": self._write(rows), "level": level, "changes": not oldest and any(r["changes"] for r in some)}

        def replaced(content: dict) -> dict:
            runs = content["runs"]
            at = next((i for i, r in enumerate(runs) if r["name"] == names[0]), None)
            if at is None or [r["name"] for r in runs[at : at + len(names)]] != names:
                raise Conflict("these runs were merged by another writer")
            version = self.manifest.read()[0]
            gone = [*content.get("gone", []), *({"name": n, "version": version} for n in names)]
            return {**content, "runs": [*runs[:at], entry, *runs[at + len(names) :]], "gone": gone}

        try:
            content = self.manifest.change(replaced)
        except Conflict:
            remove(self.spark, f"{self.path}/data/run={entry['name']}")
            return
        # Readers may hold any manifest that is kept; files that only older ones name can go.
        kept = self.manifest.versions()[0]
        past = [g["name"] for g in content["gone"] if g["version"] < kept]
        for name in past:
            remove(self.spark, f"{self.path}/data/run={name}")
        if past:
            self.manifest.change(lambda c: {**c, "gone": [g for g in c["gone"] if g["name"] not in past]})


def apply_one(docs: DataFrame, target: Column, changes: dict[str, Column] | None) -> DataFrame:
    """``docs`` with the target rows changed, or removed when there are no changes."""
    if changes is None:
        return docs.filter(~F.coalesce(target, F.lit(False)))
    return docs.withColumns({n: F.when(target, c).otherwise(F.col(n)) for n, c in changes.items()})


def one_target(docs: DataFrame, condition: Column) -> Column:
    """Condition for the single row an update or delete acts on: the lowest matching ``_id``."""
    row = docs.filter(condition).agg(F.min("_id").alias("m")).first()
    return F.col("_id") == F.lit(row["m"])


def new_store(spark: SparkSession, schema, **options) -> ContentStore:
    """An empty store in the shared folder."""
    return ContentStore(spark, scratch(spark, "store"), schema, **options)
