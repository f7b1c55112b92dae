"""Line de-duplication against levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import let
from ..manifest import Manifest
from ..session import remove, scratch, written
from .common import lower_ascii, query, table

LEAST_POINTS = 10
FAN = 2  # runs of one level that are merged into one of the next
BATCHES = 4
HOT = 1000  # a line with more than this part of a batch's lines is hot, so there are fewer hot lines than this
_SPACE = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(_SPACE)))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The hashes of all lines seen so far, in sorted runs on levels.

    A run is a folder of Parquet files, one or more for each hash bucket, sorted by hash. A new run starts on
    level 0; as soon as a level has ``fan`` runs, they are merged into one of the next level, so there are at
    most ``fan - 1`` runs for each power of ``fan`` batches, and a hash is rewritten once a level. Runs share no hash.
    Which runs count is written in a manifest, whose next version is the commit of a run or a merge: a job
    that is lost in between leaves files that no version names.

    Runs are read as bucketed tables, so a batch is shuffled once and merged with run after run in place.
    """

    def __init__(self, spark: SparkSession, path: str, *, fan: int = FAN, buckets: int | None = None):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        version, content = self.manifest.read()
        if not version:
            content = {"runs": [], "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}
            self.manifest.commit(1, content)
        self.buckets = content["buckets"]

    def runs(self) -> list[dict]:
        return self.manifest.read()[1]["runs"]

    def _table(self, name: str) -> str:
        return f"line_run_{name}"

    def _open(self, run: dict) -> DataFrame:
        name = self._table(run["name"])
        if not self.spark.catalog.tableExists(name):
            # Another session wrote the run: its files are sorted and bucketed, the catalog only has to know.
            self.spark.sql(
                f"create table {name} (h1 bigint, h2 bigint) using parquet clustered by (h1, h2) sorted by (h1, h2)"
                f" into {self.buckets} buckets location '{self.path}/{run['name']}'"
            )
        return self.spark.table(name)

    def _write(self, hashes: DataFrame) -> str:
        name = uuid.uuid4().hex
        dealt = hashes.select(*_HASH).repartition(self.buckets, *_HASH).sortWithinPartitions(*_HASH)
        dealt.write.format("parquet").bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{self.path}/{name}").saveAsTable(self._table(name))
        return name

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows of a batch whose hash is in no run: one merge anti-join for each run."""
        for run in self.runs():
            hashes = hashes.join(self._open(run).hint("merge"), _HASH, "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Adds hashes that no run has, each once, as a run of level 0, and merges full levels."""
        name = self._write(hashes)
        self.manifest.change(lambda c: {**c, "runs": [*c["runs"], {"name": name, "level": 0}]})
        level = 0
        while len(full := [r for r in self.runs() if r["level"] == level]) >= self.fan:
            merged = self._open(full[0])
            for run in full[1:]:
                merged = merged.unionByName(self._open(run))
            name, gone = self._write(merged), {r["name"] for r in full}
            self.manifest.change(lambda c: {**c, "runs": [*[r for r in c["runs"] if r["name"] not in gone], {"name": name, "level": level + 1}]})  # noqa: B023
            for old in gone:
                self.spark.sql(f"drop table if exists {self._table(old)}")
                remove(self.spark, f"{self.path}/{old}")
            level += 1

    def drop(self) -> None:
        """Forgets everything."""
        for run in self.runs():
            self.spark.sql(f"drop table if exists {self._table(run['name'])}")
        remove(self.spark, self.path)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """``(doc, row, pos, h1, h2)`` of the lines whose keys are long enough; two seeded hashes make 128 bits."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    rows = docs.select("doc", "row", F.posexplode(keys).alias("pos", "key")).filter(F.length("key") >= least)
    return rows.select("doc", "row", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def losing_lines(lines: DataFrame, runs: LineRuns, *, hot: int = HOT) -> DataFrame:
    """One batch: the lines ``(doc, row, pos)`` that go, and the batch's new hashes added to ``runs``.

    A line goes if its hash is in an earlier run or a smaller document of the batch holds it. Copies of a line
    are counted before they are shuffled. Hot lines, fewer than ``hot`` by their share, are joined by broadcast,
    the others by a shuffle in which no key is large.
    """
    found = lines.groupBy(*_HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count_if(F.col("doc").isNull()).alias("keyless"), F.count("*").alias("n"))
    found = written(found, "line-hashes")
    fresh = written(runs.unseen(found), "line-new")
    runs.add(fresh)
    # Nothing to look up for a line that is new and in one document.
    several = (F.col("first") < F.col("last")) | (F.col("first").isNotNull() & (F.col("keyless") > 0))
    old = found.join(fresh, _HASH, "left_anti").withColumn("old", F.lit(True))
    losing = written(old.unionByName(fresh.filter(several).withColumn("old", F.lit(False))).select(*_HASH, "first", "old", "n"), "line-losing")
    many = lines.count() / hot
    goes = F.col("old") | F.coalesce(F.col("doc") > F.col("first"), F.col("doc").isNull())
    out = []
    for some, hint in ((losing.filter(F.col("n") > many), F.broadcast), (losing.filter(F.col("n") <= many), lambda df: df)):
        out.append(lines.join(hint(some.drop("n")), _HASH).filter(goes).select("doc", "row", "pos"))
    return out[0].unionByName(out[1])


def _flags(places: Column, n: Column) -> Column:
    """An array of ``n`` booleans that is true at the sorted ``places``, in one pass over them."""
    gaps = F.transform(places, lambda p, i: p - F.when(i > 0, F.get(places, i - 1)).otherwise(F.lit(-1)) - 1)
    marked = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    return F.concat(marked, F.array_repeat(F.lit(False), n - F.coalesce(F.get(places, F.size(places) - 1), F.lit(-1)) - 1))


def dedup_lines(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", least: int = LEAST_POINTS, batches: int = BATCHES, runs: LineRuns | None = None, hot: int = HOT
) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``lines`` (its number of lines), ``dropped`` and ``kept`` (the text that is left).

    Lines whose key has at least ``least`` code points stay in the document with the smallest ``key`` only, all of
    them there; shorter ones always stay. With ``runs`` of earlier loads, lines seen there go everywhere. Rows that
    share a key count as one document; rows without a key are one document behind all others. ``key`` is a number.

    The documents go through in ``batches`` in order of their keys, with borders from a quantile sketch; the
    result does not depend on the borders. An empty table gives an empty result. A null text is one empty line.
    """
    spark = docs.sparkSession
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("doc"), F.col(text).alias("text"))
    # The row is known by its key and text: rows equal in both lose the same lines.
    named = own.withColumn("id", F.xxhash64("doc", "text"))
    temporary = None if runs else scratch(spark, "line-runs")
    runs = runs or LineRuns(spark, temporary)
    share = [i / batches for i in range(1, batches)]
    borders = sorted(set(docs.agg(F.percentile_approx(key, share, 1000)).first()[0] or [])) if share else []
    number = sum((F.coalesce(F.col("doc") > b, F.lit(True)).cast("int") for b in borders), F.lit(0))
    lines = _lines(named.select("doc", "text", F.col("id").alias("row")), least).withColumn("batch", number)
    path = scratch(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(lines.schema).parquet(path)
    gone = None
    for b in range(len(borders) + 1):
        # Written at once: the runs change with the next batch.
        part = written(losing_lines(stored.filter(F.col("batch") == b).drop("batch"), runs, hot=hot), "line-drops")
        gone = part if gone is None else gone.unionByName(part)
    per_row = gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    places = written(per_row.select(F.col("doc").alias("_doc"), F.col("row").alias("_id"), "places"), "line-places")
    remove(spark, path)
    if temporary:
        runs.drop()
    joined = named.join(places, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("id") == F.col("_id")), "left")
    n, lost = F.size("all").cast("bigint"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint")
    left = let(_flags(F.col("places"), F.size("all")), lambda flags: F.filter(F.col("all"), lambda line, i: ~F.get(flags, i)))
    kept = F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    out = joined.select("row", "text", "places", lines_of(F.col("text")).alias("all"))
    return out.select("row", n.alias("lines"), lost.alias("dropped"), kept.alias("kept"))


OP12_SQL = r"""
with lines as (
    select doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents)),
firsts as (select key, min(doc_id) as first from lines where length(key) >= 10 group by key),
judged as (select doc_id, k, line, coalesce(doc_id > first, false) as gone from lines left join firsts using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by k) filter (not gone), '')) as kept_sha256
from judged group by doc_id"""


@query("op12_line_dedup", OP12_SQL)
def op12(spark, sf):
    """Every document with its lines, those that an earlier document holds, and the digest of the rest."""
    out = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))
