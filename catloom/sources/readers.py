"""Sources (SRC-01 .. SRC-12). A missing or unreadable input is an empty frame where the inventory says so."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.base import trim_ws
from ..operators.sequence import MOST_SPLITS, read_positions
from ..session import path_exists, ship_with_tasks, written

ship_with_tasks(__name__)

LINE = T.StructType([T.StructField("value", T.StringType())])

def is_utf8(encoding: str) -> bool:
    return encoding.lower().replace("-", "").replace("_", "") in ("utf8", "utf8sig")


def allow_charset(spark: SparkSession) -> None:
    """Spark decodes charsets beyond its short list only behind this setting."""
    spark.conf.set("spark.sql.legacy.javaCharsets", True)


def read_lines(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """SRC-01: lines with CR and LF stripped, in any charset that keeps the ASCII line end.

    ``spark.read.text`` ignores its encoding but hands the bytes of a line on as they
    are, so the line is decoded from them.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], LINE)
    lines = spark.read.text(path)
    if not is_utf8(encoding):
        allow_charset(spark)
        lines = lines.select(F.decode(F.col("value").cast("binary"), encoding).alias("value"))
    cleaned = F.rtrim(F.col("value"), F.lit("\r\n"))
    return lines.select(cleaned.alias("value"))


def read_string(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """SRC-02: one row per file with its whole text."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LINE)
    if is_utf8(encoding):
        return spark.read.text(path, wholetext=True)
    allow_charset(spark)
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.decode("content", encoding).alias("value"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line the quotes of its split in front of it, and the last lines of the split, itself included,
    with an even and with an odd number of quotes in front; -1 where there is none yet."""
    last, total, starts = None, 0, [-1, -1]
    for batch in batches:
        before, even, odd = [], [], []
        for path, block, row, n in zip(*(batch[c].to_pylist() for c in ("_path", "_block", "_row", "_quotes")), strict=True):
            if (path, block) != last:
                last, total, starts = (path, block), 0, [-1, -1]
            starts[total % 2] = row
            before.append(total)
            even.append(starts[0])
            odd.append(starts[1])
            total += n
        added = [pa.array(x, pa.int64()) for x in (before, even, odd)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_before", "_even", "_odd"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as ``value``, also those with line ends inside quotes, with ``first``: whether it is its file's first.

    Files are read in splits like any text. Whether a line starts inside quotes is the parity of the quotes in front of it in the
    file: those in its split, which the task adds up as it reads, and those of all splits before, from one sum per split. A
    line that starts outside begins a record; which line that was is noted for both parities while the parity isn't known.
    Records of one line, as a rule nearly all, stay where they are; the others are put together by file and first
    line. A quote that is never closed makes the rest of its file one record, as it does for one reader of the whole file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = split_lines(spark, path, F.col("value"), lineSep="\n").withColumns({"_row": F.monotonically_increasing_id(), "_quotes": quotes.cast("bigint")})
    schema = T.StructType([*lines.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_before", "_even", "_odd")]])
    # Written where they are read, so that the sums and the lines come from the same splits.
    marked = written(lines.mapInArrow(_running, schema), "csv-lines")
    splits = marked.groupBy("_path", "_block").agg(
        F.sum("_quotes").alias("_n"), F.count("*").alias("_lines"), F.min("_row").alias("_first"), F.max("_even").alias("_e"), F.max("_odd").alias("_o")
    )
    earlier = W.partitionBy("_path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    summed = splits.withColumns({"_sum": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_skip": F.coalesce(F.sum("_lines").over(earlier), F.lit(0))})

    def begun(even: str, odd: str) -> Column:
        """The place in the file of the last line that begins a record, of those that a split's parity chooses between."""
        row = F.when(F.col("_sum") % 2 == 0, F.col(even)).otherwise(F.col(odd))
        return F.when(row >= 0, F.col("_skip") + row - F.col("_first"))

    carried = summed.withColumn("_last", begun("_e", "_o")).withColumn("_carry", F.max("_last").over(earlier))
    offsets = written(carried.select("_path", "_block", "_first", "_sum", "_skip", "_carry"), "csv-splits")
    small = offsets.count() <= MOST_SPLITS
    placed = marked.join(F.broadcast(offsets) if small else offsets, ["_path", "_block"])
    inside = (F.col("_sum") + F.col("_before")) % 2 == 1
    open_ = (F.col("_sum") + F.col("_before") + F.col("_quotes")) % 2 == 1
    line = F.col("_skip") + F.col("_row") - F.col("_first")
    told = placed.select("_path", line.alias("line"), F.coalesce(begun("_even", "_odd"), F.col("_carry")).alias("_start"), (inside | open_).alias("part"), "value")
    whole = told.filter("not part").select("_path", "line", "value")
    values = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda p: p["value"])
    longer = told.filter("part").groupBy("_path", "_start").agg(F.array_join(values, "\n").alias("value"))
    joined = longer.select("_path", F.col("_start").alias("line"), "value")
    records = whole.unionByName(joined)
    return records.select("value", (F.col("line") == 0).alias("first"))


def read_csv(spark: SparkSession, path: str, columns: list[str], *, multi_line: bool = True) -> DataFrame:
    """SRC-03: CSV with a header (a byte-order mark is fine), every value a string.

    Large files are split, also where values hold line ends, see ``csv_records``. Without ``multi_line``, for files whose
    values hold none, Spark's own reader does it in one pass.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    if not multi_line:
        return spark.read.options(header=True, escape='"', enforceSchema=True).schema(schema).csv(path).fillna("")
    records = csv_records(spark, path).filter(~F.col("first")).select(F.rtrim("value", F.lit("\r")).alias("value")).filter(F.length(trim_ws("value")) > 0)
    kind = ", ".join(f"`{c}` string" for c in columns)
    parsed = records.select(F.from_csv("value", kind, {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(*[F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in columns])


def read_level_csv(spark: SparkSession, path: str, columns: list[str], empty: str = "00", *, multi_line: bool = True) -> DataFrame:
    """SRC-04: SRC-03 with trimmed values; only a truly empty value becomes ``00``."""
    raw = read_csv(spark, path, columns, multi_line=multi_line)
    return raw.select(*[F.when(F.col(c) == "", empty).otherwise(trim_ws(c)).alias(c) for c in columns])


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-05: a file that holds one JSON array; corrupt files give no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-06: JSON lines; blank lines are skipped, corrupt ones dropped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: trimmed non-empty lines with their position in file order, from 0."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string, pos bigint")
    lines = split_lines(spark, path, trim_ws("value")).filter(F.col("value") != "")
    # Ids are given behind the filter, so that they count what is left.
    return read_positions(lines.withColumn("_row", F.monotonically_increasing_id())).select("value", "pos")


def split_lines(spark: SparkSession, path: str, value: Column, **options) -> DataFrame:
    """Lines as ``value`` with the file and the split that they are read from."""
    split = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")]
    return spark.read.options(**options).text(path).select(value.alias("value"), *split)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """An earlier output, or no rows where there is none yet. A path that is there and can't be read is an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def read_history(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """SRC-11: an earlier output as history; anything unreadable counts as no history."""
    try:
        frame = read_or_empty(spark, path, schema, fmt)
        frame.limit(1).collect()
        return frame
    except Exception:  # noqa: BLE001  (here any failure means that there is no history)
        return spark.createDataFrame([], schema)


def read_all_formats(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> dict[str, DataFrame]:
    """SRC-12: the same data from every enabled format, keyed by format."""
    from .writers import FORMATS

    return {fmt: FORMATS[fmt].read(spark, path, schema) for fmt, path in paths.items()}


def differences(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows that not every format holds equally often, with the counts per format."""
    names = list(frames)
    columns = frames[names[0]].columns
    tagged = [f.select(*columns).withColumn("_f", F.lit(n)) for n, f in frames.items()]
    every = tagged[0]
    for frame in tagged[1:]:
        every = every.unionByName(frame)
    counts = every.groupBy(*columns).agg(*[F.count_if(F.col("_f") == n).alias(f"in_{n}") for n in names])
    uneven = F.least(*[F.col(f"in_{n}") for n in names]) != F.greatest(*[F.col(f"in_{n}") for n in names])
    return counts.filter(uneven)
