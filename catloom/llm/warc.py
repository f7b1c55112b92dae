"""WARC archives: written record by record, read back along verified chains of record boundaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import scratch, ship_with_tasks, written
from .common import query, table

ship_with_tasks(__name__)

MAGIC = "WARC/1.1\r\n"
_GAP = "\r\n\r\n"
# Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 100
# Boundaries are followed inside stretches of this many bytes of a file, then from stretch to stretch.
STRETCH = 64 << 20
_DATE = "2024-01-01T00:00:00Z"


def _header(*fields: tuple[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(*lines)


def archive_records(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """One text per page, a whole WARC record without the two line ends behind it.

    Of pages with equal payloads of at least ``least`` bytes that with the smallest key is a response and the others
    revisit it; pages that repeat that key are responses too. A null payload is empty, a null key has an empty id and
    revisits any page with a key. Line ends in a url are written percent-encoded.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumns({"bytes": F.octet_length("body"), "digest": F.sha2("body", 256)})
    shared = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Written, so Spark knows its size: broadcast only below its threshold.
    shared = written(shared.select("digest", "first"), "repeated")
    rows = rows.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") != F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_GAP))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))

    def urn(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    clean = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        _header(("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", urn("key")), ("WARC-Target-URI", clean)),
        F.when(again, _header(("WARC-Refers-To", urn("first")), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _header(
            ("WARC-Date", F.lit(_DATE)), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", F.octet_length("block").cast("string")),
        ),
        F.lit("\r\n"),
    )
    return rows.withColumn("block", block).select(F.concat(F.lit(MAGIC), head, F.col("block")).alias("value"))


def write_archives(records: DataFrame, path: str, *, records_per_file: int = 20_000) -> None:
    """Writes records to files of a folder, uncompressed; Spark commits them, so lost tasks leave nothing behind."""
    records.write.option("lineSep", _GAP).option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two places of the magic, with its file, its split and its place among the rows of the split.

    Splits are cut by Spark, which gives every piece to just one of them.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth")
    )


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _parsed(value: Column) -> dict[str, Column]:
    """The fields of a record from the text behind its magic; the payload's own from the whole block."""
    header = F.substring_index(value, _GAP, 1)
    block = F.substr(value, F.length(header) + 5)
    block = F.left(block, F.length(block) - 4)
    http = F.substring_index(block, _GAP, 1)
    payload = F.substr(block, F.length(http) + 5)
    return {
        "header_bytes": F.when(F.instr(value, _GAP) > 0, F.octet_length(header) + 4), "content": _field(header, "Content-Length").cast("bigint"),
        "record_type": _field(header, "WARC-Type"), "record_id": _field(header, "WARC-Record-ID"), "url": _field(header, "WARC-Target-URI"),
        "refers_to": _field(header, "WARC-Refers-To"), "stated_digest": _field(header, "WARC-Payload-Digest"),
        "stated_bytes": _field(http, "Content-Length").cast("bigint"), "payload_bytes": F.octet_length(payload).cast("bigint"), "digest": F.sha2(payload, 256),
    }


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds the offset of the magic before each piece: sums of lengths inside the split, and of the splits before it."""
    size = F.col("size") + len(MAGIC)
    inside = F.coalesce(F.sum(size).over(W.partitionBy("file", "split").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = pieces.groupBy("file", "split").agg(F.sum(size).alias("_sum"))
    # One row per split.
    before = sums.select("file", "split", F.coalesce(F.sum("_sum").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return pieces.withColumn("_in", inside).join(before, ["file", "split"]).withColumn("at", F.col("_before") + F.col("_in") - len(MAGIC)).drop("_in", "_before")


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves its stretch of the file; candidates come from the last to the first."""
    group = group.sort_values("at", ascending=False, ignore_index=True)
    exits: dict[int, int] = {}
    for at, after in zip(group["at"].tolist(), group["after"].tolist(), strict=True):
        exits[at] = exits.get(after, after)
    return pd.DataFrame({"file": group["file"], "at": group["at"], "exit": [exits[a] for a in group["at"].tolist()]})


def _marked(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a stretch that lie on the chain from where it is entered."""
    after = dict(zip(group["at"].tolist(), group["after"].tolist(), strict=True))
    reached, here = set(), int(group["entry"].iloc[0])
    while here in after:
        reached.add(here)
        here = after[here]
    return pd.DataFrame({"file": group["file"], "at": group["at"], "reached": np.isin(group["at"].to_numpy(), list(reached))})


def reachable(candidates: DataFrame, *, stretch: int = STRETCH) -> DataFrame:
    """``(file, at)`` of the records that a chain of boundaries from the start of their file reaches.

    ``candidates`` has ``file``, ``at`` and ``after``, where the next record must begin. Tasks follow chains inside
    stretches of a file; pointer jumping then doubles the reach over stretches in every round.
    """
    placed = candidates.withColumn("stretch", F.expr(f"at div {stretch}"))
    jump = written(placed.groupBy("file", "stretch").applyInPandas(_exits, "file string, at bigint, exit bigint"), "jumps")
    reached, size = jump.filter("at = 0").select("file", "at"), None
    while True:
        there = reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reached = written(reached.unionByName(there).distinct(), "reached")
        if (n := reached.count()) == size:
            break
        size = n
        onward = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("_far"))
        jump = written(jump.join(onward, ["file", "exit"], "left").select("file", "at", F.coalesce("_far", "exit").alias("exit")), "jumps")
    entries = reached.select("file", F.expr(f"at div {stretch}").alias("stretch"), F.col("at").alias("entry"))
    entered = placed.join(entries.groupBy("file", "stretch").agg(F.min("entry").alias("entry")), ["file", "stretch"])
    marked = entered.groupBy("file", "stretch").applyInPandas(_marked, "file string, at bigint, reached boolean")
    return marked.filter("reached").select("file", "at")


def read_archives(spark: SparkSession, path: str, *, stretch: int = STRETCH, payloads: bool = False) -> DataFrame:
    """The records of all archives of a folder: ``file, at, record_type, record_id, url, refers_to, payload_bytes, payload_digest``
    and, with ``payloads``, ``payload`` as text.

    Spark splits the files at the magic, wherever it stands. A piece with a header is a candidate and names the
    offset of its successor; only candidates on the chain from the start of their file are records. Pieces that
    belong to a payload which holds the magic are put back into their record, which is gathered alone. A file
    that doesn't begin with a record has none, and a chain ends where no record follows. Empty files have none. For
    revisits, which have no payload, size and digest are those their headers state.
    """
    fields = ["record_type", "record_id", "url", "refers_to", "stated_digest", "stated_bytes", "payload_bytes", "digest"]
    pieces = _pieces(spark, path)
    narrow = pieces.select("file", "split", "nth", F.octet_length("value").cast("bigint").alias("size"), *[v.alias(k) for k, v in _parsed(F.col("value")).items()])
    narrow = written(_placed(written(narrow, "pieces")), "pieces")
    after = F.col("at") + len(MAGIC) + F.col("header_bytes") + F.col("content") + 4
    found = narrow.withColumn("after", after)
    candidates = found.filter("at >= 0 and after is not null")
    chain = written(reachable(candidates.select("file", "at", "after"), stretch=stretch), "chain")
    ends = F.col("at") + len(MAGIC) + F.col("size") == F.col("after")
    records = candidates.join(chain, ["file", "at"])
    torn = written(records.filter(~ends).select("file", "at", "after"), "torn")
    whole = records.filter(ends).select("file", "at", "split", "nth", *fields)
    if not payloads:
        whole = whole.drop("split", "nth")
    else:
        whole = whole.join(pieces.select("file", "split", "nth", _payload(F.col("value")).alias("payload")), ["file", "split", "nth"]).drop("split", "nth")
    if not torn.isEmpty():
        joined = _rejoined(pieces, narrow, torn, stretch)
        own = joined.select("file", "at", *[v.alias(k) for k, v in _parsed(F.col("value")).items() if k in fields], *([_payload(F.col("value")).alias("payload")] if payloads else []))
        whole = whole.unionByName(own)
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "file", "at", "record_type", "record_id", "url", "refers_to",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha256:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        *(["payload"] if payloads else []),
    )


def _payload(value: Column) -> Column:
    block = F.substr(value, F.length(F.substring_index(value, _GAP, 1)) + 5)
    block = F.left(block, F.length(block) - 4)
    return F.substr(block, F.length(F.substring_index(block, _GAP, 1)) + 5)


def _rejoined(pieces: DataFrame, narrow: DataFrame, torn: DataFrame, stretch: int) -> DataFrame:
    """``(file, at, value)`` of the records whose text the magic tears: their pieces in order, with the magic between.

    A piece belongs to the last torn record before it in its stretch, or else to the one that reaches in from
    an earlier stretch, if it lies before that record's end. Both are found by equality of file and stretch.
    """
    starts = torn.select("file", "at", F.col("at").alias("owner"), F.col("after").alias("till"))
    placed = narrow.filter("at >= 0").select("file", "split", "nth", "at").join(starts, ["file", "at"], "left").withColumn("stretch", F.expr(f"at div {stretch}"))
    across = torn.withColumn("stretch", F.explode(F.expr(f"sequence(at div {stretch}, (after - 1) div {stretch})"))).filter(f"stretch > at div {stretch}")
    across = across.select("file", "stretch", F.col("at").alias("_owner"), F.col("after").alias("_till"))
    last = W.partitionBy("file", "stretch").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    owned = placed.withColumns({"owner": F.last("owner", True).over(last), "till": F.last("till", True).over(last)}).join(across, ["file", "stretch"], "left")
    owned = owned.withColumns({"owner": F.coalesce("owner", "_owner"), "till": F.coalesce("till", "_till")}).filter("at < till")
    texts = pieces.join(written(owned.select("file", "split", "nth", "at", "owner"), "owned"), ["file", "split", "nth"])
    # One record at a time, as long as its own text.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return texts.groupBy("file", "owner").agg(F.array_join(parts, MAGIC).alias("value")).withColumnRenamed("owner", "at")


OP6_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, d as payload_digest,
       case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when first is null or page_id = first then null else first end as refers_to
from p left join f using (d)"""


@query("op6_warc", OP6_SQL)
def op6(spark, sf):
    """Every page's record as it is read back from archives that hold all pages."""
    path = scratch(spark, "warc")
    write_archives(archive_records(table(spark, sf, "pages")), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("bigint")
    return read_archives(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
