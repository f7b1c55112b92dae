"""URL rules by host and path, held as sorted digest arrays that tasks map from files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship_with_tasks, write_bytes
from .common import lower_ascii, query, table

ship_with_tasks(__name__)

# Rows of rules in one file; more rules make more files, which are probed one after another.
BLOCK_ROWS = 4_000_000
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; '' without ``://`` or url."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Sorted 64-bit xxhash keys of rule texts, and the texts themselves, mapped from one file.

    Layout: row count, byte count, keys, borders of the texts, verdicts, texts. A probe is one
    vectorised binary search over all keys; what it finds is confirmed against the stored text,
    past as many equal keys as there are.
    """

    def __init__(self, path: str):
        n, size = np.fromfile(path, np.int64, 2)
        at = 16
        self.keys = np.memmap(path, np.uint64, "r", at, (int(n),)) if n else np.zeros(0, np.uint64)
        self.borders = np.memmap(path, np.int64, "r", at + 8 * n, (int(n) + 1,))
        self.blocked = np.memmap(path, np.uint8, "r", at + 16 * n + 8, (int(n),)) if n else np.zeros(0, np.uint8)
        self.texts = np.memmap(path, np.uint8, "r", at + 17 * n + 8, (int(size),)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def pack(rules: Iterable[tuple[bytes, bool]], digest=xxhash.xxh64_intdigest) -> bytes:
        rows = sorted((digest(text), text, blocked) for text, blocked in rules)
        borders = np.cumsum([0] + [len(text) for _, text, _ in rows]).astype(np.int64)
        return b"".join((
            np.array([len(rows), borders[-1]], np.int64).tobytes(), np.array([k for k, _, _ in rows], np.uint64).tobytes(), borders.tobytes(),
            np.array([b for _, _, b in rows], np.uint8).tobytes(), *(text for _, text, _ in rows),
        ))

    def find(self, probes: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """For each probe the row of the rule with just this text, or -1."""
        wanted = np.fromiter((digest(p) for p in probes), np.uint64, len(probes))
        at, found = np.searchsorted(self.keys, wanted), np.full(len(probes), -1, np.int64)
        open_ = np.flatnonzero(at < len(self.keys))
        open_ = open_[self.keys[at[open_]] == wanted[open_]]
        while len(open_):
            for i in open_:
                row = at[i]
                if self.texts[self.borders[row] : self.borders[row + 1]].tobytes() == probes[i]:
                    found[i] = row
            open_ = open_[found[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
            open_ = open_[self.keys[at[open_]] == wanted[open_]]
        return found


_maps: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    # Not a cached function: those are shipped by name, and workers may lack the package.
    if name not in _maps:
        _maps[name] = DigestArray(SparkFiles.get(name))
    return _maps[name]


def _rule_texts(host: bytes, path: bytes, sizes: dict[int, list[int]]) -> list[bytes]:
    """Texts of all rules that would fit, longest first; of equal ones the longer host first.

    ``sizes`` has the path lengths of the rules by host length, so only texts that can be rules are made.
    """
    hosts = [host[-n:] for n in sizes if n == len(host) or n < len(host) and host[-n - 1] == 46]
    fits = [(len(h) + k, len(h), h + path[:k]) for h in hosts for k in sizes[len(h)] if k <= len(path)]
    return [text for _, _, text in sorted(fits, reverse=True)]


def _publish(spark: SparkSession, packed: bytes) -> str:
    """Hands a file of rules in the shared folder to Spark, which copies it to every executor that asks for it."""
    path = scratch(spark, f"rules-{hashlib.sha256(packed).hexdigest()}")
    write_bytes(spark, path, packed)
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def judge(urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = ALLOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``urls`` plus ``host``, ``path``, ``rule`` and ``verdict``; columns with these names are replaced.

    ``rules`` has ``host``, ``path`` and ``verdict`` ('allow' or 'block'). A rule fits its host and
    all subdomains if the url's path starts with the rule's; a null path fits all paths. Of the
    rules that fit the longest text ``host + path`` wins, of equally long ones that with the longer
    host. A rule given with both verdicts blocks. Rules without a host fit nothing. A url that
    no rule fits gets a null rule and ``default``. A null url has an empty host and path.

    Rules leave Spark in files of ``block_rows`` rows, so neither the driver nor a task holds more than
    one file; the longest match over all files wins. Urls are never shuffled.
    """
    spark = urls.sparkSession
    text = F.encode(F.concat(lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))), "utf-8")
    texts = (
        rules.filter(F.length("host") > 0)
        .select(text.alias("text"), F.octet_length("host").alias("n"), F.octet_length(F.coalesce("path", F.lit(""))).alias("k"), (F.col("verdict") == BLOCK).alias("blocked"))
        .groupBy("text").agg(F.max("blocked").alias("blocked"), F.first("n").alias("n"), F.first("k").alias("k"))
    )
    # At most one row per pair of lengths, whatever the number of rules.
    sizes: dict[int, list[int]] = {}
    for r in texts.select("n", "k").distinct().collect():
        sizes.setdefault(r["n"], []).append(r["k"])
    blocks = -(-texts.count() // block_rows)
    out = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    best = F.lit(None).cast("struct<rule:string,verdict:string,rank:bigint>")
    for block in range(blocks):
        part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).select("text", "blocked")
        name = _publish(spark, DigestArray.pack((bytes(r["text"]), bool(r["blocked"])) for r in part.toLocalIterator()))
        found = _prober(name, sizes)("host", "path")
        out = out.withColumn("_found", found)
        better = F.coalesce(F.col("_found")["rank"], F.lit(-1)) > F.coalesce(best["rank"], F.lit(-1))
        out = out.withColumn("_best", F.when(better, F.col("_found")).otherwise(best)).drop("_found")
        best = F.col("_best")
    if not blocks:
        out = out.withColumn("_best", best)
    return out.withColumns({"rule": F.col("_best")["rule"], "verdict": F.coalesce(F.col("_best")["verdict"], F.lit(default))}).drop("_best")


def _prober(name: str, sizes: dict[int, list[int]]):
    @F.arrow_udf("struct<rule:string,verdict:string,rank:bigint>")
    def probe(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        rules = _mapped(name)
        fits = [_rule_texts(h.encode(), p.encode(), sizes) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
        found = rules.find([text for texts in fits for text in texts])
        out, at = [], 0
        for host, texts in zip(hosts.to_pylist(), fits, strict=True):
            hit = next((i for i in range(len(texts)) if found[at + i] >= 0), None)
            if hit is None:
                out.append(None)
            else:
                rule = texts[hit]
                verdict = BLOCK if rules.blocked[found[at + hit]] else ALLOW
                out.append({"rule": rule.decode(), "verdict": verdict, "rank": len(rule) * 65536 + len(rule.partition(b"/")[0])})
            at += len(texts)
        return pa.array(out, pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("rank", pa.int64())]))

    return probe.asNondeterministic()


OP9_RULES = [
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
]

OP9_SQL = r"""
with parts as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged as (
    select *, (select max({'n': length(h || p), 'rule': h || p, 'verdict': v}) from rules
               where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as best from parts)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from judged"""


@query("op9_url_rules", OP9_SQL)
def op9(spark, sf):
    """Every page's url judged by the fixed rules; what no rule fits is allowed."""
    rules = spark.createDataFrame(OP9_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
