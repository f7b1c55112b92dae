"""The job over category pages: links built, new ones kept, written as lines, ids and upper links filled in."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import normalize_link
from ..manifest import Manifest
from ..operators.category import (
    LinkRules,
    backfill_ids,
    backfill_links,
    build_index,
    build_links,
    extend_index,
    format_index_line,
    parse_category_link,
    parsed_or_error,
)
from ..operators.dedup import new_links
from ..operators.extract import category_links
from ..operators.rules import FieldRule, RegionRule
from ..session import Shelf

LINKS = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("limit_cate_level_0_id", T.IntegerType()),
    T.StructField("cate_name", T.StringType()), T.StructField("cate_names_path", T.ArrayType(T.StringType())), T.StructField("line", T.StringType()),
])
INDEX = T.StructType([
    T.StructField("cate_ids_path", T.ArrayType(T.IntegerType())), T.StructField("cate_names_path", T.ArrayType(T.StringType())),
    T.StructField("cate_level_index", T.LongType()),
])


@dataclass(frozen=True)
class TreeRules:
    """Where a category page holds its links and names, how links are built, and what their ids are on each level."""

    link: FieldRule
    name: FieldRule
    build: LinkRules = LinkRules()
    regions: tuple[RegionRule, ...] = ()
    level_regex: dict[int, str] = field(default_factory=dict)


class CategoryTreeJob:
    """A category tree in a shared folder, one part for each run: its new links and its new rows of the index.

    A manifest lists the runs; naming a run there is its commit. A run with a tag that is listed is made anew against the others, and
    takes the old one's place, so a run that was lost can be started again. Earlier links keep their places and ids. Of two
    runs at once the later one gets a ``Conflict`` and is to be started again.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: TreeRules):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules
        self.manifest = Manifest(spark, f"{self.folder}/manifest")

    def _parts(self, kind: str, schema: T.StructType, runs: list[dict] | None = None) -> DataFrame:
        runs = self.manifest.read()[1].get("runs", []) if runs is None else runs
        paths = [f"{self.folder}/{kind}/{r['part']}" for r in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def links(self) -> DataFrame:
        """All links: ``(url, level, limit_cate_level_0_id, cate_name, cate_names_path, line)``."""
        return self._parts("links", LINKS)

    def index(self) -> DataFrame:
        """The index: ids path, names path and number of every category."""
        return self._parts("index", INDEX)

    def _found(self, pages: DataFrame) -> DataFrame:
        """Built links of pages ``(page_id, url, html, level, limit_cate_level_0_id, cate_names_path)``, one level below the page."""
        keep = ("page_id", "level", "limit_cate_level_0_id", "cate_names_path", "url")
        rules = self.rules
        rows = category_links(pages, rules.link, rules.name, region_rules=list(rules.regions) or None, keep=keep)
        link = normalize_link(F.col("link"), F.col("url"))
        rows = rows.select(
            *keep[:-1], F.struct(F.lit(1).alias("kind"), "page_id", "unit", "region_seq", "pos").alias("at"), "name",
            F.explode(F.array_compact(F.array(link))).alias("url"),
        )
        path = F.concat(F.coalesce("cate_names_path", F.array().cast("array<string>")), F.array("cate_name"))
        built = build_links(rows, rules.build, level=F.col("level") + 1, limit=F.col("limit_cate_level_0_id"), names_path=path)
        return built.withColumn("cate_names_path", path).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LINKS.fields], "at")

    def _entries(self, lines: DataFrame) -> DataFrame:
        """Links of level 0 from their lines ``URL>>>limit>name`` (SRC-09); a malformed line raises."""
        rows = parsed_or_error(lines.select("line"), "line", parse_category_link("line", with_level=False))
        line = F.concat("url", F.lit("--0>>>"), F.col("limit_cate_level_0_id").cast("string"), F.lit(">"), F.array_join("cate_names_path", "||"))
        # Entries stand before what pages give; among themselves by URL.
        at = F.struct(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("page_id"), F.lit(0).alias("unit"), F.lit(0).alias("region_seq"), F.lit(0).alias("pos"))
        return rows.withColumn("line", line).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LINKS.fields], at.alias("at"))

    def run(self, *, tag: str, pages: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
        """Adds the links of entry lines and pages that no other run has, and returns them with their place in the index.

        Of several links with one key (the link's id on its level, else its URL) the first counts: entries, then pages by id. Names are numbered under
        their parents and behind the names of earlier runs.
        """
        frames = [f for f in (None if entries is None else self._entries(entries), None if pages is None else self._found(pages)) if f is not None]
        if not frames:
            raise ValueError("a run needs pages or entries")
        version, content = self.manifest.read()
        others = [r for r in content.get("runs", []) if r["tag"] != tag]
        shelf, name = Shelf(self.spark), uuid.uuid4().hex
        every = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        fields = [f.name for f in LINKS.fields]
        found = shelf.put(every.withColumn("at", F.struct("at.kind", "at.page_id", "at.unit", "at.region_seq", "at.pos", "url")), "links")
        fresh = shelf.put(new_links(found, self._parts("links", LINKS, others), self.rules.level_regex, order="at").select(*fields), "fresh")
        fresh.write.parquet(f"{self.folder}/links/{name}")

        earlier = self._parts("index", INDEX, others)
        if earlier.isEmpty():
            added = build_index(fresh, "cate_names_path")
        else:
            top = earlier.agg(F.max("cate_level_index").alias("m")).first()["m"]
            added = extend_index(fresh, "cate_names_path", earlier).filter(F.col("cate_level_index") > top)
        added.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX.fields]).write.parquet(f"{self.folder}/index/{name}")
        self.manifest.commit(version + 1, {**content, "runs": [*others, {"tag": tag, "part": name}]})
        shelf.clear()
        return self.spark.read.schema(LINKS).parquet(f"{self.folder}/links/{name}")

    def filled(self, *, strict: bool = False) -> DataFrame:
        """JN-01 and JN-02: all links with the ids and the URLs along their paths.

        Names are compared without case and punctuation. Where they don't make a path unique, or an upper link is missing, ``strict`` raises and otherwise
        the field is NULL.
        """
        return backfill_links(backfill_ids(self.links(), self.index(), strict=strict), strict=strict)

    def lines(self) -> tuple[DataFrame, DataFrame]:
        """The files of links and of the index as lines (SNK-01, SNK-02)."""
        return self.links().select("line"), self.index().select(format_index_line(F.col("cate_ids_path"), F.col("cate_names_path"), F.col("cate_level_index")).alias("line"))
