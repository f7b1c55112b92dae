"""The jobs over list and detail pages: parse, filter, tiers, numbers, store, cache, progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.caps import stop_pages
from ..operators.dedup import keep_first
from ..operators.extract import content_records, list_records
from ..operators.filters import RecordFilter
from ..operators.progress import COMPLETED, SAME_ITEMS
from ..operators.records import RECORD, DetailRules, detail_records, whole_records, with_details
from ..operators.rules import FieldRule, RegionRule
from ..operators.sequence import IdLeases, lease_ids
from ..operators.skew import lookup_join
from ..operators.state_table import StateTable
from ..operators.store import ContentStore
from ..session import Shelf, written

PAGE = ("link_index", "page_no", "page_id", "url")
ORDER = ["link_index", "page_no", "page_id", "unit", "region_seq", "record_seq"]


@dataclass(frozen=True)
class ListRules:
    """What is read on a list page, and what must hold of a record."""

    fields: dict[str, FieldRule]
    regions: tuple[RegionRule, ...] = ()
    content_type: str = "product"
    max_count: int = -1
    records: RecordFilter = RecordFilter()


class ListContentJob:
    """A catalog in a shared folder: the document store, the cache of known ids, seen pages, progress of links, id leases.

    Each run has a ``tag``. What a run writes carries it, so a run that was lost and is started again with the same tag
    sees everything as it was before and replaces what it had written; the ids it had leased are not given out again. The
    store is written first, then the cache, then pages and progress: a run that is never repeated leaves pages unseen, and
    the next one finds their records in the store.
    """

    def __init__(
        self, spark: SparkSession, folder: str, rules: ListRules, *, cache_ttl: int | None = 604_800, page_ttl: int | None = 864_000,
        streak: int = 0, user_index: int = -1, user_name: str = "", length: int = 2,
    ):
        self.spark, self.rules, self.cache_ttl, self.page_ttl, self.streak = spark, rules, cache_ttl, page_ttl, streak
        self.user = {"user_index": user_index, "user_name": user_name}
        folder = folder.rstrip("/")
        self.store = ContentStore(spark, f"{folder}/store", RECORD, length=length)
        self.cache, self.pages, self.progress = (StateTable(spark, f"{folder}/{n}", length=length) for n in ("cache", "pages", "progress"))
        self.leases = IdLeases(spark, f"{folder}/ids")

    def open_pages(self, links: DataFrame, pages: DataFrame, *, now: int, tag: str | None = None) -> DataFrame:
        """JN-08 and STR-03: pages ``(link_index, page_no, page_id, url, html)`` of links that are not completed, less the pages seen before.

        Links and pages without an index or a URL are no pages of the job.
        """
        key = F.col("link_index").cast("string").alias("key")
        state = self.progress.get(links.select("link_index", key).filter("key is not null").distinct(), now=now, without=tag)
        done = F.coalesce(F.col("value").isin(COMPLETED, SAME_ITEMS), F.lit(False))
        wanted = state.filter(~done).select("link_index")
        urls = pages.select("link_index", F.col("url").alias("key")).join(wanted, "link_index", "left_semi").select("key").distinct()
        unseen = self.pages.get(urls.filter("key is not null"), now=now, without=tag).filter(F.col("value").isNull())
        fresh = unseen.select(F.col("key").alias("url"))
        return pages.join(wanted, "link_index", "left_semi").join(fresh, "url", "left_semi").select(*PAGE, "html")

    def parse(self, pages: DataFrame, *, now: int) -> DataFrame:
        """Whole records of the pages' valid list items; items without an id are no records."""
        rules = self.rules
        parsed = list_records(
            pages, rules.fields, list(rules.regions) or None, content_type=rules.content_type, max_count=rules.max_count, keep=PAGE
        )
        valid = rules.records.split(parsed)[0].filter(F.coalesce("id", F.lit("")) != "")
        return whole_records(content_records(valid, crawl_time=now), **self.user)

    def run(self, links: DataFrame, pages: DataFrame, *, now: int, tag: str) -> DataFrame:
        """One pass over the pages that are open. Returns every record that was met, once, with ``tier``: ``new`` (stored now, with its
        ``iid``), ``store`` or ``cache`` (known there; no ``iid``), and the page and place where it was met first.

        ``links`` has ``link_index`` and, if known, ``last_page_no``: a link is completed when that page was read. It also ends after ``streak``
        pages in a row, over this run's pages, that gave nothing new (0: never). Without open pages nothing changes.
        """
        shelf = Shelf(self.spark)
        todo = self.open_pages(links, pages, now=now, tag=tag)
        # One pass over the pages: what is read from them is written down, and the pages' own keys.
        read = shelf.put(todo.select(*PAGE), "read")
        rows = shelf.put(self.parse(todo, now=now), "records")
        first = shelf.put(keep_first(rows, ["_id"], ORDER), "first")

        asked = first.select("_id", F.col("_id").alias("key"))
        cached = shelf.put(self.cache.get(asked, now=now, without=tag).filter(F.col("value").isNotNull()).select("_id"), "cached")
        rest = first.join(cached, "_id", "left_anti")
        # Ids follow the place where a record was met.
        places = first.select("_id", *ORDER)

        def numbered(fresh: DataFrame) -> DataFrame:
            ids = lease_ids(places.join(fresh.select("_id"), "_id", "left_semi"), self.leases, ORDER, "iid")[0]
            return fresh.join(ids.select("_id", "iid"), "_id")

        new = self.store.insert_new(
            rest.select(*[f.name for f in RECORD.fields if f.name != "iid"]), ["_id"], tag=tag, finish=numbered
        ).select("_id", "iid")
        tier = F.when(F.col("_cached"), "cache").when(F.col("iid").isNotNull(), "new").otherwise("store")
        out = places.join(new, "_id", "left").join(cached.withColumn("_cached", F.lit(True)), "_id", "left")
        out = written(out.select("_id", "iid", tier.alias("tier"), *ORDER), "outcome")

        put = out.filter("tier <> 'cache'").select(F.col("_id").alias("key"), F.lit("1").alias("value"), F.lit(0).alias("pos"))
        self.cache.put(put, now=now, ttl=self.cache_ttl, tag=tag)
        seen = read.select(F.col("url").alias("key"), F.lit("1").alias("value"), F.lit(0).alias("pos"))
        self.pages.put(seen, now=now, ttl=self.page_ttl, tag=tag)
        self.progress.put(self._states(links, read, out), now=now, ttl=self.page_ttl, tag=tag)
        shelf.clear()
        return out

    def _states(self, links: DataFrame, read: DataFrame, out: DataFrame) -> DataFrame:
        """STR-04: the state of each link that was read: completed, ended for want of new items, or its last page."""
        last = read.groupBy("link_index").agg(F.max(F.struct("page_no", "page_id", "url")).alias("p"))
        state = last.select("link_index", F.col("p.page_no").alias("page_no"), F.col("p.url").alias("value"))
        if "last_page_no" in links.columns:
            ends = links.groupBy("link_index").agg(F.max("last_page_no").alias("_end"))
            state = lookup_join(state, ends, ["link_index"]).withColumn("value", F.when(F.col("page_no") >= F.col("_end"), COMPLETED).otherwise(F.col("value")))
        if self.streak:
            items = out.withColumn("fresh", F.col("tier") == "new")
            stopped = stop_pages(items, link="link_index", page_no="page_no", fresh="fresh", streak=self.streak, pages=read)
            ended = stopped.select("link_index").distinct().withColumn("_ended", F.lit(True))
            kept = (F.col("value") != COMPLETED) & F.coalesce(F.col("_ended"), F.lit(False))
            state = lookup_join(state, ended, ["link_index"]).withColumn("value", F.when(kept, SAME_ITEMS).otherwise(F.col("value")))
        return state.select(F.col("link_index").cast("string").alias("key"), "value", F.lit(0).alias("pos"))

    def add_details(self, pages: DataFrame, rules: DetailRules, *, now: int, tag: str) -> DataFrame:
        """Detail pages ``(page_id, url, html)`` of stored records: filled values win over the list page's, in a new version of the record.

        Returns the ``_id`` of every page that has one, with ``known``; records that the store lacks stay out of it. Of several pages of a record the
        first counts.
        """
        shelf = Shelf(self.spark)
        found = detail_records(pages, rules).filter("id <> ''").withColumn("_id", F.md5("id"))
        details = shelf.put(self.store._bucketed(keep_first(found, ["_id"], ["page_id"])), "details")
        stored = self.store.read_for(details, without=tag)
        changed = shelf.put(with_details(stored, details.drop("bucket", "id"), update_time=now), "changed")
        out = details.select("_id", "page_id").join(changed.select("_id", F.lit(True).alias("known")), "_id", "left")
        out = written(out.withColumn("known", F.coalesce("known", F.lit(False))), "outcome")
        self.store.upsert(changed.select(*[f.name for f in RECORD.fields]), ["_id"], tag=tag)
        shelf.clear()
        return out
