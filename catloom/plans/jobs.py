"""Queries that run a whole job: list pages to a numbered catalog, detail pages into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.category_tree import CategoryTreeJob, TreeRules
from ..jobs.list_content import ListContentJob, ListRules
from ..operators.filters import RecordFilter
from ..operators.records import DetailRules
from ..operators.rules import FieldRule, RegionRule
from ..session import scratch
from .catalog import query, table
from .scalars import CAPTION_STEPS
from .views import ANCHOR_SQL, HOST_SQL

# Ten pages are the list of one link. The items are the page's navigation links of at least two letters.
_FIELDS = {
    "link": FieldRule(css="a", attr="href"),
    "main_title": FieldRule(css="a"),
    "id": FieldRule(css="a", attr="href", regex=r"^/([A-Za-z]{2,}).*$"),
    "raw_id": FieldRule(css="a", attr="href"),
}
_RULES = ListRules(
    fields=_FIELDS, regions=(RegionRule(css="nav ul", fields=tuple(_FIELDS)),), content_type="article",
    records=RecordFilter(all_of=("CATE_LIST_COMMON_MAIN_TITLE",)),
)
# A match of the id's pattern gives its group, no match keeps the value.
_ITEMS_SQL = f"""{ANCHOR_SQL}, items as (
    select page_id, pos, case when regexp_matches(href, '^/[A-Za-z]{{2,}}') then regexp_extract(href, '^/([A-Za-z]{{2,}})', 1) else href end as id
    from anchors where trim(name) <> '')"""


def catalog_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    return table(spark, sf, "pages").select(F.floor(n / 10).cast("bigint").alias("link_index"), (n % 10).alias("page_no"), "page_id", "url", "html")


def catalog_job(spark: SparkSession, **options) -> ListContentJob:
    return ListContentJob(spark, scratch(spark, "catalog"), _RULES, length=1, **options)


@query(
    "job_list_content",
    f"""with {_ITEMS_SQL},
    met as (select case when page_id % 10 < 6 then 1 else 2 end as run, id, min(struct_pack(p := page_id, s := pos)) as f from items group by all),
    every as (select id, min(struct_pack(p := page_id, s := pos)) as f from items group by 1),
    new as (select run, id, f, row_number() over (order by run, f) as iid from met m where run = 1 or id not in (select id from met where run = 1))
    select m.run, md5(m.id) as _id, n.iid, case when n.iid is null then 'cache' else 'new' end as tier, m.f.p as page_id from met m left join new n on n.run = m.run and n.id = m.id
    union all select 3, md5(id), null, 'store', f.p from every""",
)
def _list_content(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs: the first six pages of each list, then all pages (six are seen by now), then all again when everything has expired."""
    job, pages = catalog_job(spark, cache_ttl=600, page_ttl=900), catalog_pages(spark, sf)
    links = pages.groupBy("link_index").agg(F.lit(9).alias("last_page_no"))
    out = None
    for run, (now, some) in enumerate([(1000, pages.filter("page_no < 6")), (1500, pages), (9000, pages)], 1):
        met = job.run(links, some, now=now, tag=f"run-{run}").select(F.lit(run).alias("run"), "_id", "iid", "tier", "page_id")
        out = met if out is None else out.unionByName(met)
    return out


# The detail page of a record: the first page whose first item it is; its language is the summary, its heading the description.
_DETAILS = DetailRules({
    "id": FieldRule(css="nav ul li a", attr="href", regex=r"^/([A-Za-z]{2,}).*$"),
    "summary": FieldRule(css="html", attr="lang"),
    "sku_color_names": FieldRule(css="nav ul li a", attr="href"),
})


@query(
    "job_detail_records",
    f"""with {_ITEMS_SQL}, firsts as (select id, min(struct_pack(p := page_id, s := pos)) as f from items group by 1),
    heads as (select page_id, case when regexp_matches(href, '^/[A-Za-z]{{2,}}') then regexp_extract(href, '^/([A-Za-z]{{2,}})', 1) else href end as id from anchors where pos = 0),
    details as (select id, min(page_id) as page_id from heads group by 1), colors as (select page_id, string_agg(href, '|' order by pos) as colors from anchors group by 1)
    select md5(f.id) as _id, row_number() over (order by f.f) as iid, f.id, p.url as crawl_url, 1000 as crawl_time,
      coalesce(regexp_extract(q.html, '<html lang="([^"]*)"', 1), '') as summary, coalesce(q.url, '') as update_url,
      case when q.url is null then 0 else 2000 end as update_time, coalesce(c.colors, '') as colors
    from firsts f join pages p on p.page_id = f.f.p left join details d on d.id = f.id left join pages q on q.page_id = d.page_id left join colors c on c.page_id = d.page_id""",
)
def _detail_records(spark: SparkSession, sf: str) -> DataFrame:
    """The stored records after a run over the lists and one over the same pages as detail pages."""
    job, pages = catalog_job(spark), catalog_pages(spark, sf)
    job.run(pages.select("link_index").distinct(), pages, now=1000, tag="lists")
    job.add_details(pages.select("page_id", "url", "html"), _DETAILS, now=2000, tag="details")
    return job.store.read().select(
        "_id", "iid", "common.id", "crawl_url", "crawl_time", "common.summary", "update_url", "update_time",
        F.array_join(F.transform("content.sku_colors", lambda c: c["name"]), "|").alias("colors"),
    )


_KEY = "replace(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), 'ß', 'ss')"


@query(
    "job_category_tree",
    f"""with {ANCHOR_SQL}, texts as (select page_id * 100000 + pos as id, name as text from anchors), {CAPTION_STEPS},
    built as (select a.page_id, a.pos, page_id % 2 as run, c.caption, replace(replace(url_encode({HOST_SQL} || href), '%3A', ':'), '%2F', '/') as link, a.url as page_url
      from anchors a join captions c on c.id = a.page_id * 100000 + a.pos where c.caption is not null),
    kept as (select * from (select *, row_number() over (partition by link order by run, page_id, pos) as rn from built) where rn = 1),
    roots as (select page_id, url, 'p' || page_id as root, least(row_number() over (order by 'p' || page_id), 999) as id from pages),
    names as (select page_id, caption, min(run) as run, row_number() over (partition by page_id order by caption) as id, {_KEY.format('caption')} as key from kept group by page_id, caption),
    every as (select 0 as run, root || chr(1) as path, page_id, '' as caption from roots union all select run, 'p' || page_id || chr(1) || caption, page_id, caption from names),
    idx as (select page_id, caption, row_number() over (order by run, case when caption = '' then 'p' || page_id else path end) - 1 as place from every),
    counts as (select page_id, key, count(*) as n from names group by all),
    same as (select page_id, {_KEY.format('caption')} as key, count(*) as n from kept group by all)
    select r.url, 0 as level, r.root as path, cast(r.id as varchar) as ids, r.url as links, i.place, r.url || '--0>>>-1>' || r.root as line
    from roots r join idx i on i.page_id = r.page_id and i.caption = ''
    union all select k.link, 1, r.root || '/' || k.caption, case when c.n = 1 then r.id || '/' || n.id end, case when s.n = 1 then r.url || ' ' || k.link end, i.place,
      k.link || '--1>>>-1>' || r.root || '||' || k.caption
    from kept k join roots r on r.page_id = k.page_id join names n on n.page_id = k.page_id and n.caption = k.caption join counts c on c.page_id = k.page_id and c.key = n.key
    join same s on s.page_id = k.page_id and s.key = n.key join idx i on i.page_id = k.page_id and i.caption = k.caption""",
)
def _category_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every page is an entry; the first run reads the even pages, the second all pages."""
    pages = table(spark, sf, "pages")
    root = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    entries = pages.select(F.concat("url", F.lit(">>>-1>"), root).alias("line"))
    tree = pages.select("page_id", "url", "html", F.lit(0).alias("level"), F.lit(-1).alias("limit_cate_level_0_id"), F.array(root).alias("cate_names_path"))
    job = CategoryTreeJob(spark, scratch(spark, "tree"), TreeRules(link=FieldRule(css="a", attr="href"), name=FieldRule(css="a")))
    job.run(tag="even", entries=entries, pages=tree.filter("page_id % 2 = 0"))
    job.run(tag="all", pages=tree)
    places = job.index().select(F.array_join("cate_names_path", "/").alias("path"), F.col("cate_level_index").alias("place"))
    rows = job.filled().select(
        "url", "level", F.array_join("cate_names_path", "/").alias("path"), F.array_join("cate_ids_path", "/").alias("ids"),
        F.array_join("cate_links_path", " ").alias("links"), "line",
    )
    return rows.join(places, "path")
