"""Queries for joins, de-duplication, aggregates, windows and set operations (JN-*, AGG-*, WIN-*, SET-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import category, dedup, extract, progress, sequence, stats
from ..operators.rules import Selector
from ..operators.skew import lookup_join
from ..session import scratch, written
from ..sources.html import page_nodes
from .catalog import query, table
from .extraction import anchors, level_frame
from .views import ANCHOR_SQL, HOST_SQL, LINK_SQL, PATH_SQL, TEXT_SQL, category_links, customer_paths, seconds, texts

# ---------------------------------------------------------------- category joins

_NAME = lambda c: f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query(
    "jn_01_backfill_ids",
    f"with {LINK_SQL} select url, array_to_string(list_filter([p0, p1, p2, p3], lambda x: x <> ''), '/') as path, case when level < 3 then md5({_NAME('p0')} || '/' || {_NAME('p1')} || '/' || {_NAME('p2')}) end as ids from links",
)
def _backfill_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The index covers levels 0-2 in other letter case and punctuation; customers have no index row."""
    links = category_links(spark, sf)
    p = F.col("cate_names_path")
    keys = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.lower(F.regexp_replace(F.coalesce(F.get(p, i), F.lit("")), r"[^\p{L}\p{N}]+", "")))
    index = links.filter(F.size(p) <= 3).select(
        F.transform(p, lambda n: F.concat(F.lit(" "), F.lower(n), F.lit("!"))).alias("cate_names_path"),
        F.array(F.md5(F.array_join(keys, "/"))).alias("cate_ids_path"),
    )
    out = category.backfill_ids(links, index, strict=False)
    return out.select("url", F.array_join("cate_names_path", "/").alias("path"), F.array_join("cate_ids_path", "|").alias("ids"))


@query(
    "jn_02_prefix_links",
    f"""with {LINK_SQL}, l as (select *, case when p1 = '' then p0 when p2 = '' then p0 || '/' || p1 when p3 = '' then p0 || '/' || p1 || '/' || p2 else p0 || '/' || p1 || '/' || p2 || '/' || p3 end as path from links),
    j as (select a.url, b.level, b.url as up from l a join l b on b.p0 = a.p0 and (b.level < 1 or b.p1 = a.p1) and (b.level < 2 or b.p2 = a.p2) and (b.level < 3 or b.p3 = a.p3) and b.level <= a.level)
    select url, count(*) as n, string_agg(up, ' ' order by level) as urls from j group by 1""",
)
def _prefix_links(spark: SparkSession, sf: str) -> DataFrame:
    out = category.backfill_links(category_links(spark, sf))
    return out.select("url", F.size("cate_links_path").cast("bigint").alias("n"), F.array_join("cate_links_path", " ").alias("urls"))


@query(
    "jn_03_key_checks",
    """select 'duplicate' as kind, md5(text) as key, count(*) as n from documents group by md5(text) having count(*) > 1
    union all select 'orphan', cast(l_partkey as varchar), count(*) from lineitem where l_partkey not in (select p_partkey from part where p_size < 40) group by l_partkey""",
)
def _key_checks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.md5("text").alias("key"))
    twice = category.duplicate_keys(docs, ["key"]).select(F.lit("duplicate").alias("kind"), "key", "n")
    small = table(spark, sf, "part").filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    used = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    orphans = used.join(small, "l_partkey", "left_anti")
    return twice.unionByName(orphans.select(F.lit("orphan").alias("kind"), F.col("l_partkey").cast("string").alias("key"), "n"))


_DOC_STORE = "(select 'CONTENT-' || upper(right(md5(text), 2)) as bucket, md5(text) as _id, min(doc_id) as doc_id from documents group by md5(text))"


def document_store(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a content store: one row per distinct text."""
    docs = table(spark, sf, "documents").select(F.md5("text").alias("_id"), "doc_id")
    return dedup.with_bucket(docs.groupBy("_id").agg(F.min("doc_id").alias("doc_id")))


@query(
    "jn_04_stored_documents",
    f"select bucket, _id, doc_id from {_DOC_STORE} where _id in (select md5(text) from documents where doc_id % 3 = 0 union select md5(text) from benchmark)",
)
def _stored(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.md5("text").alias("_id"))
    bench = table(spark, sf, "benchmark").select(F.md5("text").alias("_id"))
    return dedup.get_documents(document_store(spark, sf), wanted.unionByName(bench)).select("bucket", "_id", "doc_id")


_CACHE = "(select md5(text) as _id, cast(1 as varchar) as value, max(case when doc_id % 4 = 0 then null else 1000 + doc_id end) as expires_at, bool_or(doc_id % 4 = 0) as forever from documents where doc_id % 2 = 0 group by 1)"
_LIVE = f"(select _id, value from {_CACHE} where forever or expires_at > 1500)"


def cache_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("doc_id % 2 = 0")
    forever = F.bool_or(F.col("doc_id") % 4 == 0)
    expiry = F.max(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") + 1000))
    return docs.groupBy(F.md5("text").alias("_id")).agg(
        F.lit("1").alias("value"), F.when(~forever, expiry).alias("expires_at")
    )


@query(
    "jn_05_cache_lookup",
    f"select d.doc_id as pos, md5(text) as _id, value from documents d left join {_LIVE} c on c._id = md5(text)",
)
def _cached(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.md5("text").alias("_id"))
    return dedup.get_cached(requests, cache_table(spark, sf), now=1500).select("pos", "_id", "value")


@query(
    "jn_06_three_tiers",
    """with b as (select o_custkey as key, min(struct_pack(d := o_orderdate, k := o_orderkey)) as f from orders where year(o_orderdate) >= 1997 group by 1),
    c as (select distinct o_custkey as key from orders where year(o_orderdate) = 1996), s as (select distinct o_custkey as key from orders where year(o_orderdate) <= 1995)
    select md5(cast(b.key as varchar)) as _id, f.k as o_orderkey, case when c.key is not null then 'cache' when s.key is not null then 'store' else 'new' end as tier
    from b left join c on b.key = c.key left join s on b.key = s.key""",
)
def _tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Later orders are the batch; customers seen in 1996 are cached, earlier ones stored."""
    o = table(spark, sf, "orders").withColumn("_id", F.md5(F.col("o_custkey").cast("string")))
    year = F.year("o_orderdate")
    cache = o.filter(year == 1996).select("_id", F.lit(None).cast("bigint").alias("expires_at"))
    batch = o.filter(year >= 1997).select("_id", "o_orderdate", "o_orderkey")
    out = dedup.tiers(batch, cache, o.filter(year <= 1995), now=0, order=["o_orderdate", "o_orderkey"])
    return out.select("_id", "o_orderkey", "tier")


@query(
    "jn_07_containment",
    f"with {ANCHOR_SQL} select page_id, 'nav' as father, count(*) as n, string_agg(name, '|' order by pos) as names from anchors group by 1 union all select page_id, 'article', 1, trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) from pages",
)
def _containment(spark: SparkSession, sf: str) -> DataFrame:
    """Children under their fathers, inside the page's own row: a father's elements are a slice of the page's."""
    parsed = page_nodes(table(spark, sf, "pages"), text_tags={"a", "h1"})
    fathers = F.filter("nodes", lambda n: n.tag.isin("nav", "article"))
    rows = parsed.select("page_id", "nodes", F.explode(fathers).alias("f"))
    below = F.slice("nodes", F.col("f.node_id") + 2, F.col("f.end_id") - F.col("f.node_id"))
    names = F.transform(F.filter(below, lambda n: n.tag.isin("a", "h1")), lambda n: n.text)
    found = rows.select("page_id", F.col("f.tag").alias("father"), names.alias("names")).filter(F.size("names") > 0)
    return found.select("page_id", "father", F.size("names").cast("bigint").alias("n"), F.array_join("names", "|").alias("names"))


_STATE_SQL = """states as (select user_id as link_index, arg_max(case when event_type = 'purchase' then 'COMPLETED_END' else 'https://x.example.com/' || event_type || '/' || event_id end, struct_pack(t := floor(epoch(ts)), e := event_id)) as state,
      cast(max(floor(epoch(ts))) as bigint) as seen_at from events group by 1)"""
_NOW = 1706572800  # 2024-01-30


def link_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as progress of a user's link: a purchase completes it, anything else is a page."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "purchase", "completed").otherwise("page")
    url = F.concat(F.lit("https://x.example.com/"), "event_type", F.lit("/"), F.col("event_id").cast("string"))
    return e.select("event_id", F.col("user_id").alias("link_index"), kind.alias("event"), url.alias("page_url"), seconds("ts").alias("ts_sec"))


@query(
    "jn_08_resume_links",
    f"""with {_STATE_SQL} select c_custkey as link_index, coalesce(s.state, 'https://x.example.com/first/' || c_custkey) as start_url from customer c
    left join (select * from states where seen_at + 43200 > {_NOW}) s on s.link_index = c.c_custkey where s.state is null or s.state <> 'COMPLETED_END'""",
)
def _resume(spark: SparkSession, sf: str) -> DataFrame:
    state = progress.latest_state(link_events(spark, sf), now=_NOW, ttl_seconds=43_200)
    url = F.concat(F.lit("https://x.example.com/first/"), F.col("c_custkey").cast("string"))
    links = table(spark, sf, "customer").select(F.col("c_custkey").alias("link_index"), url.alias("url"))
    return progress.resume_links(links, state).select("link_index", "start_url")


@query(
    "str_04_latest_state",
    f"with {_STATE_SQL} select link_index, state, seen_at from states where seen_at + 86400 > {_NOW}",
)
def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return progress.latest_state(link_events(spark, sf), now=_NOW, ttl_seconds=86_400)


@query(
    "str_05_key_batches",
    """select o_custkey as pos, case when k.key is null then case when o_custkey % 2 = 0 then 'old' end else k.value end as value
    from (select distinct o_custkey from orders) o left join (select o_custkey as key, arg_max(o_orderstatus, o_orderkey) as value from orders where year(o_orderdate) >= 2000 group by 1) k on k.key = o.o_custkey""",
)
def _key_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Old keys of even customers, expired ones of the rest; then a batch of writes and a batch of reads."""
    o = table(spark, sf, "orders")
    customers = o.select("o_custkey").distinct()
    key = F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))
    old = customers.select(
        key.alias("key"), F.lit("old").alias("value"),
        F.when(F.col("o_custkey") % 2 != 0, F.lit(50)).cast("bigint").alias("expires_at"),
    )
    writes = o.filter(F.year("o_orderdate") >= 2000).select(key.alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("pos"))
    after = progress.put_keys(old, writes, now=100, ttl=60)
    reads = customers.select(key.alias("key"), F.col("o_custkey").alias("pos"))
    return progress.get_keys(after, reads, now=120).select("pos", "value")


@query(
    "jn_09_requested_keys",
    "select distinct o_custkey as c_custkey, case when c.c_custkey is not null then 'selected' else 'skipped' end as kind from orders left join (select c_custkey from customer where c_acctbal > 0) c on c.c_custkey = o_custkey",
)
def _requested(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    known = table(spark, sf, "customer").filter("c_acctbal > 0")
    selected, skipped = dedup.requested(keys, known, "c_custkey")
    return selected.withColumn("kind", F.lit("selected")).unionByName(skipped.withColumn("kind", F.lit("skipped")))


@query(
    "jn_10_merge_details",
    """with l as (select doc_id, lang as summary, source as owner, cast(n_chars as varchar) as size from documents where doc_id % 3 <> 1),
    d as (select doc_id, case when toxic = 1 then 'toxic' else '' end as summary, case when quality = 1 then 'good' else '' end as owner, '' as size from labels)
    select doc_id, coalesce(nullif(d.summary, ''), l.summary, '') as summary, coalesce(nullif(d.owner, ''), l.owner, '') as owner, coalesce(nullif(d.size, ''), l.size, '') as size from l full join d using (doc_id)""",
)
def _merge(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "documents").filter("doc_id % 3 <> 1").select(
        "doc_id", F.col("lang").alias("summary"), F.col("source").alias("owner"), F.col("n_chars").cast("string").alias("size")
    )
    details = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("summary"),
        F.when(F.col("quality") == 1, "good").otherwise("").alias("owner"), F.lit("").alias("size"),
    )
    return dedup.merge_details(listed, details, "doc_id", ["summary", "owner", "size"])


@query(
    "jn_11_category_tree",
    f"""with recursive {LINK_SQL}, t as (select url, case level when 0 then null when 1 then (select min(url) from links r where r.level = 0 and r.p0 = l.p0)
        when 2 then 'https://shop.example.com/n' || (select min(n_nationkey) from nation where n_name = l.p1) else 'https://shop.example.com/n' || (select min(n_nationkey) from nation where n_name = l.p1) || '/' || lower(p2) end as parent,
        case level when 0 then p0 when 1 then p1 when 2 then p2 else p3 end as name from links l),
    w as (select url, name as path, 0 as level from t where parent is null union all select t.url, w.path || '/' || t.name, w.level + 1 from t join w on t.parent = w.url)
    select url, path, cast(level as bigint) as level from w""",
)
def _tree(spark: SparkSession, sf: str) -> DataFrame:
    links = category_links(spark, sf)
    paths = category.backfill_links(links)
    p = F.col("cate_links_path")
    edges = paths.select(
        "url", F.when(F.size(p) > 1, F.get(p, F.size(p) - 2)).alias("parent"), F.element_at("cate_names_path", -1).alias("name")
    )
    out, _ = category.walk_tree(edges, key="url", parent="parent", name="name")
    return out.select("url", F.array_join("path", "/").alias("path"), F.col("level").cast("bigint").alias("level"))


# ---------------------------------------------------------------- category lines and index

@query(
    "src_07_index_lines",
    f"with {PATH_SQL} select c_custkey, array_to_string(list_filter([r_regionkey, n_nationkey, c_custkey % 900], lambda x, i: i <= 1 + c_custkey % 3), '/') as ids, array_to_string(list_filter([r_name, n_name, c_name], lambda x, i: i <= 1 + c_custkey % 3), '|') as names, cast(c_custkey as bigint) as cate_level_index from paths where c_custkey % 10 <> 9",
)
def _index_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = customer_paths(spark, sf)
    size = (1 + F.col("c_custkey") % 3).cast("int")
    ids = F.slice(F.array("r_regionkey", "n_nationkey", (F.col("c_custkey") % 900).cast("int")), F.lit(1), size)
    names = F.slice(F.array("r_name", "n_name", "c_name"), F.lit(1), size)
    line = category.format_index_line(ids, names, F.col("c_custkey"))
    broken = F.when(F.col("c_custkey") % 10 == 9, F.concat(line, F.lit("------------9"))).otherwise(line)
    rows = p.select("c_custkey", broken.alias("line"))
    out = category.parsed_or_error(rows, "line", category.parse_index_line("line"), strict=False)
    return out.select(
        "c_custkey", F.array_join(F.col("cate_ids_path").cast("array<string>"), "/").alias("ids"),
        F.array_join("cate_names_path", "|").alias("names"), F.col("cate_level_index").cast("bigint").alias("cate_level_index"),
    )


@query(
    "src_08_link_lines",
    f"with {PATH_SQL} select c_custkey, 'https://e.example.com/list--x' || c_custkey || '.html' as url, cast(c_custkey % 5 as bigint) as level, cast(case when c_custkey % 2 = 0 then -1 else r_regionkey end as bigint) as limit_id, c_name as cate_name, r_name || '|' || n_name || '|' || c_name as path from paths",
)
def _link_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = customer_paths(spark, sf)
    key, limit = F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, -1).otherwise(F.col("r_regionkey")).cast("string")
    line = F.concat(
        F.lit(" https://e.example.com/list--x"), key, F.lit(".html--"), (F.col("c_custkey") % 5).cast("string"), F.lit(">>>"), limit,
        F.lit("> "), "r_name", F.lit(" || ||"), "n_name", F.lit("|| "), "c_name", F.lit(" "),
    )
    out = category.parsed_or_error(p.select("c_custkey", line.alias("line")), "line", category.parse_category_link("line"))
    return out.select(
        "c_custkey", "url", F.col("level").cast("bigint").alias("level"), F.col("limit_cate_level_0_id").cast("bigint").alias("limit_id"),
        "cate_name", F.array_join("cate_names_path", "|").alias("path"),
    )


@query(
    "src_09_entry_lines",
    f"with {PATH_SQL} select c_custkey, 'https://e.example.com/' || c_custkey as url, cast(-1 as bigint) as limit_id, n_name as cate_name, cast(2 as bigint) as n from paths",
)
def _entry_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = customer_paths(spark, sf)
    line = F.concat(F.lit("https://e.example.com/"), F.col("c_custkey").cast("string"), F.lit(">>>-1>"), "r_name", F.lit("||"), "n_name")
    out = category.parsed_or_error(p.select("c_custkey", line.alias("line")), "line", category.parse_category_link("line", with_level=False))
    return out.select(
        "c_custkey", "url", F.col("limit_cate_level_0_id").cast("bigint").alias("limit_id"), "cate_name", F.size("cate_names_path").cast("bigint").alias("n")
    )


@query(
    "win_04_index_of_loads",
    f"""with {PATH_SQL},
    loads as (select 1 as load, r_name, n_name, c_name from paths where c_custkey % 2 = 0 union all select 2, r_name, n_name, c_name from paths),
    nodes as (
        select min(load) as load, p, parent, name, d from (
            select load, r_name as p, '' as parent, r_name as name, 1 as d from loads
            union all select load, r_name || chr(1) || n_name, r_name, n_name, 2 from loads
            union all select load, r_name || chr(1) || n_name || chr(1) || c_name, r_name || chr(1) || n_name, c_name, 3 from loads) group by p, parent, name, d),
    ranks as (
        select *, row_number() over (partition by load, parent order by name) as r, row_number() over (partition by load order by p) - 1 as i,
               least(40, count(*) filter (load = 1) over (partition by parent)) as top, count(*) filter (load = 1) over () as firsts from nodes),
    own as (
        select p, parent, d, case when load = 1 then i else firsts + i end as cate_level_index,
               case when r + case when load = 1 then 0 else top end > 40 then 999 else r + case when load = 1 then 0 else top end end as id from ranks)
    select replace(o.p, chr(1), '|') as names, cast(o.cate_level_index as bigint) as cate_level_index, concat_ws('/', up2.id, up.id, o.id) as ids
    from own o left join own up on up.p = o.parent and o.d > 1 left join own up2 on up2.p = up.parent and up.d > 1""",
)
def _index_of_loads(spark: SparkSession, sf: str) -> DataFrame:
    """The index of half the customers, then extended by all of them: what the first load numbered stays."""
    paths = customer_paths(spark, sf).select("c_custkey", F.array("r_name", "n_name", "c_name").alias("path"))
    first = written(category.build_index(paths.filter("c_custkey % 2 = 0"), "path", max_ids=40), "index")
    out = category.extend_index(paths, "path", first, max_ids=40)
    ids = F.transform("cate_ids_path", lambda i: i.cast("string"))
    return out.select(F.array_join("cate_names_path", "|").alias("names"), F.col("cate_level_index").cast("bigint").alias("cate_level_index"), F.array_join(ids, "/").alias("ids"))


@query(
    "win_04_category_index",
    f"""with {PATH_SQL}, n as (select distinct r_name || '' as p, 1 as d, '' as parent, r_name as name from paths union select distinct r_name || chr(1) || n_name, 2, r_name, n_name from paths
       union select distinct r_name || chr(1) || n_name || chr(1) || c_name, 3, r_name || chr(1) || n_name, c_name from paths),
    i as (select *, row_number() over (partition by parent order by name) as id, row_number() over (order by p) - 1 as idx from n)
    select replace(i.p, chr(1), '|') as names, idx as cate_level_index,
       case d when 1 then lpad(least(i.id, 999)::varchar, 3, '0')
              when 2 then (select lpad(a.id::varchar, 3, '0') from i a where a.p = i.parent) || '/' || lpad(i.id::varchar, 3, '0')
              else (select (select lpad(a.id::varchar, 3, '0') from i a where a.p = b.parent) || '/' || lpad(b.id::varchar, 3, '0') from i b where b.p = i.parent) || '/' || case when i.id > 40 then '999' else lpad(i.id::varchar, 3, '0') end end as ids
    from i""",
)
def _build_index(spark: SparkSession, sf: str) -> DataFrame:
    paths = customer_paths(spark, sf).select(F.array("r_name", "n_name", "c_name").alias("path"))
    out = category.build_index(paths, "path", max_ids=40)
    ids = F.transform("cate_ids_path", lambda i: F.lpad(i.cast("string"), category.ID_LENGTH, "0"))
    return out.select(F.array_join("cate_names_path", "|").alias("names"), "cate_level_index", F.array_join(ids, "/").alias("ids"))


@query(
    "agg_10_shared_head",
    f"with {PATH_SQL} select c_custkey, r_name || '|' || n_name as with_two_shared, 'shop|' || r_name as not_shared from paths where r_regionkey is not null",
)
def _shared_head(spark: SparkSession, sf: str) -> DataFrame:
    p = customer_paths(spark, sf).select(
        "c_custkey", F.array(F.lit("all"), F.lit("shop"), "r_name", "n_name").alias("a"),
        F.array(F.lit("shop"), "r_name").alias("b"), F.when(F.col("c_custkey") < 0, "x").otherwise("shop").alias("c"),
    )
    both = category.drop_shared_head(p, "a")
    alone = both.withColumn("b", F.when(F.col("c_custkey") % 2 == 0, F.col("b")).otherwise(F.array(F.lit("club"), F.get("b", F.lit(1)))))
    kept = category.drop_shared_head(alone, "b")
    return kept.select(
        "c_custkey", F.array_join("a", "|").alias("with_two_shared"),
        F.array_join(F.array(F.lit("shop"), F.get("b", F.lit(1))), "|").alias("not_shared"),
    )


# ---------------------------------------------------------------- de-duplication

@query(
    "agg_03_keep_first",
    "select md5(text) as key, min(doc_id) as doc_id, arg_min(lang, doc_id) as lang, arg_min(source, doc_id) as source from documents where text <> '' group by 1",
)
def _keep_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text <> ''").select(F.md5("text").alias("key"), "doc_id", "lang", "source")
    return dedup.keep_first(docs, ["key"], ["doc_id"])


@query(
    "agg_03_keep_first_lines",
    """select l_partkey, l_orderkey, line, l_extendedprice from (select l_partkey, l_orderkey, cast(l_linenumber as bigint) as line, l_extendedprice,
       row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as rn from lineitem) where rn = 1""",
)
def _first_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_extendedprice", "l_shipdate"
    )
    return dedup.keep_first(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "line", "l_extendedprice"]).drop("l_shipdate")


@query(
    "win_01_accepted",
    f"with {TEXT_SQL}, k as (select id, coalesce(text, '') as key from texts) select id, key, key <> '' and row_number() over (partition by key order by id) = 1 as accepted from k",
)
def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts(spark, sf).select("id", F.coalesce("text", F.lit("")).alias("key"))
    return dedup.accepted_flags(rows, "key", ["id"], spread=["id"]).select("id", "key", "accepted")


@query(
    "agg_04_triple_distinct",
    f"""with {ANCHOR_SQL}, t as (select page_id, pos, href as link, name from anchors), d as (select *, row_number() over (partition by page_id, link order by pos) as rn from t)
    select page_id, row_number() over (partition by page_id order by pos) - 1 as pos, link, name from d where rn = 1""",
)
def _triple(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rules import FieldRule
    from .extraction import pages

    out = extract.category_links(pages(spark, sf), FieldRule(css="a", attr="href"), FieldRule(css="a"))
    rows = out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", "name")
    return rows


_DEDUP_SQL = f"""{ANCHOR_SQL}, k as (select page_id, pos, case when pos % 7 = 6 then null when regexp_matches(href, '(?i)/[a-z]{{4}}') then 'id:' || regexp_extract(href, '(?i)/([a-z]{{4}})', 1) else 'url:' || {HOST_SQL} || href end as key from anchors),
    h as (select distinct key from k where page_id % 5 = 0 and key is not null)"""


def link_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every anchor as a link line of level 1; every seventh one is malformed."""
    host = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    level = F.when(F.col("pos") % 7 == 6, "one").otherwise("1")
    line = F.concat(F.lit(" "), host, "href", F.lit("--"), level, F.lit(">>>-1>"), "name")
    return anchors(spark, sf).select("page_id", "pos", line.alias("line"), F.struct("page_id", "pos").alias("at"))


@query(
    "agg_05_link_distinct",
    f"with {_DEDUP_SQL}, r as (select *, row_number() over (partition by key order by page_id, pos) as rn from k where page_id % 5 <> 0 and key is not null) select page_id, pos, key as link_key from r where rn = 1 and key not in (select key from h)",
)
def _link_distinct(spark: SparkSession, sf: str) -> DataFrame:
    lines = link_lines(spark, sf)
    fresh, history = lines.filter("page_id % 5 <> 0"), lines.filter("page_id % 5 = 0")
    out = dedup.new_links(fresh, history, {1: "example\\.[a-z]+/([a-z]{4})"}, order="at")
    return out.select("page_id", "pos", "link_key")


@query(
    "agg_06_longest_list",
    f"with {ANCHOR_SQL} select page_id, greatest(count(*), 1) as longest from anchors group by 1",
)
def _longest(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rules import FieldRule, field_values
    from ..sources.html import page_nodes

    nodes, last = F.col("nodes"), F.size("nodes") - 1
    lists = page_nodes(table(spark, sf, "pages"), text_tags=()).select(
        "page_id", *[field_values(nodes, FieldRule(css=t), F.lit(-1), last).alias(t) for t in ("a", "h1", "title")]
    )
    return lists.select("page_id", extract.longest(F.col("a"), F.col("h1"), F.col("title")).cast("bigint").alias("longest"))


@query(
    "agg_07_bucket_groups",
    "select 'CONTENT-' || upper(right(md5(cast(l_orderkey as varchar)), 2)) as bucket, count(*) as n, count(*) * 256.0 / (select count(*) from lineitem) as load from lineitem group by 1",
)
def _buckets(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("_id"))
    return stats.bucket_report(ids)


_CLASS_SQL = r"""case when regexp_matches(text, '^\p{L}+$') then 'letter' when regexp_matches(text, '^\p{Nd}+$') then 'number' when regexp_matches(text, '^[+-]?\p{Nd}+\.?\p{Nd}*$') then 'float'
    when regexp_matches(text, '^[\x{4e00}-\x{9fff}]+$') then 'chinese' when regexp_matches(text, '^[\p{L}\p{N}]+$') then 'letter_number' else 'other' end"""
_WORD_SQL = f"{TEXT_SQL}, words as (select unnest(string_split(text, ' ')) as text from texts)"


@query("agg_08_text_classes", f"with {_WORD_SQL} select {_CLASS_SQL} as text_class, count(*) as n from words group by 1")
def _classes(spark: SparkSession, sf: str) -> DataFrame:
    words = texts(spark, sf).select(F.explode(F.split("text", " ")).alias("text"))
    return stats.class_counts(words, "text")


@query(
    "agg_09_batch_counts",
    "select count(*) as rows, count_if(l_returnflag = 'R') as valid, count_if(l_returnflag <> 'R') as invalid from lineitem",
)
def _batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.batch_counts(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R")


_LEVELS = [f"level_{i}" for i in range(5)]
_LEVEL_SQL = f"{PATH_SQL}, items as (select c_custkey, r_name as level_0, n_name as level_1, case when c_custkey % 3 = 0 then '00' else c_mktsegment end as level_2, case when c_custkey % 3 = 2 then c_name else '00' end as level_3, '00' as level_4 from paths)"


@query(
    "agg_01_level_stats",
    f"with {_LEVEL_SQL} select count(*) as total_items, " + ", ".join(f"count_if({c} <> '00') as {c}_count, count(distinct nullif({c}, '00')) as unique_{c}" for c in _LEVELS) + " from items",
)
def _level_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.level_stats(level_frame(spark, sf))


@query(
    "agg_01_level_rollup",
    f"with {_LEVEL_SQL} select {', '.join(_LEVELS)}, count(*) as n from items group by rollup ({', '.join(_LEVELS)})",
)
def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    return stats.level_rollup(level_frame(spark, sf))


@query(
    "agg_02_path_stats",
    f"with {_LEVEL_SQL}, k as (select level_0 || '|' || level_1 || '|' || level_2 || '|' || level_3 as key from items) select cast(count(*) as bigint) as total, count(distinct key) as unique, count(*) - count(distinct key) as duplicates from k",
)
def _path_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.path_stats(level_frame(spark, sf))


@query(
    "agg_11_export_counters",
    "select c_custkey, " + ", ".join(f"count(o_orderkey) filter (o_orderkey % 7 = {i}) as ects_{i}" for i in range(5)) + " from customer left join orders on o_custkey = c_custkey group by 1",
)
def _counters(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("_id"))
    log = table(spark, sf, "orders").select(
        F.md5(F.col("o_custkey").cast("string")).alias("_id"), (F.col("o_orderkey") % 7).alias("customer")
    )
    return stats.export_counters(records, log).drop("_id")


# ---------------------------------------------------------------- positions and sets

@query(
    "win_02_id_block",
    """select o_orderkey, (select max(o_orderkey) from orders where o_orderkey % 4 = 0) + row_number() over (order by o_orderdate, o_orderkey) as iid from orders where o_orderkey % 4 <> 0""",
)
def _id_block(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    # The counter starts behind what is stored; from then on blocks come from it alone, here two in a row.
    top = o.filter("o_orderkey % 4 = 0").agg(F.max("o_orderkey").alias("top")).first()["top"]
    leases = sequence.IdLeases(spark, scratch(spark, "ids"), first=top + 1)
    new, order = o.filter("o_orderkey % 4 <> 0"), ["o_orderdate", "o_orderkey"]
    early = sequence.lease_ids(new.filter(F.year("o_orderdate") < 1997), leases, order)[0]
    late = sequence.lease_ids(new.filter(F.year("o_orderdate") >= 1997), leases, order)[0]
    return early.unionByName(late).select("o_orderkey", "iid")


@query(
    "set_01_union_regions",
    f"with {ANCHOR_SQL} select page_id, 'nav' as region, name as text from anchors union all select page_id, 'article', trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) from pages",
)
def _union(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.rules import select_nodes
    from ..sources.html import page_nodes

    nodes = F.col("nodes")

    def region(name: str, css: str):
        found = select_nodes(nodes, Selector.of(css), F.lit(-1), F.size(nodes) - 1)
        return F.transform(found, lambda n: F.struct(F.lit(name).alias("region"), n.text.alias("text")))

    # The regions of a page are one array already, so the union is a concatenation.
    both = F.concat(region("nav", "nav a"), region("article", "article > h1"))
    return page_nodes(table(spark, sf, "pages"), text_tags={"a", "h1"}).select("page_id", F.inline(both))


@query("set_02_seen_keys", "select distinct key from (select l_partkey as key from lineitem union select p_partkey from part)")
def _seen(spark: SparkSession, sf: str) -> DataFrame:
    text_key = lambda c: F.col(c).cast("string").alias("key")
    used = table(spark, sf, "lineitem").select(text_key("l_partkey"))
    parts = table(spark, sf, "part").select(text_key("p_partkey"))
    return dedup.seen_keys(used, parts, "key").select(F.col("key").cast("bigint").alias("key"))


@query("set_03_new_minus_existing", "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def _minus(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return dedup.unseen(table(spark, sf, "part"), used, ["p_partkey"]).select("p_partkey", "p_name")


@query("set_04_intersection", "select distinct o_custkey as c_custkey from orders where o_orderpriority = '1-URGENT' intersect select c_custkey from customer where c_acctbal > 5000")
def _intersect(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    selected, _ = dedup.requested(asked, table(spark, sf, "customer").filter("c_acctbal > 5000"), "c_custkey")
    return selected


@query("skew_lookup_join", "select l_orderkey, l_partkey, cast(l_linenumber as bigint) as line, p_brand from lineitem left join (select * from part where p_size > 10) on l_partkey = p_partkey")
def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").cast("bigint").alias("line"))
    parts = table(spark, sf, "part").filter("p_size > 10").select("p_partkey", "p_brand")
    return lookup_join(lines, parts, ["p_partkey"], spread=["l_orderkey", "line"]).withColumnRenamed("p_partkey", "l_partkey")
