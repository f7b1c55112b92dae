"""Category lines, paths and trees (SRC-07 .. SRC-09, JN-01 .. JN-03, JN-11, PRJ-17 .. PRJ-22, AGG-10, WIN-04)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import col, trim_ws
from ..functions.text import OTHER_CAPTION, clean_caption, extract_regex_key, path_keys
from ..session import written
from .filters import full_match, start_id_gate
from .sequence import dense_position
from .skew import lookup_join, top_n_per_group

# Fixed values of the line formats and of category ids.
FIELD_SEPARATOR = "------------"
INDEX_SEPARATOR = "#"
DATA_SEPARATOR = ">>>"
PATH_SEPARATOR = "||"
LEVELS = 5
ID_LENGTH = 3
OTHER_ID = 999
EMPTY_LEVEL = "00"
LEVEL_MARK = "##"
LEVEL_FIELDS = [f"level_{i}" for i in range(LEVELS)]


# ---------------------------------------------------------------- lines

def parse_index_line(line) -> Column:
    """SRC-07: ``struct(cate_ids_path, cate_names_path, cate_level_index)``; NULL when malformed."""
    parts = F.split(trim_ws(line), FIELD_SEPARATOR)
    filled = F.filter(F.transform(F.slice(parts, 1, LEVELS), trim_ws), lambda p: p != "")
    ids = F.transform(filled, lambda p: F.trim(F.substring_index(p, INDEX_SEPARATOR, 1)).try_cast("int"))
    names = F.transform(filled, lambda p: F.substr(p, F.instr(p, INDEX_SEPARATOR) + 1))
    index = F.trim(F.get(parts, F.lit(LEVELS))).try_cast("int")
    good = (
        (F.size(parts) == LEVELS + 1)
        & index.isNotNull()
        & F.forall(filled, lambda p: F.contains(p, F.lit(INDEX_SEPARATOR)))
        & F.forall(ids, lambda i: i.isNotNull())
    )
    return F.when(
        good,
        F.struct(ids.alias("cate_ids_path"), names.alias("cate_names_path"), index.alias("cate_level_index")),
    )


def _path(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\|\|"), trim_ws), lambda p: p != "")


def parse_category_link(line, *, with_level: bool = True) -> Column:
    """SRC-08 (and SRC-09 without the level): one link line; NULL when malformed.

    The first ``>>>`` ends the URL part, its last ``--`` the URL, the next ``>`` the limit.
    """
    text = trim_ws(line)
    head = F.regexp_extract(text, r"(?s)\A(.*?)>>>", 1)
    data = F.regexp_extract(text, r"(?s)\A.*?>>>(.*)\z", 1)
    limit = F.trim(F.regexp_extract(data, r"(?s)\A([^>]*)>", 1)).try_cast("int")
    path = _path(F.regexp_extract(data, r"(?s)\A[^>]*>(.*)\z", 1))
    if with_level:
        url = F.regexp_extract(head, r"(?s)\A(.*)--", 1)
        level = F.trim(F.regexp_extract(head, r"(?s)\A.*--(.*)\z", 1)).try_cast("int")
        good = F.contains(head, F.lit("--")) & level.isNotNull()
    else:
        url, level, good = head, F.lit(0), F.lit(True)
    return F.when(
        F.contains(text, F.lit(DATA_SEPARATOR)) & good & limit.isNotNull(),
        F.struct(
            url.alias("url"),
            level.alias("level"),
            limit.alias("limit_cate_level_0_id"),
            F.coalesce(F.get(path, F.size(path) - 1), F.lit("")).alias("cate_name"),
            path.alias("cate_names_path"),
        ),
    )


def parsed_or_error(lines: DataFrame, column: str, parsed: Column, *, strict: bool = True) -> DataFrame:
    """Parsed lines as columns; blank lines are skipped, malformed ones raise or (not strict) drop out."""
    rows = lines.filter(trim_ws(column) != "").withColumn("_p", parsed)
    if strict:
        bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col(column)))
        rows = rows.withColumn("_p", F.when(F.col("_p").isNull(), bad).otherwise(F.col("_p")))
    else:
        rows = rows.filter(F.col("_p").isNotNull())
    return rows.select(*[c for c in lines.columns if c != column], "_p.*")


def format_index_line(ids: Column, names: Column, index: Column) -> Column:
    """The line :func:`parse_index_line` reads."""
    part = lambda i: F.when(
        F.size(ids) > i,
        F.concat(F.lpad(F.get(ids, F.lit(i)).cast("string"), ID_LENGTH, "0"), F.lit("#"), F.get(names, F.lit(i))),
    ).otherwise(" ")
    return F.concat_ws(FIELD_SEPARATOR, *[part(i) for i in range(LEVELS)], index.cast("string"))


# ---------------------------------------------------------------- back-fill

def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-03: keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def backfill_ids(links: DataFrame, index: DataFrame, *, strict: bool = True) -> DataFrame:
    """JN-01: ids path of the index row with the same normalised name path.

    Without a match the job fails, or with ``strict=False`` the ids stay NULL.
    """
    keyed = links.withColumn("_key", path_keys("cate_names_path"))
    lookup = index.groupBy(path_keys("cate_names_path").alias("_key")).agg(
        F.min("cate_ids_path").alias("cate_ids_path"), F.count("*").alias("_n")
    )
    out = lookup_join(keyed.drop("cate_ids_path"), lookup, ["_key"], "left", spread=["url"])
    problem = (
        F.when(F.col("_n") > 1, "category path is not unique: ")
        .when(F.col("_n").isNull(), "category path has no index row: ")
    )
    return _checked(out, problem, "cate_ids_path", strict).drop("_key", "_n")


def backfill_links(links: DataFrame, *, strict: bool = True) -> DataFrame:
    """JN-02: URLs of every prefix of a link's name path, root first.

    What a link gets depends on its name path alone, so every different path asks once for its prefixes, at
    most one per level, and the links are joined with the answer by path. Links may share a URL.
    """
    keyed = links.withColumn("_key", path_keys("cate_names_path"))
    urls = keyed.groupBy("_key").agg(F.min("url").alias("_url"), F.count("*").alias("_n"))
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_path"), F.lit(1))), lambda n: n <= F.size("_path"))
    asks = urls.select(F.col("_key").alias("_path")).select(
        "_path", F.posexplode(F.transform(lengths, lambda n: F.slice(F.col("_path"), F.lit(1), n))).alias("_pos", "_key")
    )
    found = lookup_join(asks, urls, ["_key"], "left")
    paths = found.groupBy("_path").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", F.col("_url").alias("u")))), lambda s: s["u"]
        ).alias("cate_links_path"),
        F.max("_n").alias("_n"),
        F.count_if(F.col("_url").isNull()).alias("_missing"),
    )
    out = keyed.drop("cate_links_path").join(paths, F.col("_key") == F.col("_path"), "left")
    problem = (
        F.when(F.col("_n") > 1, "category path is not unique: ")
        .when(F.col("_missing") > 0, "a prefix of the category path has no link: ")
    )
    out = _checked(out, problem, "cate_links_path", strict)
    return out.drop("_key", "_path", "_n", "_missing")


def _checked(df: DataFrame, problem: Column, result: str, strict: bool) -> DataFrame:
    if strict:
        failed = F.raise_error(F.concat(problem, F.array_join("cate_names_path", "/")))
    else:
        failed = F.lit(None)
    return df.withColumn(result, F.when(problem.isNull(), F.col(result)).otherwise(failed))


# ---------------------------------------------------------------- built links

@dataclass(frozen=True)
class LinkRules:
    """PRJ-18 options."""

    regex: str = ""
    with_text: bool = True
    lower_case: bool = False
    rewrite: bool = False
    rewrite_regex: str = ""
    rewrite_head: str = ""
    add_suffix: bool = False
    suffix: str = ""
    start_gate: bool = False
    low: int = 0
    high: int = 0
    denied: tuple[str, ...] = ()
    inter: str = ""
    default_caption: str = OTHER_CAPTION


def rewrite_url(url, rules: LinkRules) -> Column:
    """PRJ-19."""
    u = col(url)
    if rules.rewrite:
        tail = extract_regex_key(u, rules.rewrite_regex)
        u = F.when(tail != "", F.concat(F.lit(rules.rewrite_head), tail)).otherwise(u)
    if rules.add_suffix:
        u = F.concat(u, F.lit(rules.suffix))
    return trim_ws(u)


def link_line(url, level, limit, caption, names_path, rules: LinkRules) -> Column:
    """PRJ-20."""
    path = col(names_path)
    text = F.when(F.size(path) >= 2, F.array_join(path, PATH_SEPARATOR)).otherwise(col(caption))
    shown, text = (col(level), text) if rules.with_text else (F.lit(0), F.lit(rules.inter))
    return F.concat(
        col(url), F.lit("--"), shown.cast("string"), F.lit(DATA_SEPARATOR), col(limit).cast("string"), F.lit(">"), text
    )


def build_links(
    links: DataFrame, rules: LinkRules, *, level: int | Column = 0, limit: int | Column = -1,
    names_path: Column | None = None,
) -> DataFrame:
    """PRJ-18: normalised links (``url``, ``name``) to built links; rows that fail a gate drop out."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    rows = links.withColumn("url", trim_ws("url")).filter(F.col("url") != "")
    if rules.lower_case:
        rows = rows.withColumn("url", F.lower("url"))
    rows = rows.filter(full_match("url", rules.regex))
    if rules.start_gate:
        rows = rows.filter(start_id_gate("url", low=rules.low, high=rules.high, denied=rules.denied))
    rows = rows.withColumn("url", rewrite_url("url", rules)).filter(F.col("url") != "")
    if rules.with_text:
        caption = clean_caption(
            F.coalesce(F.col("name"), F.lit("")), default=rules.default_caption, prefix=rules.inter
        )
        # Exploding drops navigation captions and cleans each caption once.
        rows = rows.select("*", F.explode(F.array_compact(F.array(caption))).alias("cate_name"))
    else:
        rows = rows.withColumn("cate_name", F.lit(""))
    path = names_path if names_path is not None else F.array().cast("array<string>")
    return rows.withColumns(
        {
            "level": as_col(level),
            "limit_cate_level_0_id": as_col(limit),
            "line": link_line("url", as_col(level), as_col(limit), "cate_name", path, rules),
        }
    )


# ---------------------------------------------------------------- level items

def level_item(path) -> dict[str, Column]:
    """PRJ-21: five level columns of a path, empty ones as ``00``."""
    return {
        name: F.coalesce(F.nullif(F.get(col(path), F.lit(i)), F.lit("")), F.lit(EMPTY_LEVEL))
        for i, name in enumerate(LEVEL_FIELDS)
    }


def repair_levels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-22: ``(repaired, rejected)``; level_0 is required, levels 0-3 get their ``##`` mark."""
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).isin("", EMPTY_LEVEL)

    def marked(c: str) -> Column:
        whole = blank(c) | F.contains(F.col(c), F.lit(LEVEL_MARK))
        return F.when(whole, F.col(c)).otherwise(F.concat(F.col(c), F.lit(LEVEL_MARK + "0")))

    good = df.filter(~blank("level_0")).withColumns({c: marked(c) for c in LEVEL_FIELDS[:4]})
    return good, df.filter(blank("level_0"))


def drop_shared_head(df: DataFrame, path: str) -> DataFrame:
    """AGG-10: strip leading path elements that all rows share, keeping at least one element.

    One aggregate finds the shortest path, a second compares as many prefixes as that path allows.
    """
    shortest = df.agg(F.min(F.size(path)).alias("n")).first()["n"] or 0
    if shortest < 2:
        return df
    prefix = lambda n: F.slice(F.col(path), 1, n)
    facts = df.agg(*[(F.min(prefix(n)) == F.max(prefix(n))).alias(f"s{n}") for n in range(1, shortest)]).first()
    shared = next((n - 1 for n in range(1, shortest) if not facts[f"s{n}"]), shortest - 1)
    return df.withColumn(path, F.slice(F.col(path), F.lit(shared + 1), F.size(path))) if shared else df


# ---------------------------------------------------------------- tree and index

def walk_tree(links: DataFrame, *, key: str, parent: str, name: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """JN-11: ``(placed, rejected)``: level and name path of every row that hangs under a root (``parent`` NULL),
    and the keys of rows that don't: deeper than ``levels``, in a cycle, or below a missing parent.

    Each row climbs to its root, one lookup per level, with keys only; names are joined on the way. Every level
    is written to the shared folder, and rows that have reached their root climb no further.
    """
    parents = links.select(F.col(key).alias("_up"), F.col(parent).alias("_next"), F.col(name).alias("_name"))
    rows = links.select(key, F.col(parent).alias("_up"), F.array(F.col(name)).alias("path"))
    done = rows.filter(F.col("_up").isNull())
    open_ = written(rows.filter(F.col("_up").isNotNull()), "walk-0")
    for level in range(1, levels):
        climbed = lookup_join(open_, parents, ["_up"], "left").select(
            key, F.when(F.col("_name").isNotNull(), F.col("_next")).otherwise(F.col("_up")).alias("_up"),
            F.when(F.col("_name").isNotNull(), F.array_prepend(F.col("path"), F.col("_name"))).otherwise(F.col("path")).alias("path"),
        )
        step = written(climbed, f"walk-{level}")
        done = done.unionByName(step.filter(F.col("_up").isNull()))
        open_ = step.filter(F.col("_up").isNotNull())
    return done.select(key, "path", (F.size("path") - 1).alias("level")), open_.select(key)


def _index_nodes(paths: DataFrame, names_path: str) -> DataFrame:
    """Every path and its prefixes once, with the parent's path and the own name."""
    p = F.col(names_path)
    prefixes = paths.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.slice(p, F.lit(1), n))).alias("_path")
    ).distinct()
    return prefixes.select(
        "_path",
        F.slice("_path", F.lit(1), F.size("_path") - 1).alias("_parent"),
        F.element_at("_path", -1).alias("_name"),
    )


def extend_index(paths: DataFrame, names_path: str, earlier: DataFrame, *, max_ids: int = OTHER_ID - 1) -> DataFrame:
    """WIN-04 over loads: the earlier index with what is new in ``paths`` behind it.

    What ``earlier`` (a result of ``build_index`` or of this) holds keeps its ids and its place. New names follow the
    highest id under their parent, in order of the name; beyond ``max_ids`` they share the "other" id. New paths
    are placed behind the last one. So ids never change, and one load after another gives the same as long as the names come in the same order.
    """
    known = earlier.select(
        F.col("cate_names_path").alias("_path"), F.slice("cate_names_path", F.lit(1), F.size("cate_names_path") - 1).alias("_parent"),
        F.element_at("cate_ids_path", -1).alias("_id"),
    )
    fresh = written(_index_nodes(paths, names_path).join(known.select("_path"), "_path", "left_anti"), "index-nodes")
    tops = known.filter(F.col("_id") != OTHER_ID).groupBy("_parent").agg(F.max("_id").alias("_top"))
    ranked = top_n_per_group(fresh, ["_parent"], [F.col("_name")], max_ids, spread=["_path"], rank="_rank")
    numbered = fresh.join(ranked.select("_path", "_rank"), "_path", "left").join(tops, "_parent", "left")
    number = F.coalesce("_top", F.lit(0)) + F.col("_rank")
    own = written(numbered.select("_path", F.when(number <= max_ids, number).otherwise(F.lit(OTHER_ID)).cast("int").alias("_id")), "index-ids")
    # A new path's prefixes are new, or known: their ids are gathered from both.
    every = own.unionByName(known.select("_path", "_id"))
    wide = own.select("_path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_path")), lambda n: F.slice(F.col("_path"), F.lit(1), n))).alias("_pos", "_prefix"))
    found = lookup_join(wide, every.select(F.col("_path").alias("_prefix"), "_id"), ["_prefix"], "inner", spread=["_path", "_pos"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda s: s["_id"])
    keyed = found.groupBy("_path").agg(ids.alias("cate_ids_path")).select(
        "cate_ids_path", F.col("_path").alias("cate_names_path"), F.array_join("_path", "\x01").alias("_sort")
    )
    first = earlier.agg(F.coalesce(F.max("cate_level_index"), F.lit(-1)).alias("m")).first()["m"] + 1
    added = dense_position(keyed, ["_sort"], "cate_level_index", start=first).drop("_sort")
    return earlier.select(*added.columns).unionByName(added)


def build_index(paths: DataFrame, names_path: str, *, max_ids: int = OTHER_ID - 1) -> DataFrame:
    """WIN-04: ids path and running index of every category path and its prefixes.

    Under each parent the first ``max_ids`` names (by name) are numbered, all
    later ones share the "other" id.
    """
    nodes = written(_index_nodes(paths, names_path), "index-nodes")
    ranked = top_n_per_group(nodes, ["_parent"], [F.col("_name")], max_ids, spread=["_path"], rank="_id")
    numbered = nodes.join(ranked.select("_path", "_id"), "_path", "left").select(
        "_path", F.coalesce("_id", F.lit(OTHER_ID)).cast("int").alias("_id")
    )
    # Ids of all prefixes, gathered back per path: at most five entries each.
    wide = nodes.select(
        "_path",
        F.posexplode(
            F.transform(F.sequence(F.lit(1), F.size("_path")), lambda n: F.slice(F.col("_path"), F.lit(1), n))
        ).alias("_pos", "_prefix"),
    )
    found = lookup_join(
        wide, numbered.select(F.col("_path").alias("_prefix"), "_id"), ["_prefix"], "inner", spread=["_path", "_pos"]
    )
    out = found.groupBy("_path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda s: s["_id"]).alias("cate_ids_path")
    )
    keyed = out.select(
        "cate_ids_path", F.col("_path").alias("cate_names_path"), F.array_join("_path", "\x01").alias("_sort")
    )
    return dense_position(keyed, ["_sort"], "cate_level_index", start=0).drop("_sort")
