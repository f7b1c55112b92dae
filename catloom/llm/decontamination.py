"""Benchmark decontamination: suffix arrays of the training words, searched for every suffix of the test items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_with_tasks
from .common import ALPHANUMERIC, BYTE_CODES_LOWER, query, row_blocks, table, text_bytes, words

ship_with_tasks(__name__)

WINDOW = 10
# Items are searched in blocks of about this many bytes; each block is broadcast, so this is its bound.
ITEM_BYTES = 8 << 20
# A shard has at most this many training words, so positions fit in 20 bits of a sort key.
SHARD_WORDS = 1 << 18
_TEXT_BYTES = 1 << 20
_FOUND = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"


@dataclass
class TestItems:
    """The suffixes of a block of test items, cut to what a window needs."""

    vocabulary: np.ndarray  # sorted hashes of the items' words; a word's id is its place here plus 1
    spelled: list[bytes]  # the words themselves, in the same order
    windows: np.ndarray  # one row of word ids for each different window, 0 behind its end
    lengths: np.ndarray
    items: list[str]
    holders: np.ndarray  # items of window i: holders[holder_at[i]:holder_at[i + 1]]
    holder_at: np.ndarray

    @staticmethod
    def build(rows: list[tuple[str, str]], width: int) -> TestItems:
        names = [name for name, _ in rows]
        data, borders = text_bytes(pa.array([text for _, text in rows], pa.string()))
        starts, ends, row, hashes = words(data, borders, ALPHANUMERIC, BYTE_CODES_LOWER)
        vocabulary, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        spelled = [raw[starts[i] : ends[i]].lower() for i in first]
        ids, holders = ids + 1, {}
        for i, name in enumerate(names):
            a, b = np.searchsorted(row, [i, i + 1])
            own = ids[a:b].tolist()
            for k in range(max(len(own) - width, 0) + 1 if own else 0):
                holders.setdefault(tuple(own[k : k + width]), {})[i] = None
        windows = np.zeros((len(holders), width), np.int64)
        for i, w in enumerate(holders):
            windows[i, : len(w)] = w
        at = np.cumsum([0] + [len(x) for x in holders.values()])
        return TestItems(vocabulary, spelled, windows, (windows > 0).sum(1), names, np.array([i for x in holders.values() for i in x], np.int64), at)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard that begin with a word of the test items, sorted by their first ``depth`` words.

    Prefix doubling: ranks by one word, then two, four and so on. ``left`` has the words up to the
    end of the text, past which a suffix is empty and sorts first. A sort key holds both ranks and
    the position, so each step is one plain sort of 64-bit numbers.
    """
    at, rank, step = np.flatnonzero(ids), ids.copy(), 1
    order = at[np.argsort(rank[at], kind="stable")]
    low = np.uint64((1 << 20) - 1)
    while step < depth and len(at):
        follows = np.where(left[at] > step, rank[np.minimum(at + step, len(ids) - 1)], 0)
        keys = (rank[at].astype(np.uint64) << np.uint64(42)) | (follows.astype(np.uint64) << np.uint64(20)) | np.arange(len(at), dtype=np.uint64)
        keys.sort()
        order = at[(keys & low).astype(np.int64)]
        pair = keys >> np.uint64(20)
        rank[order] = np.cumsum(np.concatenate([[True], pair[1:] != pair[:-1]]))
        step *= 2
    return order


def _compare(ids: np.ndarray, left: np.ndarray, at: np.ndarray, windows: np.ndarray, lengths: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sign of the suffix at each place against a window; 0 if the suffix begins with it."""
    sign, open_ = np.zeros(len(at), np.int8), np.flatnonzero(live)
    for j in range(windows.shape[1]):
        open_ = open_[lengths[open_] > j]
        if not len(open_):
            break
        p = at[open_]
        mine = np.where(left[p] > j, ids[np.minimum(p + j, len(ids) - 1)], 0)
        theirs = windows[open_, j]
        sign[open_] = np.sign(mine - theirs)
        open_ = open_[mine == theirs]
    return sign


def search(ids: np.ndarray, left: np.ndarray, array: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the windows in a shard: position and window of each, by binary search."""
    n = len(items.windows)

    def bound(past: int, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(array), np.int64)
        while (live := low < high).any():
            mid = (low + high) >> 1
            less = _compare(ids, left, array[np.minimum(mid, len(array) - 1)], windows, lengths, live) < past
            low = np.where(live & less, mid + 1, low)
            high = np.where(live & ~less, mid, high)
        return low

    if not len(array) or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = bound(0, items.windows, items.lengths)
    there = first < len(array)
    there[there] = _compare(ids, left, array[first[there]], items.windows[there], items.lengths[there], np.ones(int(there.sum()), bool)) == 0
    which = np.flatnonzero(there)
    count = bound(1, items.windows[which], items.lengths[which]) - first[which]
    window = np.repeat(which, count)
    run = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    return array[np.repeat(first[which], count) + run], window


def _shard_hits(raw: bytes, starts, ends, ids, left, items: TestItems, width: int) -> tuple[np.ndarray, np.ndarray]:
    while True:
        at, window = search(ids, left, suffix_array(ids, left, width), items)
        covered = np.zeros(len(ids) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + items.lengths[window], -1)
        hit = np.flatnonzero(np.cumsum(covered[:-1]))
        # The words of all matches are compared letter by letter.
        wrong = [p for p in hit.tolist() if raw[starts[p] : ends[p]].lower() != items.spelled[ids[p] - 1]]
        if not wrong:
            return at, window
        ids[wrong] = 0


def find(text: pa.Array, items: TestItems, width: int) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Per text: number of words, borders of the hit runs (start, end, start, end ...), ids of the items found."""
    n = len(text)
    counts, runs, found = np.zeros(n, np.int64), [np.zeros(0, np.int64)] * n, [[] for _ in range(n)]
    data, borders = text_bytes(text)
    for a, b in row_blocks(borders, _TEXT_BYTES):
        own = borders[a : b + 1] - borders[a]
        part = data[borders[a] : borders[b]]
        starts, ends, row, hashes = words(part, own, ALPHANUMERIC, BYTE_CODES_LOWER)
        counts[a:b] = np.bincount(row, minlength=b - a)
        if not len(row) or not len(items.vocabulary):
            continue
        place = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
        ids = np.where(items.vocabulary[place] == hashes, place + 1, 0)
        text_end = np.cumsum(counts[a:b])
        left = text_end[row] - np.arange(len(row))
        raw, ats, windows = part.tobytes(), [], []
        for s in range(0, len(ids), SHARD_WORDS - width):
            e = min(s + SHARD_WORDS, len(ids))
            at, window = _shard_hits(raw, starts[s:e], ends[s:e], ids[s:e].copy(), np.minimum(left[s:e], e - s - np.arange(e - s)), items, width)
            ats.append(at + s)
            windows.append(window)
        at, window = np.concatenate(ats), np.concatenate(windows)
        if not len(at):
            continue
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + items.lengths[window], -1)
        hit = np.cumsum(change[:-1]) > 0
        # Runs end at the borders of texts.
        begins = hit & ~np.concatenate([[False], hit[:-1]]) | hit & (np.concatenate([[-1], row[:-1]]) != row)
        stops = hit & ~np.concatenate([hit[1:], [False]]) | hit & (np.concatenate([row[1:], [-1]]) != row)
        text_start = text_end - counts[a:b]
        from_, to = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        of = row[from_]
        bounds = np.stack([from_ - text_start[of], to - text_start[of]], 1).ravel()
        for i in np.unique(of).tolist():
            x, y = np.searchsorted(of, [i, i + 1])
            runs[a + i] = bounds[2 * x : 2 * y]
        pairs = np.unique(row[at] * len(items.windows) + window)
        of, window = pairs // len(items.windows), pairs % len(items.windows)
        size = items.holder_at[window + 1] - items.holder_at[window]
        each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(items.holder_at[window], size)
        for i, k in np.unique(np.stack([np.repeat(of, size), items.holders[each]], 1), axis=0).tolist():
            found[a + i].append(items.items[k])
    return counts, runs, found


def _merged(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _searcher(block, width: int):
    @F.arrow_udf(_FOUND)
    def search_block(text: pa.Array, before: pa.Array) -> pa.Array:
        counts, runs, found = find(text, TestItems(**block.value), width)
        out = []
        for n, run, items, old in zip(counts.tolist(), runs, found, before.to_pylist(), strict=True):
            spans = list(zip(run[::2].tolist(), run[1::2].tolist(), strict=True))
            if old is not None:
                spans, items = spans + list(zip(old["starts"], old["ends"], strict=True)), items + old["items"]
            merged = _merged(spans)
            out.append({"n_words": n, "starts": [s for s, _ in merged], "ends": [e for _, e in merged], "items": sorted(set(items))})
        kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        return pa.array(out, kind)

    return search_block.asNondeterministic()


def contamination(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = ITEM_BYTES
) -> DataFrame:
    """``docs`` plus ``found``: words of the text, the longest verbatim runs shared with test items
    as word positions ``[start, end)``, and the ids of those items.

    A window is ``width`` consecutive words of an item, or the whole item if it has fewer; a run is a
    stretch of words that windows cover. Words are lower-cased (A-Z) and split at ASCII characters that are
    no letters or digits. Null texts have no words; items without words match nothing; a null item id
    is written ''. A column ``found`` of ``docs`` is replaced. Items without rows find nothing.

    Documents stay where they are: every task sorts suffix arrays of its own texts, a shard of at most
    ``SHARD_WORDS`` words at a time. The items are checked for their size and come in blocks of about
    ``block_bytes``, each broadcast and searched in turn.
    """
    spark = docs.sparkSession
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(item_text, F.lit("")).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    out = docs.withColumn("found", F.lit(None).cast(_FOUND))
    for block in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        index = TestItems.build([(r["id"], r["text"]) for r in part.toLocalIterator()], width)
        out = out.withColumn("found", _searcher(spark.sparkContext.broadcast(vars(index)), width)(F.col(text), F.col("found")))
    return out


def hit_words(found: Column) -> Column:
    """Number of words in the runs."""
    lengths = F.zip_with(found["ends"], found["starts"], lambda e, s: e - s)
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, b: a + b)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of any test item occurs, columns as in ``docs``."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(options.get("text", "text")).alias("_text"))
    clean = contamination(row, items, **(options | {"text": "_text"})).filter(F.size(F.col("found")["starts"]) == 0)
    return clean.select("_row.*")


OP2_SQL = r"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (
    select distinct item_id, least(len(w), 10) as m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') as win
    from (select *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as k from b where len(w) > 0)),
sizes as (select distinct m from wins),
grams as (
    select doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') as win
    from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d, sizes where len(w) >= m)),
hits as (select doc_id, k, m, item_id from grams join wins using (m, win)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + m)) as p from (select distinct doc_id, k, m from hits)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join named using (doc_id)"""


@query("op2_decontaminate", OP2_SQL)
def op2(spark, sf):
    """Every document with its words, its words hit by benchmark windows, and the items found in it."""
    found = F.col("found")
    hit = hit_words(found)
    return contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")).select(
        "doc_id", found["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found["items"]), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
