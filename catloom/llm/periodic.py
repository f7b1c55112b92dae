"""Runs of periodic words: a harmonic grid of positions, extended by a difference-cover longest-common-extension index."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_with_tasks
from .common import NOT_SPACE, crc32_sql, query, row_blocks, table, text_bytes

ship_with_tasks(__name__)

LEAST_WORDS, LEAST_PERIODS = 6, 4
# A perfect difference set: every residue modulo 31 is the difference of two of these.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
_BLOCK_BYTES = 4 << 20
_CANDIDATES = 1 << 20  # grid positions extended at a time


def _shifts() -> np.ndarray:
    """``[i, j]``: the least step that takes two positions with these residues into the cover together."""
    at = np.zeros((MODULUS, MODULUS), np.int64)
    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    step = np.arange(MODULUS)
    for i in range(MODULUS):
        for j in range(MODULUS):
            at[i, j] = np.flatnonzero(inside[(i + step) % MODULUS] & inside[(j + step) % MODULUS])[0]
    return at


class Extensions:
    """Longest common extensions to the right of pairs of positions of one sequence of codes above 0.

    Only suffixes that start in the difference cover are sorted: first by their next ``MODULUS`` codes, then by
    doubling in steps of whole periods of the cover, ties only. A pair of any positions meets the cover
    after fewer than ``MODULUS`` codes, which are compared one by one; there the least of the neighbours' common prefixes
    between the two ranks, from a sparse table, is the rest.
    """

    _shift = _shifts()

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        # Behind the end nothing is equal to anything: lookups there are cut at the end.
        self.codes = np.concatenate([codes, np.zeros(2 * MODULUS, codes.dtype)])
        rows = -(-(n + MODULUS) // MODULUS)
        self.sample = np.sort((np.arange(rows)[:, None] * MODULUS + np.array(COVER)).ravel())
        self.sample = self.sample[self.sample < n]
        m = len(self.sample)
        self.place = np.full(n + 2 * MODULUS, m, np.int64)
        self.place[self.sample] = np.arange(m)
        # Names of the next 31 codes, code by code, only where all codes before were shared.
        names, alive = np.zeros(m, np.int64), np.arange(m)
        for k in range(MODULUS):
            if not len(alive):
                break
            # New names keep the order of the old: the first place of a name is the number of smaller suffixes.
            names[alive] = self._refined(names[alive], self.codes[self.sample[alive] + k])
            alive = alive[self._tied(names[alive], m)]
        levels, width = [names.copy()], MODULUS
        while len(alive):
            behind = self.sample[alive] + width
            other = np.where(behind < n, names[np.minimum(self.place[np.minimum(behind, n)], m - 1)] + 1, 0)
            names[alive] = self._refined(names[alive], other)
            alive = alive[self._tied(names[alive], m)]
            width *= 2
            levels.append(names.copy())
        self.rank = np.concatenate([names, [m]])
        order = np.empty(m, np.int64)
        order[names] = np.arange(m)
        self.table = self._sparse(self._neighbours(order, levels))

    @staticmethod
    def _refined(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """New names of tied suffixes: the old name plus how many of the tie have smaller keys."""
        order = np.lexsort((keys, names))
        a, b = names[order], keys[order]
        here = np.arange(len(order))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], a[1:] != a[:-1]]), here, 0))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]), here, 0))
        out = np.empty(len(order), np.int64)
        out[order] = a + first - group
        return out

    @staticmethod
    def _tied(names: np.ndarray, m: int) -> np.ndarray:
        return np.bincount(names, minlength=m)[names] > 1

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of suffixes that are neighbours in the order, by descending the doubled names."""
        m = len(order)
        a, b = self.sample[order[:-1]].copy(), self.sample[order[1:]].copy()
        lcp = np.zeros(max(m - 1, 0), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            name, width = np.concatenate([levels[level], [-1, -2]]), MODULUS << level
            x = np.where(a < self.n, self.place[np.minimum(a, self.n)], m)
            y = np.where(b < self.n, self.place[np.minimum(b, self.n)], m + 1)
            same = (name[np.minimum(x, m)] == name[np.minimum(y, m + 1)]) & (x < m) & (y < m)
            lcp += same * width
            a, b = a + same * width, b + same * width
        alive = np.arange(len(lcp))
        while len(alive):
            alive = alive[(a[alive] < self.n) & (b[alive] < self.n)]
            alive = alive[self.codes[a[alive]] == self.codes[b[alive]]]
            lcp[alive] += 1
            a[alive] += 1
            b[alive] += 1
        return lcp

    @staticmethod
    def _sparse(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes from ``i`` and from ``j`` on are equal, for arrays of different positions up to the end."""
        out = np.zeros(len(i), np.int64)
        step = self._shift[i % MODULUS, j % MODULUS]
        alive = np.arange(len(i))
        for k in range(MODULUS):
            if not len(alive):
                return out
            x, y = i[alive] + k, j[alive] + k
            going = (k < step[alive]) & (np.maximum(x, y) < self.n) & (self.codes[x] == self.codes[y])
            arrived = (k == step[alive]) & (np.maximum(x, y) < self.n)
            if arrived.any():
                at = alive[arrived]
                out[at] = k + self._sampled(x[arrived], y[arrived])
            out[alive[going]] = k + 1
            alive = alive[going]
        return out

    def _sampled(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.rank[self.place[x]], self.rank[self.place[y]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            on = level == k
            row = self.table[k]
            out[on] = np.minimum(row[low[on]], row[high[on] - (1 << int(k))])
        return out


def find_runs(codes: np.ndarray, borders: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """All runs of texts whose codes lie back to back, as rows ``(text, start in the text, length, smallest period)`` in this order.

    A run of period ``p`` and at least ``periods * p`` codes holds ``periods - 1`` pairs of neighbours on the grid
    0, p, 2p, ...; only where so many pairs in a row are equal, its extent is looked up to both sides. All periods
    together have n log n grid positions. ``periods`` is at least 2.
    """
    if periods < 2:
        raise ValueError("a run has at least two periods")
    padded, ends = _apart(codes, borders)
    grid, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(1, int(np.diff(borders).max(initial=0)) // periods + 1):
        on = padded[::p]
        pairs = on[1:] == on[:-1]
        several = pairs
        for k in range(1, periods - 1):
            several = several[:-1] & pairs[k:]
        grid.append(np.flatnonzero(several) * p)
        period.append(np.full(len(grid[-1]), p, np.int64))
    grid, period = np.concatenate(grid), np.concatenate(period)
    # Words can be equal across texts; a run's pairs lie in one.
    text = np.searchsorted(ends, grid)
    inside = grid + (periods - 1) * period < ends[text]
    grid, period, text = grid[inside], period[inside], text[inside]
    found = [np.zeros((0, 4), np.int64)]
    if len(grid):
        # The index is built over the texts that have candidates.
        own, text = np.unique(text, return_inverse=True)
        some, some_borders = _taken(codes, borders, own)
        grid += (some_borders[:-1] + np.arange(len(own)) - (borders[own] + own))[text]
        padded, _ = _apart(some, some_borders)
        ahead, behind, n = Extensions(padded), Extensions(padded[::-1].copy()), len(padded)
        heads = some_borders[:-1] + np.arange(len(own))
        for a in range(0, len(grid), _CANDIDATES):
            g, p, t = (x[a : a + _CANDIDATES] for x in (grid, period, text))
            start = g - behind.common(n - g, n - g - p)
            length = g + p + ahead.common(g, g + p) - start
            rows = np.stack([own[t], start - heads[t], length, p], 1)[length >= np.maximum(least, periods * p)]
            # Candidates of one run lie side by side.
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(1)
            found.append(rows[fresh])
    rows = np.unique(np.concatenate(found), axis=0)
    # Multiples of a period give the same stretch; the smallest comes first.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[first]


def _apart(codes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a code of its own behind each, so that nothing is equal across texts; and where these codes are."""
    sizes = np.diff(borders)
    out = np.empty(len(codes) + len(sizes), np.int64)
    ends = borders[1:] + np.arange(len(sizes))
    out[ends] = int(codes.max(initial=0)) + 2 + np.arange(len(sizes))
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = codes + 1
    return out, ends


def _taken(codes: np.ndarray, borders: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(borders)
    wanted = np.zeros(len(sizes), bool)
    wanted[own] = True
    return codes[np.repeat(wanted, sizes)], np.concatenate([[0], np.cumsum(sizes[own])])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one column, and the borders of the texts in it."""
    data, borders = text_bytes(texts)
    data = np.insert(data, borders[1:-1], 32)
    borders = borders + np.minimum(np.arange(len(borders)), max(len(borders) - 2, 0))
    inside = NOT_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    column = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return column, np.concatenate([[0], np.searchsorted(starts, borders[1:])])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs_of(texts: pa.Array, least: int, periods: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    column, borders = _words(texts)
    codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(codes, borders, least, periods)
    change = np.zeros(len(codes) + 1, np.int64)
    at = borders[runs[:, 0]] + runs[:, 1]
    np.add.at(change, at + runs[:, 3], 1)
    np.add.at(change, at + runs[:, 2], -1)
    keep = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(keep)])[borders].astype(np.int32)
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), column.filter(pa.array(keep))), " ")
    heads = np.searchsorted(runs[:, 0], np.arange(len(borders))).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
    return pa.array(np.diff(borders)), pa.ListArray.from_arrays(pa.array(heads), rows), kept


def _finder(least: int, periods: int):
    @F.arrow_udf("struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def find(texts: pa.Array) -> pa.Array:
        parts = [[pa.array([], pa.int64())], [pa.array([], pa.list_(_RUN))], [pa.array([], pa.string())]]
        for a, b in row_blocks(text_bytes(texts)[1], _BLOCK_BYTES):
            for part, column in zip(parts, _runs_of(texts.slice(a, b - a), least, periods), strict=True):
                part.append(column)
        return pa.StructArray.from_arrays([pa.concat_arrays(p) for p in parts], names=["n_words", "runs", "collapsed"])

    return find.asNondeterministic()


def periodic_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, name: str = "found") -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words``, ``runs`` and ``collapsed`` of each whole text.

    Words are what stands between ASCII white space. A run is a stretch of words with smallest period ``p`` and at least
    ``max(least, periods * p)`` words that no neighbouring word extends; runs are sorted by start, then period. ``collapsed``
    has the words that no run repeats, joined by a space: each run keeps its first period. Null and empty texts
    have no words, no runs and an empty ``collapsed``. Every row is judged alone, so order, ties and repeated rows
    don't matter; a column called ``name`` is replaced. A task holds 4 MB of text at a time, or one longer text.
    """
    return docs.withColumn(name, _finder(least, periods)(F.col(text)))


@F.arrow_udf(T.StringType())
def planted(texts: pa.Array, keys: pa.Array) -> pa.Array:
    """The text with every word from place ``a`` on replaced by one of the ``p`` words there, for one key in ten.

    ``a`` and ``p`` come from the crc32 of the key's text; other texts, and texts without words, stay as they are.
    """
    out = []
    for text, key in zip(texts, keys, strict=True):
        h = crc32(str(key.as_py() or "").encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", text.as_py() or "") if h % 10 == 0 else []
        if words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out.append(" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]))
        else:
            out.append(text.as_py())
    return pa.array(out, pa.string())


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


OP11_SQL = r"""
with given as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {crc} as h from documents),
numbers as (select doc_id, w, len(w) as n, h, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from given),
planted as (select *, 1 + (n - a) // (3 + g % 8) as p from numbers),
tok as (
    select doc_id, i, n, w[1 + case when h % 10 = 0 and i >= a then a + (i - a) % p else i end] as word
    from (select doc_id, w, n, h, a, p, unnest(range(n)) as i from planted)),
-- Periods with three pairs of equal neighbours in a row on their grid.
grid as (
    select doc_id, p, unnest(range((n - 1) // p)) as k
    from (select doc_id, n, unnest(range(1, n // 4 + 1)) as p from numbers)),
pairs as (
    select doc_id, p, k from grid join tok x using (doc_id) join tok y using (doc_id)
    where x.i = k * p and y.i = (k + 1) * p and x.word = y.word),
periods as (
    select distinct doc_id, p
    from (select doc_id, p, k, lead(k, 2) over (partition by doc_id, p order by k) as third from pairs) where third = k + 2),
same as (select doc_id, p, x.i from periods join tok x using (doc_id) join tok y using (doc_id) where y.i = x.i + p and x.word = y.word),
islands as (
    select doc_id, p, min(i) as start, count(*) + p as length
    from (select *, i - row_number() over (partition by doc_id, p order by i) as island from same) group by doc_id, p, island),
runs as (select doc_id, start, length, min(p) as p from islands where length >= greatest(6, 4 * p) group by doc_id, start, length),
listed as (
    select doc_id, count(*) as n, string_agg(start || ',' || length || ',' || p || chr(10), '' order by start, p) as l,
           min(struct_pack(a := -length, b := start, c := p)) as best from runs group by doc_id),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(start + p, start + length)) as i from runs)),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from tok anti join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(l.n, 0) as n_runs, cast(best.b as bigint) as start, cast(-best.a as bigint) as length, cast(best.c as bigint) as period,
       cast(1000 * -best.a // best.c as bigint) as exponent_milli, sha256(coalesce(l.l, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from given left join listed l using (doc_id) left join kept using (doc_id)""".replace("{crc}", crc32_sql("cast(doc_id as varchar)"))


@query("op11_periodic_runs", OP11_SQL)
def op11(spark, sf):
    """Every document with its longest run and digests of all runs and of the collapsed text."""
    docs = table(spark, sf, "documents").select("doc_id", planted("text", F.col("doc_id").cast("string")).alias("text"))
    found = periodic_runs(docs).select("doc_id", "found.*")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        _digest(F.array_join(listed, "")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
