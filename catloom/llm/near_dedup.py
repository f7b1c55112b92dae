"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Shelf, ship_with_tasks, written
from .common import BYTE_CODES_LOWER, NOT_SPACE, mixed, powers, query, row_blocks, table, text_bytes, words
from .components import components

ship_with_tasks(__name__)

SIMILAR = 80  # per cent
BANDS, ROWS = 40, 5  # a pair at the threshold misses all bands with a chance of 1.2e-7
BATCH = 20  # signature values compared at a time
MISS = 1e-7  # posterior chance of a link below which a pair is dropped
# Ids of documents to be confirmed are broadcast up to this many; beyond it the join shuffles.
MOST_IDS = 1_000_000
_SIZE = BANDS * ROWS
_TEXT_BYTES = 512 << 10
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, _SIZE, np.uint32)
_MULTIPLY = _rng.integers(0, 2**32, _SIZE, np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array, width: int):
    """Yields the sorted distinct shingle hashes of every text, as ``(first row, values, borders)`` per block of rows.

    A shingle is ``width`` consecutive words; a text with fewer words has all of them as its one shingle.
    """
    data, borders = text_bytes(column)
    power = powers(width + 1)
    for a, b in row_blocks(borders, _TEXT_BYTES):
        _, _, row, hashes = words(data[borders[a] : borders[b]], borders[a : b + 1] - borders[a], NOT_SPACE, BYTE_CODES_LOWER)
        count = np.bincount(row, minlength=b - a)
        end = np.cumsum(count)
        here = np.arange(len(row))
        left = end[row] - here
        code = np.zeros(len(row), np.uint64)
        for j in range(width):
            follows = hashes[np.minimum(here + j, len(row) - 1)]
            code += np.where(left > j, follows * power[j + 1], np.uint64(0))
        code = mixed(code)
        whole = (left >= width) | ((count[row] < width) & (left == count[row]))
        sizes = np.bincount(row[whole], minlength=b - a)
        at = np.concatenate([[0], np.cumsum(sizes)])
        kept = code[whole]
        sets = [np.unique(kept[x:y]) for x, y in zip(at, at[1:], strict=False)]
        yield a, np.concatenate(sets) if sets else kept, np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def signatures(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sixteen bits of each of the ``BANDS * ROWS`` smallest hashes of every set; empty sets have zeros."""
    filled = np.flatnonzero(borders[1:] > borders[:-1])
    out = np.zeros((len(borders) - 1, _SIZE), np.uint16)
    if len(filled):
        short, heads = (values >> np.uint64(32)).astype(np.uint32), borders[:-1][filled]
        for k in range(_SIZE):
            out[filled, k] = np.minimum.reduceat((short ^ _XOR[k]) * _MULTIPLY[k], heads).astype(np.uint16)
    return out


def _binaries(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column from its bytes back to back."""
    borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(borders), pa.py_buffer(data)])


def _digests(values: np.ndarray, borders: np.ndarray) -> bytes:
    """A digest of 16 bytes for each set."""
    return b"".join(hashlib.blake2b(values[x:y].tobytes(), digest_size=16).digest() for x, y in zip(borders, borders[1:], strict=False))


def _signer(width: int):
    @F.arrow_udf("struct<n:bigint,same:binary,signature:binary>")
    def sign(text: pa.Array) -> pa.Array:
        sizes, same, signed = [np.zeros(0, np.int64)], [], []
        for _, values, borders in shingle_sets(text, width):
            sizes.append(np.diff(borders))
            same.append(_digests(values, borders))
            signed.append(signatures(values, borders).tobytes())
        n = np.concatenate(sizes)
        columns = [pa.array(n), _binaries(b"".join(same), np.full(len(n), 16)), _binaries(b"".join(signed), np.full(len(n), 2 * _SIZE))]
        return pa.StructArray.from_arrays(columns, names=["n", "same", "signature"])

    return sign.asNondeterministic()


def _shingles(width: int):
    @F.arrow_udf("array<bigint>")
    def make(text: pa.Array) -> pa.Array:
        sizes, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for _, values, borders in shingle_sets(text, width):
            sizes.append(np.diff(borders))
            sets.append(values)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))

    return make.asNondeterministic()


def _set_maker(width: int):
    @F.arrow_udf("struct<same:binary,set:binary>")
    def make(text: pa.Array) -> pa.Array:
        sizes, same, sets = [np.zeros(0, np.int64)], [], []
        for _, values, borders in shingle_sets(text, width):
            sizes.append(np.diff(borders))
            same.append(_digests(values, borders))
            sets.append(values.tobytes())
        n = np.concatenate(sizes)
        return pa.StructArray.from_arrays([_binaries(b"".join(same), np.full(len(n), 16)), _binaries(b"".join(sets), 8 * n)], names=["same", "set"])

    return make.asNondeterministic()


def least_matches(size: int, batch: int, similar: int, miss: float) -> tuple[tuple[int, int], ...]:
    """After each batch of signature values, the least number of equal ones with which a pair goes on.

    With an even prior, the similarity after ``m`` equal values of ``n`` follows Beta(m + 1, n - m + 1), so it reaches
    ``t`` with the chance that a binomial of ``n + 1`` trials at ``t`` is at most ``m``. Pairs go on while that chance is above ``miss``.
    """
    t, out = similar / 100, []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, -1
        while total <= miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def _pruner(similar: int, miss: float):
    steps = least_matches(_SIZE, BATCH, similar, miss)

    @F.arrow_udf("boolean")
    def goes_on(one: pa.Array, other: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(x.buffers()[2], np.uint16)[x.offset * _SIZE :][: len(x) * _SIZE].reshape(-1, _SIZE) for x in (one, other))
        alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
        for n, least in steps:
            equal[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
            alive, done = alive[equal[alive] >= least], n
        out = np.zeros(len(a), bool)
        out[alive] = True
        return pa.array(out)

    return goes_on.asNondeterministic()


def _confirmer(similar: int):
    @F.arrow_udf("boolean")
    def linked(one: pa.Array, other: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one, other, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
            out.append(bool(len(small)) and 100 * both >= similar * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return linked.asNondeterministic()


class NearDuplicates:
    """Links between documents whose shingle sets have a Jaccard similarity of at least ``similar`` per cent.

    Null and empty texts and texts without words have empty sets and are linked with nothing; rows without
    an id take no part. Rows that share an id count as one document, linked with whatever any of them is.

    Documents with the same set form a class, of which only the smallest id goes on. In every bucket of a band
    the members are compared with one leader at a time, so a bucket of many copies costs its size, not its
    square. Members already in one component need no comparison. What is left, pairs of different components that share a
    bucket and were not compared with a leader, is settled by differences from a pivot, see ``_across``, so no link
    that shares a band is lost.
    """

    def __init__(self, docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = 5, similar: int = SIMILAR, miss: float = MISS):
        self.docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        self.width, self.similar, self.miss = width, similar, miss
        signed = self.docs.withColumn("_s", _signer(width)("text")).select("id", "_s.*")
        self.signed = written(signed, "signatures")
        ids = self.signed.filter("n > 0 and id is not null")
        firsts = ids.groupBy("same").agg(F.min("id").alias("id"))
        self.members = ids.select("id", "same").join(firsts.withColumnRenamed("id", "first"), "same").select("id", "first")
        self.classes = written(ids.join(firsts, ["same", "id"]).dropDuplicates(["same"]), "classes")
        bands = [F.xxhash64(F.substring("signature", 2 * ROWS * b + 1, 2 * ROWS), F.lit(b)) for b in range(BANDS)]
        rows = self.classes.select("id", F.explode(F.array(*bands)).alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("leader")).filter("size > 1")
        self.buckets = written(rows.join(shared, "bucket"), "buckets")

    def links(self) -> DataFrame:
        """Confirmed links ``(a, b)`` between the first ids of classes; they connect whatever all links connect."""
        found = self._confirmed(self.buckets.select(F.col("leader").alias("a"), F.col("id").alias("b")))
        # Buckets of two are settled; in others, whoever isn't with the leader now may be linked to the rest.
        rooted = self._rooted(self.buckets.filter("size > 2"), components(found))
        split = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
        rest = written(rooted.join(split, "bucket").filter("id <> leader").select("bucket", "id", "root"), "rest")
        # A second leader for each bucket settles most of what is left before pairs are made.
        second = rest.groupBy("bucket").agg(F.min("id").alias("a"), F.min_by("root", "id").alias("of"))
        more = self._confirmed(rest.join(second, "bucket").filter("root <> of").select("a", F.col("id").alias("b")))
        found = written(found.unionByName(more), "links")
        left = written(self._rooted(rest.drop("root"), components(found)), "left")
        return self._across(left, found)

    def _across(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """Links between members of different components that share a bucket, of rows ``(bucket, id, root)``.

        The root of a bucket's largest component is its pivot, and buckets with one pivot are taken together. Of each member only
        the difference from the pivot goes on: the shingles that one of the two sets has and the other lacks. Two sets are linked
        if the symmetric difference of their differences is small enough, so each member that is linked with its pivot is known at
        once, and two members, one of which at least is not, must have many differences in common. In one order, rarest first, they then
        share one of the first differences of either. Copies that were changed at random have few differences in common, most are
        their own, so a family of copies makes no pairs however many of them are not quite similar enough.
        """
        shelf = Shelf(rows.sparkSession)
        sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("k"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root"))["root"].alias("pivot"), F.count("*").alias("roots")).filter("roots > 1").select("bucket", "pivot")
        members = shelf.put(rows.join(main, "bucket").select("pivot", "id").distinct(), "members")
        deltas = shelf.put(self._differences(members), "deltas")
        direct = shelf.put(deltas.filter("near and id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "direct")
        found = links.unionByName(direct)
        rooted = self._rooted(deltas, components(found))
        split = rooted.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("pivot")
        open_ = shelf.put(rooted.join(split, "pivot"), "open")
        more = self._confirmed(self._common_differences(open_))
        out = written(found.unionByName(more), "links")
        shelf.clear()
        return out

    def _differences(self, members: DataFrame) -> DataFrame:
        """``(pivot, id, same, n, of, d, near)`` of members ``(pivot, id)``: the sizes of both sets, their difference, and whether they are linked."""
        ids = members.select("id").unionByName(members.select(F.col("pivot").alias("id"))).distinct()
        # Rows that repeat an id have sets of their own; for a pivot any of them will do.
        ids = written(ids, "ids")
        texts = self.docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "id")
        sets = texts.select("id", F.xxhash64("text").alias("same"), _shingles(self.width)("text").alias("s")).dropDuplicates(["id", "same"])
        sets = written(sets.filter(F.size("s") > 0), "sets")
        pivots = sets.groupBy(F.col("id").alias("pivot")).agg(F.min_by("s", "same").alias("p"))
        met = members.join(sets, "id").join(pivots, "pivot")
        d = F.concat(F.array_except("s", "p"), F.array_except("p", "s"))
        n, of = F.size("s"), F.size("p")
        out = met.select("pivot", "id", "same", n.cast("bigint").alias("n"), of.cast("bigint").alias("of"), d.alias("d"))
        both = F.col("n") + F.col("of")
        return out.withColumn("near", 100 * (both - F.size("d")) >= self.similar * (both + F.size("d")))

    def _common_differences(self, rows: DataFrame) -> DataFrame:
        """Pairs ``(a, b)`` of rows ``(pivot, id, same, root, n, of, d, near)`` of different roots that can be linked.

        Sets x and y of sizes n and m are linked if their differences dx and dy have at least ``(|dx| + |dy| - k (n + m)) / 2`` shingles
        in common, where ``k = (100 - similar) / (100 + similar)``. Two that are near the pivot are in its component. If x is not near,
        ``|dx| > k (n + |p|)``, so more than ``(|dy| + k (|p| - m)) / 2`` are in common, about half of dy; and as ``|dy| >= |m - |p||``,
        at least ``(|dx| - k (n + |p|)) / 2``. Sets with so many in common share one of the first ``|d| - common + 1``. What only
        one member has is counted, not listed. Where the first shared one stands, enough others must be left behind it in both.
        """
        part, whole = 100 - self.similar, 100 + self.similar
        name = ["pivot", "id", "same"]
        tokens = rows.select(*name, F.explode("d").alias("t"))
        shared = tokens.groupBy("pivot", "t").agg(F.count("*").alias("df")).filter("df > 1")
        lists = tokens.join(shared, ["pivot", "t"]).groupBy(*name).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("list"))
        size = F.size("d").cast("bigint")
        half = F.greatest(F.floor((size * whole + part * (F.col("of") - F.col("n"))) / (2 * whole)) + 1, F.lit(1))
        least = F.greatest(F.ceil((size * whole - part * (F.col("of") + F.col("n"))) / (2 * whole)), F.lit(1))
        sized = rows.withColumns({"size": size, "short": size - half + 1, "long": size - least + 1}).drop("d").join(lists, name)
        alone = F.col("size") - F.size("list")
        # A member near the pivot meets those that are not; they meet each other too.
        longest = F.when(F.col("near"), F.col("short")).otherwise(F.greatest("long", "short"))
        first = F.slice("list", F.lit(1), F.greatest(longest - alone, F.lit(0)).cast("int"))
        listed = sized.select("pivot", "id", "root", "n", "size", "near", "short", alone.alias("alone"), F.posexplode(first).alias("at", "e"))
        placed = written(listed.select("pivot", F.col("e.t").alias("t"), "id", "root", "n", "size", "near", "short", (F.col("alone") + F.col("at")).alias("at")), "placed")
        far = placed.filter("not near").select("pivot", "t", *[F.col(c).alias(f"{c}_a") for c in ("id", "root", "n", "size", "short", "at")])
        other = F.col("near") | (F.col("at_a") < F.col("short_a")) & (F.col("at") < F.col("short")) & (F.col("id_a") < F.col("id"))
        left = F.least(F.col("size_a") - F.col("at_a"), F.col("size") - F.col("at"))
        enough = whole * (F.col("size_a") + F.col("size") - 2 * left) <= part * (F.col("n_a") + F.col("n"))
        pairs = far.join(placed, ["pivot", "t"]).filter((F.col("root") != F.col("root_a")) & other & enough)
        return pairs.select(F.col("id_a").alias("a"), F.col("id").alias("b"))

    @staticmethod
    def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        joined = rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
        return joined.withColumn("root", F.coalesce("root", "id"))

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs those that are links, after pruning by their signatures."""
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one, two = (
            self.classes.select(F.col("id").alias(k), F.col("same").alias(f"same_{k}"), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"s_{k}"))
            for k in ("a", "b")
        )
        sized = pairs.join(one, "a").join(two, "b").filter(100 * F.least("n_a", "n_b") >= self.similar * F.greatest("n_a", "n_b"))
        survivors = written(sized.filter(_pruner(self.similar, self.miss)("s_a", "s_b")).select("a", "b", "same_a", "same_b"), "survivors")
        return written(self._exact(survivors), "links")

    def _exact(self, survivors: DataFrame) -> DataFrame:
        ids = written(survivors.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        texts = self.docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "id")
        sets = texts.select(_set_maker(self.width)("text").alias("s")).select("s.*").dropDuplicates(["same"])
        one, two = (sets.select(F.col("same").alias(f"same_{k}"), F.col("set").alias(f"set_{k}")) for k in ("a", "b"))
        linked = survivors.join(one, "same_a").join(two, "same_b").filter(_confirmer(self.similar)("set_a", "set_b"))
        return linked.select("a", "b").distinct()

    def components(self) -> DataFrame:
        """Every row of the documents: ``id``, ``n_shingles``, ``component_id`` (the smallest id that can be reached, itself included)."""
        # Ids of one class are linked with its first id, so copies take one link each.
        copies = self.members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        roots = components(self.links().unionByName(copies.distinct()))
        rows = self.signed.select("id", F.col("n").alias("n_shingles"))
        return self._rooted(rows, roots).withColumnRenamed("root", "component_id")


def one_of_each(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = 5, similar: int = SIMILAR) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id, columns as in ``docs``.

    Rows without an id stay; of rows that repeat an id one stays.
    """
    found = NearDuplicates(docs, text=text, key=key, width=width, similar=similar).components()
    gone = found.filter("id <> component_id").select(F.col("id").alias("_gone")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"))
    left = row.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    some, none = left.filter("_key is not null"), left.filter("_key is null")
    return some.dropDuplicates(["_key"]).unionByName(none).select("_row.*")


OP5_SQL = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
s as (
    select distinct doc_id, array_to_string(w[k : k + 1], ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as k from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
sym as (select a, b from links union all select b, a from links),
reach(id, root) as (select doc_id, doc_id from w union select b, root from reach join sym on a = id),
comp as (select id, min(root) as root from reach group by id)
select doc_id, coalesce(n, 0) as n_shingles, root as component_id, doc_id = root as kept
from w left join n using (doc_id) join comp on id = doc_id"""


@query("op5_near_duplicates", OP5_SQL)
def op5(spark, sf):
    """Every document with the component of its near copies."""
    found = NearDuplicates(table(spark, sf, "documents"), width=2).components()
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
