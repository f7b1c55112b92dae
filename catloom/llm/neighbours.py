"""Approximate nearest neighbours: neighbour graphs of cells, built by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import ship_with_tasks, written
from .common import query, table

ship_with_tasks(__name__)

DEGREE = 40  # neighbours of a node, and reverse neighbours that join in
# Rounds of joining neighbours of neighbours end when no larger share of the graph's edges is new.
SETTLED = 0.005
# The beam of the search doubles until so much is found of what an exact scan finds for a sample of the queries.
BEAM = 128
RECALL = 0.95
SAMPLE = 128
# The first graph: nearest nodes in blocks of nodes that lie next to each other along random directions.
DIRECTIONS = 4
BLOCK = 256
# Nodes of a cell, cells, and vectors from which the place of a cell is learnt. A cell of over 1.5 times as many nodes is cut into shards.
CELL = 8192
CELLS = 4096
LEARN = 64
# Bytes of vectors that a task holds, and nodes or queries that are near each other and are compared at once with what lies round any of them.
SHELF_BYTES = 64 << 20
JOINT = 256
CHUNK = 1024

_BEST = T.ArrayType(T.StructType([T.StructField("near", T.LongType()), T.StructField("score", T.DoubleType())]))
_FOUND = np.dtype([("near", "<i8"), ("id", "<i8"), ("score", "<f8")])
_ROWS = "shelf int, shard int, node bigint, id bigint, vector binary, list binary"


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    raw, n = b"".join(column.to_pylist()), len(column)
    return np.frombuffer(raw, dtype).reshape(n, -1) if raw else np.zeros((n, 0), dtype)


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    size, raw = matrix.dtype.itemsize * matrix.shape[1], np.ascontiguousarray(matrix).tobytes()
    return pa.array([raw[i * size : (i + 1) * size] for i in range(len(matrix))], pa.binary())


def _packer(dtype: str):
    @F.arrow_udf(T.BinaryType())
    def pack(vectors: pa.Array) -> pa.Array:
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype), vectors.offsets.to_numpy()
        raw, ends = flat.tobytes(), (ends - ends[0]) * flat.dtype.itemsize
        return pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return pack


def _lengths(dtype: str):
    @F.arrow_udf(T.DoubleType())
    def lengths(vectors: pa.Array) -> pa.Array:
        out, sizes = np.zeros(len(vectors)), pc.binary_length(vectors).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x = _matrix(vectors.take(pa.array(rows)), dtype).astype(np.float64)
            most = np.abs(x).max(1)
            out[rows] = np.minimum(most * np.sqrt(((x / most[:, None]) ** 2).sum(1)), np.finfo(np.float64).max)
        return pa.array(out)

    return lengths


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten()


def _unit(vectors: np.ndarray, length: float) -> np.ndarray:
    """Vectors as parts of the longest one."""
    return (vectors / length).astype(np.float32)


def _lifted(x: np.ndarray) -> np.ndarray:
    """Vectors of one length, by one more component: of two that lie close, inner products with a third are alike."""
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], axis=1)


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """Directions of ``n`` groups of vectors that point the same way, by spherical k-means."""
    rng = np.random.default_rng(n)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(8):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), x[rng.integers(0, len(x), len(centres))])
    return centres.astype(np.float32)


def _chain(centres: np.ndarray) -> np.ndarray:
    """An order of centres in which each is followed by the nearest one that is left."""
    left, order = np.ones(len(centres), bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, centres @ centres[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return np.array(order)


def _offer(near: np.ndarray, score: np.ndarray, at: np.ndarray, ids: np.ndarray, s: np.ndarray) -> int:
    """Puts those of the new nodes ``ids`` that score better than the worst in the lists of the rows ``at`` in its place; how many."""
    width, new = near.shape[1], 0
    better = s > score[at].min(1, keepdims=True)
    sizes = np.count_nonzero(better, axis=1)
    # Rows with few and many better ones are padded apart.
    for low, high in ((0, len(ids) // 64), (len(ids) // 64, len(ids) // 8), (len(ids) // 8, len(ids))):
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        n, to = len(rows), at[rows]
        if not n:
            continue
        if low >= len(ids) // 8:
            both, names = np.concatenate([score[to], s[rows]], axis=1), np.concatenate([near[to], np.broadcast_to(ids.astype(near.dtype), (n, len(ids)))], axis=1)
        else:
            found, few = np.flatnonzero(better if n == len(s) else better[rows]), sizes[rows]
            row, most = np.repeat(np.arange(n), few), int(few.max())
            col, place = found - row * len(ids), row * (width + most) + width + np.arange(len(found)) - np.repeat(np.cumsum(few) - few, few)
            both, names = np.full((n, width + most), -np.inf, np.float32), np.zeros((n, width + most), near.dtype)
            both[:, :width], names[:, :width] = score[to], near[to]
            both.ravel()[place] = s.ravel()[found if n == len(s) else rows[row] * len(ids) + col]
            names.ravel()[place] = ids[col]
        best = np.argpartition(both, both.shape[1] - width, axis=1)[:, -width:]
        new += int(np.count_nonzero(best >= width))
        best += np.arange(n)[:, None] * both.shape[1]
        near[to], score[to] = names.ravel()[best], both.ravel()[best]
    return new


def _chunks(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Parts that double, so that the first ones raise the worst score that the others must beat."""
    first, size = 0, CHUNK
    while first < len(ids):
        yield ids[first : first + size]
        first, size = first + size, 2 * size


def _reverse(near: np.ndarray, degree: int) -> np.ndarray:
    """For each node those it is a neighbour of, by its place in their lists; at most ``degree``, the rest filled up with the number of nodes."""
    m, k = near.shape
    to, by = near.T.ravel(), np.tile(np.arange(m, dtype=np.int32), k)
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    place = np.arange(len(to)) - np.searchsorted(to, np.arange(m + 1))[to]
    fits = (place < degree) & (to < m)
    out = np.full((m + 1, degree), m, np.int32)
    out[to[fits], place[fits]] = by[fits]
    return out


def _around(near: np.ndarray, degree: int) -> np.ndarray:
    """The neighbours of each node and those it is a neighbour of; a last row for the number that fills up."""
    return np.concatenate([np.concatenate([near, np.full((1, near.shape[1]), len(near), near.dtype)]), _reverse(near, degree)], axis=1)


def _descent(x: np.ndarray, degree: int, block: int, directions: int, rounds: int | None) -> np.ndarray:
    """The neighbours of each node of a cell, best first, by NN-descent.

    Nodes start with their nearest in blocks along random directions. In every round the neighbours of neighbours, in both
    directions, of a few nodes that lie together are compared with all of these few, unless they were before.
    """
    m = len(x)
    k = min(degree, m - 1)
    near, score = np.full((m, max(k, 0)), m, np.int32), np.full((m, max(k, 0)), -np.inf, np.float32)
    if k < 1:
        return near
    place = np.full(m + 1, -1)

    def compare(at: np.ndarray, ids: np.ndarray) -> int:
        s = x[at] @ x[ids].T
        place[ids] = np.arange(len(ids))
        for known in (at[:, None], near[at]):  # neither a node itself nor what it has
            to = place[known]
            row, col = np.nonzero(to >= 0)
            s[row, to[row, col]] = -np.inf
        place[ids] = -1
        return _offer(near, score, at, ids, s)

    for t in range(directions):
        order = np.argsort(x @ np.random.default_rng(t).normal(size=x.shape[1]).astype(np.float32), kind="stable")
        for part in np.array_split(order, max(1, round(m / block))):
            for i in range(0, len(part), JOINT):
                compare(part[i : i + JOINT], part)
    order = np.argsort((x @ x[::JOINT].T).argmax(1), kind="stable")
    groups = np.array_split(order, -(-m // JOINT))
    done = np.zeros((len(groups), m + 1), bool)
    done[:, m] = True
    for _ in count() if rounds is None else range(rounds):
        new, around = 0, _around(near, degree)
        for group, before in zip(groups, done, strict=True):
            reached = np.zeros(m + 1, bool)
            reached[around[group]] = True
            reached[around[np.flatnonzero(reached)]] = True
            ids = np.flatnonzero(reached & ~before)
            before[ids] = True
            new += sum(compare(group, part) for part in _chunks(ids))
        if new <= SETTLED * m * k:
            break
    best = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(near, best, 1)


def _walk(x: np.ndarray, around: np.ndarray, q: np.ndarray, start: np.ndarray, near: np.ndarray, score: np.ndarray, first: int, hops: int | None) -> None:
    """Puts into the beams of a few queries, ``near`` and ``score``, what a greedy search finds in a cell, as places from ``first`` on.

    ``start`` has a query's own place in the cell or the number of nodes. The search starts there, at nodes all over the cell, a quarter
    as many as a beam holds, and at the neighbours of these, and opens what comes into the beam of any of the queries until all of that is opened.
    """
    m = len(x)
    every, seen, reached = np.arange(len(q)), np.zeros(m + 1, bool), np.zeros(m + 1, bool)
    seen[m] = True
    reached[np.linspace(0, m - 1, min(m, near.shape[1] // 4 + 1)).astype(int)] = True
    reached[start] = True
    reached[around[np.flatnonzero(reached)]] = True
    for _ in count() if hops is None else range(hops + 1):
        ids = np.flatnonzero(reached & ~seen)
        if not len(ids):
            break
        seen[ids] = True
        for part in _chunks(ids):
            _offer(near, score, every, ~(part + first), q @ x[part].T)
        # Nodes that aren't opened yet stand in the beam as ~place.
        reached = np.zeros(m + 1, bool)
        reached[around[np.unique(~near[near < 0]) - first]] = True
        near[:] = np.where(near < 0, ~near, near)
    near[:] = np.where(near < 0, ~near, near)


def _segments(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches in which the keys are the same."""
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        if batch.num_rows:
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _rows(shelf: np.ndarray, shard: np.ndarray, node: np.ndarray, ids: np.ndarray, vector: pa.Array, more: pa.Array) -> pa.RecordBatch:
    values = [pa.array(shelf, pa.int32()), pa.array(shard, pa.int32()), pa.array(node, pa.int64()), pa.array(ids, pa.int64()), vector, more]
    return pa.RecordBatch.from_arrays(values, names=["shelf", "shard", "node", "id", "vector", "list"])


class Places:
    """Where nodes lie: the cell whose centre is nearest, one of its shards, and the shelf on which that stands."""

    def __init__(self, sample: np.ndarray, nodes: int, *, cell: int, cells: int, shelves: int):
        self.centres = _centres(_lifted(sample), cells) if cells > 1 else np.zeros((1, sample.shape[1] + 1), np.float32)
        own, cells = self.cell(sample), len(self.centres)
        size = (np.bincount(own, minlength=cells) + 1) / (len(own) + cells) * nodes
        order = _chain(self.centres)
        self.parts = np.maximum(1, np.ceil(size / (1.5 * cell))).astype(np.int64)
        self.first = np.cumsum(self.parts) - self.parts
        self.cell_of = np.repeat(np.arange(cells), self.parts)
        shards, each = np.concatenate([self.first[c] + np.arange(self.parts[c]) for c in order]), np.repeat((size / self.parts)[order], self.parts[order])
        self.shelves = min(len(shards), max(shelves, 1))
        self.shelf = np.zeros(len(shards), np.int64)
        self.shelf[shards] = np.minimum((np.cumsum(each) - each / 2) / each.sum() * self.shelves, self.shelves - 1).astype(np.int64)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return (_lifted(x) @ self.centres.T).argmax(1) if len(x) else np.zeros(0, np.int64)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The cells in the order in which queries enter them."""
        return np.argsort(-(x @ self.centres[:, : x.shape[1]].T), axis=1, kind="stable")


def _placed(places: Places, dtype: str, length: float):
    """Rows with the place of their node; of those in a batch that have the same node the one with the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, node = batch.column("id").to_numpy(), batch.column("node").to_numpy()
            order = np.lexsort((ids, node))
            keep = order[np.flatnonzero(np.r_[True, np.diff(node[order]) != 0][: len(order)])]
            vector = batch.column("vector").take(pa.array(keep))
            cell = places.cell(_unit(_matrix(vector, dtype), length))
            shard = places.first[cell] + node[keep] % places.parts[cell]
            yield _rows(places.shelf[shard], shard, node[keep], ids[keep], vector, pa.nulls(len(keep), pa.binary()))

    return run


def _graphs(dtype: str, length: float, *settings):
    """The nodes of each shard with the places of their neighbours in it. Rows come by shard, id and node."""

    def built(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        _, at = np.unique(rows["node"].to_numpy(), return_index=True)
        rows = rows.take(pa.array(np.sort(at))).combine_chunks().to_batches()[0]
        near = _descent(_unit(_matrix(rows.column("vector"), dtype), length), *settings)
        lists = _binary(near.astype("<u2" if len(near) < 1 << 16 else "<u4"))
        return pa.RecordBatch.from_arrays([*rows.columns[:5], lists], names=rows.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept = None, []
        for key, part in _segments(batches, "shard"):
            if key != shard and kept:
                yield built(kept)
                kept = []
            shard = key
            kept.append(part)
        if kept:
            yield built(kept)

    return run


def _routed(places: Places, dtype: str, length: float, cells: int):
    """A query once for each shelf, with the shards there that it enters. The shard of such a row is a number beyond all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, raw = batch.column("node").to_numpy(), batch.column("vector")
            x = _unit(_matrix(raw, dtype), length)
            home = len(places.cell_of) + places.first[places.cell(x)]
            enters = np.zeros((len(x), len(places.centres)), bool)
            np.put_along_axis(enters, places.order(x)[:, :cells], True, axis=1)
            row, shard = np.nonzero(enters[:, places.cell_of])
            by = np.lexsort((shard, places.shelf[shard], row))
            row, shard = row[by], shard[by]
            shelf = places.shelf[shard]
            starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(shelf) != 0)])
            ends, packed, at = np.r_[starts[1:], len(row)], shard.astype("<i4"), row[starts]
            lists = pa.array([packed[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
            yield _rows(shelf[starts], home[at], node[at], np.zeros(len(at), np.int64), raw.take(pa.array(at)), lists)

    return run


class _Shelf:
    """The shards of a shelf with their graphs."""

    def __init__(self, batches: list[pa.RecordBatch], dtype: str, length: float, degree: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.node, self.ids, shard = (rows[k].to_numpy() for k in ("node", "id", "shard"))
        self.raw = np.concatenate([_matrix(b.column("vector"), dtype) for b in batches])
        self.x, self.shards = _unit(self.raw, length), {}
        cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            near = _matrix(rows["list"].slice(a, b - a).combine_chunks(), "<u2" if b - a < 1 << 16 else "<u4").astype(np.int32)
            order = np.argsort(self.node[a:b])
            self.shards[int(shard[a])] = a, b, _around(near, degree), order

    def search(self, node: np.ndarray, raw: np.ndarray, x: np.ndarray, opens: list[np.ndarray], k: int, beam: int, hops: int | None) -> list[bytes]:
        """For each query the best ``k`` nodes of those that are found in the shards that it opens, with exact scores."""
        nowhere = len(self.x)
        near, score = np.full((len(x), beam), nowhere, np.int32), np.full((len(x), beam), -np.inf, np.float32)
        row, shard = np.repeat(np.arange(len(x)), [len(o) for o in opens]), np.concatenate(opens)
        for s in sorted(self.shards.keys() & set(shard.tolist())):  # one for which no node was found has no rows
            a, b, around, order = self.shards[s]
            mine, own = row[shard == s], self.node[a:b][order]
            for i in range(0, len(mine), JOINT):
                at = mine[i : i + JOINT]
                place = np.minimum(np.searchsorted(own, node[at]), len(own) - 1)
                start = np.where(own[place] == node[at], order[place], b - a)
                beams, scores = near[at], score[at]
                _walk(self.x[a:b], around, x[at], start, beams, scores, a, hops)
                near[at], score[at] = beams, scores
        best = np.take_along_axis(near, np.argpartition(score, beam - min(beam, 2 * k), axis=1)[:, -min(beam, 2 * k) :], 1)
        out = []
        for i in range(0, len(x), JOINT):
            part = best[i : i + JOINT]
            # Terms are added one after the other, from first to last.
            exact = np.cumsum(self.raw[np.minimum(part, nowhere - 1)].astype(np.float64) * raw[i : i + JOINT, None].astype(np.float64), axis=2)[:, :, -1]
            for at, s in zip(part, exact, strict=True):
                at, s = at[at < nowhere], s[at < nowhere]
                order = np.lexsort((self.node[at], self.ids[at], -s))[:k]
                found = np.zeros(len(order), _FOUND)
                found["near"], found["id"], found["score"] = self.node[at[order]], self.ids[at[order]], s[order]
                out.append(found.tobytes())
        return out


def _searched(shards: int, dtype: str, length: float, degree: int, k: int, beam: int, hops: int | None):
    """``node, found`` for each query of a shelf. The shelf's shards come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, kept, ready = None, [], None
        for (shelf, shard), part in _segments(_flagged(batches, shards), "shelf", "query"):
            if shelf != on:
                on, kept, ready = shelf, [], None
            if not shard:
                kept.append(part)
                continue
            if ready is None and not kept:
                continue
            if ready is None:
                ready, kept = _Shelf(kept, dtype, length, degree), []
            node, raw = part.column("node").to_numpy(), _matrix(part.column("vector"), dtype)
            opens = [np.frombuffer(o, "<i4") for o in part.column("list").to_pylist()]
            found = ready.search(node, raw, _unit(raw, length), opens, k, beam, hops)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found, pa.binary())], names=["node", "found"])

    return run


def _flagged(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("query", pa.array((batch.column("shard").to_numpy() >= shards).astype(np.int8)))


def _merged(k: int):
    @F.arrow_udf(_BEST)
    def merged(found: pa.Array) -> pa.Array:
        """The best ``k`` of what a query found on all shelves."""
        offsets, flat = _lists(found)
        raw, ends, near, score = flat.to_pylist(), [0], [], []
        for a, b in zip(offsets, offsets[1:], strict=False):
            rows = np.frombuffer(b"".join(raw[a:b]), _FOUND)
            rows = rows[np.lexsort((rows["near"], rows["id"], -rows["score"]))[:k]]
            ends.append(ends[-1] + len(rows))
            near.append(rows["near"])
            score.append(rows["score"])
        struct = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *near])), pa.array(np.concatenate([np.zeros(0), *score]))], names=["near", "score"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)

    return merged


def _best(rows: DataFrame, group: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts every task's share of a group before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= n)


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _exact_scores(nodes: np.ndarray, vectors: np.ndarray, dtype: str, k: int):
    """The ``k`` highest scores of each of a few nodes among a task's rows, and the shards they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, shard = np.full((len(nodes), k), -np.inf), np.full((len(nodes), k), -1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"), dtype).astype(np.float64)
                s = np.where(nodes[:, None] == batch.column("node").to_numpy(), -np.inf, vectors @ x.T)
                s, of = np.concatenate([best, s], axis=1), np.concatenate([shard, np.broadcast_to(batch.column("shard").to_numpy(), s.shape)], axis=1)
                at = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:]
                best, shard = np.take_along_axis(s, at, 1), np.take_along_axis(of, at, 1)
        at, _ = np.nonzero(best > -np.inf)
        there = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(best[there]), pa.array(shard[there].astype(np.int32))], names=["node", "s", "shard"])

    return run


class NeighbourGraph:
    """A graph over the different vectors of a table, built by NN-descent for the inner product.

    Equal vectors are one node. Nodes lie in cells of those that point the same way, some thousands in each, and every cell has
    a graph of its own, which one task builds in its memory: nodes start with their nearest in a few blocks along random directions;
    in every round they are compared with the neighbours of their neighbours, in both directions, and what is
    better than the worst that a node has replaces it, until a round changes next to
    nothing (or ``rounds`` times, if given). A vector is shuffled once for the graph and once for each search, with its neighbours as
    places in the cell; no edge is. Scores of the result are exact. Rows whose vector cannot be used, or differs in length from most, take no part.
    """

    def __init__(self, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, rounds: int | None = None):
        spark = rows.sparkSession
        self.degree = degree
        kind = rows.schema[vector].dataType.elementType
        self.dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
        fine = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
        packed = _packer(self.dtype).asNondeterministic()("vector").alias("vector")
        self.rows = written(fine.select("id", F.xxhash64("vector").alias("node"), packed), "vectors")
        sizes = self.rows.groupBy(F.octet_length("vector").alias("size")).agg(F.count("*").alias("rows"), F.approx_count_distinct("node").alias("nodes"), F.max(_lengths(self.dtype)("vector")).alias("length"))
        most = sizes.orderBy(F.desc("rows"), "size").first() or {"size": 0, "nodes": 0, "length": 1.0}
        self.rows = self.rows.filter(F.octet_length("vector") == most["size"])
        self.length, nodes, width = most["length"], max(1, most["nodes"]), max(1, most["size"] // int(self.dtype[2]))
        cell = max(2, min(CELL, SHELF_BYTES // (4 * width)))
        cells = max(1, min(CELLS, round(nodes / cell)))
        share = F.pmod(F.xxhash64("node", F.lit("centre")), F.lit(1 << 30)) < int((1 << 30) * min(1, LEARN * cells / nodes))
        drawn = self.rows.filter(share if cells > 1 else F.lit(False)).groupBy("node").agg(F.first("vector").alias("vector")).orderBy("node").collect()
        sample = _unit(np.frombuffer(b"".join(r["vector"] for r in drawn), self.dtype).reshape(-1, width), self.length)
        shelves = max(-(-nodes * 4 * width // SHELF_BYTES), 2 * spark.sparkContext.defaultParallelism)
        self.places = Places(sample, nodes, cell=cell, cells=min(cells, max(1, len(sample))), shelves=shelves)
        least_id = F.coalesce(F.col("id").try_cast("bigint"), F.lit(-(2**63)))
        placed = self.rows.select(least_id.alias("id"), "node", "vector").mapInArrow(_placed(self.places, self.dtype, self.length), _ROWS)
        dealt = placed.repartitionById(self.places.shelves, "shelf").sortWithinPartitions("shard", "id", "node")
        self.graph = written(dealt.mapInArrow(_graphs(self.dtype, self.length, degree, BLOCK, DIRECTIONS, rounds), _ROWS), "graph")

    def search(self, queries: DataFrame, *, k: int, beam: int = BEAM, cells: int | None = None, hops: int | None = None) -> DataFrame:
        """``(node, near, score)``: for each node of ``queries (node, vector)`` the ``k`` best nodes that a greedy search finds, itself among them.

        The search enters the ``cells`` whose centres score best, all if not given. In each it starts from nodes all over the graph, and in the node's own
        cell from its neighbours, and opens the best nodes of its beam that aren't opened yet, until none is left, or ``hops`` times if given.
        """
        places = self.places
        routed = queries.select("node", "vector").mapInArrow(_routed(places, self.dtype, self.length, cells or len(places.centres)), _ROWS)
        both = self.graph.unionByName(routed).repartitionById(places.shelves, "shelf").sortWithinPartitions("shelf", "shard", "id", "node")
        found = both.mapInArrow(_searched(len(places.cell_of), self.dtype, self.length, self.degree, k, beam, hops), "node bigint, found binary")
        best = found.groupBy("node").agg(F.collect_list("found").alias("found")).select("node", _merged(k).asNondeterministic()("found").alias("best"))
        return best.select("node", F.explode("best").alias("b")).select("node", "b.near", "b.score")

    def _sample(self, queries: DataFrame, k: int) -> tuple[DataFrame, int]:
        """What an exact scan finds for a sample of the queries, of fixed size: ``(node, least, m)``, and the number of cells in which nearly all of it lies.

        Half of what may be missed is left to the search in the cells.
        """
        spark, places = queries.sparkSession, self.places
        sample = queries.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
        nodes, raw = np.array([r["node"] for r in sample], np.int64), np.frombuffer(b"".join(r["vector"] for r in sample), self.dtype)
        raw = raw.reshape(len(sample), -1) if sample else np.zeros((0, places.centres.shape[1] - 1), self.dtype)
        scores = self.graph.select("node", "vector", "shard").mapInArrow(_exact_scores(nodes, raw.astype(np.float64), self.dtype, k), "node bigint, s double, shard int")
        top = _best(scores, "node", [F.desc("s")], k).collect() if sample else []
        place = np.argsort(places.order(_unit(raw, self.length)), axis=1)
        row = {n: i for i, n in enumerate(nodes.tolist())}
        needed = np.sort([place[row[r["node"]], places.cell_of[r["shard"]]] for r in top])
        least = spark.createDataFrame([(r["node"], r["s"]) for r in top], "node bigint, s double").groupBy("node").agg(F.min("s").alias("least"), F.count("*").alias("m"))
        return least, int(needed[min(len(needed) - 1, int((1 + RECALL) / 2 * len(needed)))]) + 1 if top else len(places.centres)

    def wide(self, queries: DataFrame, *, k: int, recall: float = RECALL) -> DataFrame:
        """What the search finds for ``queries (node, vector)`` with a beam and in so many cells that it has ``recall`` of the ``k`` nearest of a sample.

        Both double until that is so; at most all cells are entered and the beam holds all nodes of one.
        """
        least, cells = self._sample(queries, k)
        due, beam = least.agg(F.sum("m")).first()[0] or 0, max(BEAM, 2 * k + 2)
        widest = self.graph.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        while True:
            near = written(self.search(queries, k=k + 1, beam=beam, cells=cells), "near")
            hits = near.filter("node <> near").join(F.broadcast(least), "node").filter("score >= least - 1e-9 * abs(least)").groupBy("node", "m").count()
            if (hits.agg(F.sum(F.least("count", "m"))).first()[0] or 0) >= recall * due or beam >= 4 * widest and cells >= len(self.places.centres):
                return near
            beam, cells = 2 * beam, 2 * cells

    def nearest(self, chosen: Column, *, k: int) -> DataFrame:
        """For each row that ``chosen`` (of ``id``) takes, its ``k`` nearest other rows: ``query_id, rank, vec_id, score``.

        The search is as wide as ``wide`` finds necessary. Ties go to the smaller id. With fewer candidates all that are found come. Rows that repeat an id are one
        candidate each.
        """
        queries = self.rows.filter(chosen).select(F.col("id").alias("query_id"), "node", "vector")
        near = self.wide(queries.groupBy("node").agg(F.first("vector").alias("vector")), k=k)
        # Of equal vectors only the k + 1 smallest ids can be among the k nearest.
        members = _best(self.rows.select("node", "id"), "node", [F.col("id")], k + 1)
        rows = near.join(members.select(F.col("node").alias("near"), "id"), "near")
        top = _best(rows, "node", [F.desc("score"), F.col("id")], k + 1)
        lists = top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("top"))
        other = F.filter("top", lambda r: r["id"] != F.col("query_id"))
        ranked = queries.join(lists, "node").select("query_id", F.posexplode(F.slice(other, 1, k)).alias("p", "r"))
        return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score"))


@query("op8_nearest")
def op8(spark, sf):
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return NeighbourGraph(table(spark, sf, "embeddings")).nearest(F.col("id") % 20 == 0, k=20)
