"""Neighbour graphs over several cells: jobs, recall, ties, vectors of odd lengths and crowds of near ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catloom.llm import neighbours
from catloom.llm.neighbours import NeighbourGraph


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(np.asarray(x, float).tolist())], f"vec_id bigint, embedding array<{kind}>")


def found(graph, every, k):
    out = {}
    for r in graph.nearest(F.col("id") % every == 0, k=k).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in out.items()}


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def table_of(kind):
    rng = np.random.default_rng(8)
    x = unit(rng.normal(size=(3000, 16)))
    if kind == "lengths":
        x *= rng.lognormal(0, 0.7, size=(3000, 1))
    if kind == "huge":
        x *= 1e100
    if kind == "crowd":  # most nodes lie in one cell
        x[:2200] = unit(x[:1] + 0.02 * x[:2200])
    return x


@pytest.mark.parametrize("kind", ["even", "lengths", "huge", "crowd"])
def test_recall_over_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "CELL", 250)
    x = table_of(kind)
    graph = NeighbourGraph(frame(spark, x, "double"), degree=8)
    assert len(graph.places.centres) >= 10 and graph.places.shelves > 1
    if kind == "crowd":
        assert len(graph.places.cell_of) > len(graph.places.centres)
    assert graph.graph.groupBy("shard").count().agg(F.max("count")).first()[0] < 750
    got, hits = found(graph, 50, 10), 0
    for i in range(0, 3000, 50):
        s = x @ x[i]
        s[i] = -np.inf
        assert len(got[i]) == 10
        assert all(abs(s[v] - score) <= 1e-12 * abs(s[v]) for v, score in got[i])
        hits += len({v for v, _ in got[i]} & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 600


def test_few_jobs(spark, monkeypatch):
    """The rounds of the descent and the steps of the search are no jobs: each ran several, which took most of the time."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rows = frame(spark, unit(np.random.default_rng(3).normal(size=(1500, 16))))
    spark.sparkContext.setJobGroup("few-jobs", "neighbours")
    try:
        assert NeighbourGraph(rows, degree=6).nearest(F.col("id") % 100 == 0, k=5).count() == 75
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ties_and_copies_go_to_the_smaller_id(spark):
    x = np.stack(np.meshgrid(*[[0, 1, 2]] * 3), -1).reshape(-1, 3)[1:].repeat(3, axis=0)[np.random.default_rng(1).permutation(78)]
    got = found(NeighbourGraph(frame(spark, x)), 1, 6)
    for i in range(78):
        s = x @ x[i]
        assert got[i] == [(j, s[j]) for j in sorted(set(range(78)) - {i}, key=lambda j: (-s[j], j))[:6]]


def test_a_beam_that_is_too_narrow_widens(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 200)
    monkeypatch.setattr(neighbours, "BEAM", 4)
    x = unit(np.random.default_rng(6).normal(size=(2000, 24)))
    got = found(NeighbourGraph(frame(spark, x), degree=2, rounds=0), 40, 2)
    hits = sum(len({v for v, _ in got[i]} & set(np.argsort(-np.where(np.arange(2000) == i, -9, x @ x[i]))[:2].tolist())) for i in range(0, 2000, 40))
    assert hits >= 0.9 * 100


def test_cells_without_nodes():
    """A centre with no sample of its own, and shards on a shelf of which some hold nothing."""
    x = np.repeat(np.eye(3, dtype=np.float32), 5, axis=0)
    places = neighbours.Places(x, 1500, cell=100, cells=6, shelves=4)
    assert len(places.cell_of) == places.parts.sum() == len(places.shelf) and set(places.shelf) <= set(range(places.shelves))
    assert set(places.cell(x)) <= set(range(len(places.centres)))
