"""Neighbour search against brute force: ties, copies, small chunks, all metrics."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from flowtide.operators import neighbors
from flowtide.operators.neighbors import CellIndex, _sides, distances, exact_pairs, hashed_pairs, nearest, nearest_hashed, nearest_places, neighbour_vote, recall


def data(n=90, dims=4, copies=30, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dims)).round(1)
    points[:copies] = points[0]  # a third of the rows are one and the same vector
    return points


def frame(spark, points, name):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], f"{name} long, embedding array<double>")


def brute(a, b, k, metric, same):
    gap = np.abs(a[:, None, :] - b[None, :, :])
    d = {"manhattan": gap.sum(2), "chebyshev": gap.max(2)}.get(metric, np.sqrt((gap**2).sum(2)))
    if same:
        np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:k]}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski"])
@pytest.mark.parametrize("same", [True, False])
def test_exact(spark, metric, same):
    points = data()
    got = nearest(
        frame(spark, points, "query_id"), frame(spark, points, "reference_id"), 4, metric,
        exclude_same_id=same, pivots=5, chunk_rows=16,
    ).collect()
    assert {(r["query_id"], r["reference_id"]) for r in got} == brute(points, points, 4, metric, same)
    assert len(got) == 4 * len(points)


def test_cosine(spark):
    points = data() + 0.05
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    got = nearest(frame(spark, points, "query_id"), frame(spark, points, "reference_id"), 3, "cosine", pivots=4, chunk_rows=20).collect()
    for r in got:
        assert r["similarity"] == pytest.approx(float(unit[r["query_id"]] @ unit[r["reference_id"]]))
    best = np.sort(unit @ unit.T, axis=1)[:, ::-1][:, :3]
    for i in range(len(points)):
        mine = sorted((r["similarity"] for r in got if r["query_id"] == i), reverse=True)
        assert mine == pytest.approx(list(best[i]))


def test_fewer_references_than_k(spark):
    points = data(6, copies=1)
    got = nearest(frame(spark, points, "query_id"), frame(spark, points[:2], "reference_id"), 5)
    assert got.count() == 12


def test_no_references(spark):
    points = data(3, copies=1)
    empty = frame(spark, points, "reference_id").where("reference_id < 0")
    assert nearest(frame(spark, points, "query_id"), empty, 2).count() == 0


def test_vote_ties_go_to_the_smallest_label(spark):
    neighbours = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "query_id long, reference_id long")
    references = spark.createDataFrame([(10, 7), (11, 3), (12, 7)], "reference_id long, label int")
    got = {r["query_id"]: (r["prediction"], r["share"]) for r in neighbour_vote(neighbours, references, "label").collect()}
    assert got == {1: (3, 0.5), 2: (7, 1.0)}


def clustered(n=3000, centres=60, dims=8, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * 4 + rng.normal(size=(n, dims)) * 0.2


def test_references_are_copied_by_visits(spark):
    """Many more queries than a block holds: a reference is there once for each block of visits, not of queries."""
    points = clustered(centres=20)
    left, right = _sides(frame(spark, points, "query_id"), frame(spark, points[:2000], "reference_id"), "query_id", "reference_id", "embedding", False)
    asked, held = exact_pairs(left, right, "euclidean", 2.0, 6, None, 100)
    visits, copies = asked.count(), held.count()
    assert visits < 6 * 3000  # a few chunks each, of more than forty
    assert copies <= 5 * 2000  # thirty blocks of queries would make 60,000
    blocks = asked.groupBy("__chunk").agg({"__block": "max"}).agg({"max(__block)": "sum"}).first()[0]
    assert held.select("__chunk", "__block").distinct().count() <= blocks + asked.select("__chunk").distinct().count()
    got = nearest(frame(spark, points, "query_id"), frame(spark, points[:2000], "reference_id"), 5, chunk_rows=100)
    mine = {(r["query_id"], r["reference_id"]) for r in got.collect()}
    gap = ((points[:, None, :] - points[None, :2000, :]) ** 2).sum(2)
    assert mine == {(i, int(j)) for i, row in enumerate(gap) for j in np.argsort(row, kind="stable")[:5]}


def test_hashing_finds_nine_of_ten(spark, small):
    points = clustered(dims=16)
    queries, references = frame(spark, points[::10], "query_id"), frame(spark, points, "reference_id")
    exact = nearest(queries, references, 5, "cosine")
    assert recall(nearest_hashed(queries, references, 5), exact) >= 0.9
    left, right = _sides(queries, references, "query_id", "reference_id", "embedding", True)
    asked, held = hashed_pairs(left, right, 12, 8, 3, 500, 7)
    assert held.select("__r").distinct().count() == 3000  # every row is indexed
    # vectors without neighbours to speak of: few bits
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    queries, references = rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "reference_id")
    exact = nearest(queries, references, 5, "cosine", exclude_same_id=True)
    found = nearest_hashed(queries, references, 5, exclude_same_id=True, tables=16, bits=4, probes=2)
    assert recall(found, exact) >= 0.9
    assert found.groupBy("query_id").count().agg({"count": "max"}).first()[0] == 5


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski"])
@pytest.mark.parametrize("kind", ["plain", "copies", "one far row", "far from zero", "not finite"])
def test_screened_pairs_are_those_of_all_distances(metric, kind):
    """The same places and the same distances, to the last bit, with and without the own id."""
    rng = np.random.default_rng(8)
    some, others = rng.normal(size=(150, 6)), rng.normal(size=(1500, 6))
    if kind == "copies":
        some, others = some.round(0), others.round(0)
    elif kind == "one far row":
        others[7] = 1e7
    elif kind == "far from zero":
        some, others = some * 1e-6 + 1e9, others * 1e-6 + 1e9
    elif kind == "not finite":
        some[::9, 0], others[::7, 2] = np.inf, np.nan
    ids = rng.integers(0, 50, 150), np.sort(rng.integers(0, 50, 1500))
    p = 3.0 if metric == "minkowski" else 2.0
    for own in (None, ids):
        with np.errstate(invalid="ignore"):
            d = distances(some, others, metric, p)
        if own is not None:
            d[own[0][:, None] == own[1][None, :]] = np.inf
        want = [(i, int(j), row[j]) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:4] if np.isfinite(row[j])]
        assert list(zip(*(x.tolist() for x in nearest_places(some, others, 4, metric, p, own)))) == want


def test_visits_without_structure_grow_with_chunks_not_cells(spark):
    """Where nothing can be ruled out a query visits full chunks, not one chunk for each of the cells."""
    points = np.random.default_rng(9).normal(size=(2000, 24))
    left, right = _sides(frame(spark, points[:300], "query_id"), frame(spark, points, "reference_id"), "query_id", "reference_id", "embedding", False)
    asked, _ = exact_pairs(left, right, "euclidean", 2.0, 6, None, 500)
    assert asked.count() <= 300 * 8  # some 45 cells


def test_copies_are_not_compared(spark, monkeypatch):
    """Thousands of copies on both sides: the pairs to compare do not grow with them, the answers are those of all rows."""
    points = np.repeat(np.arange(8.0).reshape(4, 2), 500, axis=0)
    seen = []
    whole = neighbors.exact_pairs
    monkeypatch.setattr(neighbors, "exact_pairs", lambda *a: seen.append(whole(*a)) or seen[-1])
    got = nearest(frame(spark, points, "query_id"), frame(spark, points, "reference_id"), 3, chunk_rows=100).collect()
    asked, held = seen[0]
    assert asked.count() <= 16 and held.count() <= 12 * 4
    assert {(r["query_id"], r["reference_id"]) for r in got} == {(i, i // 500 * 500 + j) for i in range(2000) for j in range(3)}
    assert len(got) == 6000


def test_planning_takes_no_room_for_all_cells():
    """A query looks at the cells near it: no number is kept for every pair of a query and a cell."""
    points = np.random.default_rng(5).uniform(size=(4096, 2))
    index = CellIndex.of(points, "euclidean", 2.0)
    cell, far = index.place(points)
    facts = [{"cell": c, "n": int((cell == c).sum()), "lo": far[cell == c].min(), "hi": far[cell == c].max(), "near": np.sort(far[cell == c])[:1]} for c in np.unique(cell)]
    index.summarise(facts, 1, 1)
    tracemalloc.start()
    index.visits(points[:2000], 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 4096 * 8 / 4


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev"])
@pytest.mark.parametrize("kind", ["plain", "whole numbers", "one flat column", "far from zero", "not finite"])
def test_bounds_without_structure_lose_no_neighbour(monkeypatch, metric, kind):
    """Where boxes rule out little the screen sees the first references only, and the answers are those of all distances."""
    rng = np.random.default_rng(14)
    some, others = rng.normal(size=(400, 24)), rng.normal(size=(6500, 24))
    if kind == "whole numbers":
        some, others = some.round(0), others.round(0)
    elif kind == "one flat column":
        some[:, 3], others[:, 3] = 0.0, 0.0
    elif kind == "far from zero":
        some, others = some * 1e-3 + 1e6, others * 1e-3 + 1e6
    elif kind == "not finite":
        some[::9, 0], others[::70, 2] = np.inf, np.nan
    seen, whole = [0], neighbors._Screen.near

    def near(self, rows, columns):
        found = whole(self, rows, columns)
        seen[0] += found.size
        return found

    monkeypatch.setattr(neighbors._Screen, "near", near)
    ids = rng.integers(0, 900, 400), np.sort(rng.integers(0, 900, 6500))
    for own in (None, ids):
        with np.errstate(invalid="ignore"):
            d = distances(some, others, metric)
        if own is not None:
            d[own[0][:, None] == own[1][None, :]] = np.inf
        within = None if own is not None else np.sort(np.where(np.isnan(d), np.inf, d), axis=1)[:, 5]
        want = [(i, int(j), row[j]) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:4] if np.isfinite(row[j])]
        seen[0] = 0
        assert list(zip(*(x.tolist() for x in nearest_places(some, others, 4, metric, 2.0, own, within)))) == want
        if kind != "whole numbers":  # so many are equally near that the grid itself is not used
            assert seen[0] < 0.6 * 400 * 6500


def test_waves_lie_below_every_gap():
    gap = np.linspace(0, 40, 400_001)[1:]
    assert (sum(a * (1 - np.cos(w * gap)) for a, w in neighbors._WAVES) <= gap).all()
    assert gap[-1] > 2 * sum(a for a, _ in neighbors._WAVES)


def test_visits_of_one_block_of_a_file_are_planned_by_many_tasks(spark, monkeypatch):
    """A table in one partition would have all its visits planned by one task."""
    points = np.random.default_rng(9).normal(size=(25_000, 2))
    rows = frame(spark, points, "query_id").coalesce(1)
    left, right = _sides(rows, frame(spark, points[:50], "reference_id"), "query_id", "reference_id", "embedding", False)
    seen, whole = [], neighbors.materialize
    monkeypatch.setattr(neighbors, "materialize", lambda df, name: seen.append((name, df.rdd.getNumPartitions())) or whole(df, name))
    exact_pairs(left, right, "euclidean", 2.0, 2, None, 100)
    assert dict(seen)["visits"] == 3
