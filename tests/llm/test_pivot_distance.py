"""Exact top-k search against all products."""

from __future__ import annotations

import numpy as np
import pytest

from perindex.llm import pivot_distance as pd_index


def expected(rows: list[tuple], every: int, k: int, scale: float) -> list[tuple]:
    clean = set()
    for key, vector in rows:
        if key is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        clean.add((key, tuple(int(np.floor(np.float64(x) * scale)) for x in vector)))
    out = []
    for key, vector in sorted(clean):
        if key % every:
            continue
        scored = sorted(
            (-max(-(1 << 63), min(pd_index.LONG, sum(a * b for a, b in zip(vector, other, strict=True)))), name)
            for name, other in clean
            if name != key and len(other) == len(vector)
        )
        out += [(key, n + 1, name, -score) for n, (score, name) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, rows: list[tuple]):
    # Clashing and extra columns: names that the operator uses itself.
    made = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "s") for i, v in rows]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>, pivot int, key string").repartition(4)


def found(spark, rows, every=20, k=20, scale=64.0) -> list[tuple]:
    result = pd_index.search(table(spark, rows), every=every, k=k, scale=scale)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in result.collect())


def as_float(values: np.ndarray) -> list:
    return [float(x) for x in values.astype(np.float32)]


@pytest.fixture
def small(monkeypatch):
    """Limits that send a few hundred vectors through many lists, parts, shards and annuli."""
    for name, value in {"LIST": 40, "PART": 16, "SHARD": 7, "BLOCK": 3, "ANNULUS": 5, "HOT_ROWS": 4}.items():
        monkeypatch.setattr(pd_index, name, value)


def clustered(count: int, size: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size)) * 3
    points = centres[rng.integers(0, 6, count)] + rng.normal(size=(count, size)) * 0.2
    return [(int(i), as_float(points[i])) for i in range(count)]


@pytest.mark.parametrize(("size", "k"), [(3, 5), (16, 20)])
def test_answers_equal_all_products(spark, small, size, k):
    rows = clustered(240, size, size)
    assert found(spark, rows, every=9, k=k) == expected(rows, 9, k, 64.0)


def test_ties_copies_and_odd_vectors(spark, small):
    rng = np.random.default_rng(2)
    rows = [(i, as_float(rng.integers(-1, 2, 4) / 64)) for i in range(150)]  # few distinct vectors, many ties
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(120)]  # a third are copies of one vector
    rows += rows[:20]  # repeated rows
    rows += [(500, None), (501, []), (505, []), (502, [1.0, None, 0, 0]), (503, [float("nan"), 0, 0, 0]), (504, [float("inf"), 0, 0, 0])]
    rows += [(None, [1.0, 1, 1, 1]), (-10, [0.0, 0, 0, 0]), (510, [1.0, 2.0]), (515, [3.0, -2.0])]
    rows += [(20, [2.0, 0, 0, 0])]  # an id with a second vector
    assert found(spark, rows, every=5, k=6) == expected(rows, 5, 6, 64.0)


def test_orthogonal_vectors_all_tie(spark, small):
    rows = [(i, [float(i == j) for j in range(60)]) for i in range(60)]
    assert found(spark, rows, every=10, k=7) == expected(rows, 10, 7, 64.0)


def test_large_components(spark, small):
    rows = [(i, [float(np.float32(x)) for x in (1e9 * (i - 9), 3e9 / (i + 1), -2e8 * i)]) for i in range(25)]
    assert found(spark, rows, every=4, k=4) == expected(rows, 4, 4, 64.0)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0])]
    assert found(spark, rows) == expected(rows, 20, 20, 64.0)
    assert found(spark, [(3, [1.0])]) == []
    assert pd_index.search(table(spark, rows).limit(0)).collect() == []


def test_annuli_out_of_reach_are_left_out():
    """Clustered vectors: most products are never computed, and the answers stay whole."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 8)) * 400
    members = np.floor(centres[rng.integers(0, 30, 20_000)] + rng.normal(size=(20_000, 8)) * 5).astype(np.int64)
    queries = members[::400]
    longest = float((members.astype(float) ** 2).sum(axis=1).max())
    pivots = pd_index.Pivots(members[:2000], 20, longest)
    far, distance = pivots.of_vectors(members), pivots.of_queries(queries)
    near = far.argmin(axis=1)
    best = [np.zeros(0, np.int64)] * 4
    floor = np.full(len(queries), -pd_index.LONG - 1)
    scored, k = 0, 10
    for number in range(len(pivots.places)):
        part = np.flatnonzero(near == number)
        if not len(part):
            continue
        found_here, count = pd_index.search_part(queries, floor, distance[:, number], members[part], far[part, number], part, pivots, k)
        scored += count
        rows = (found_here[0], found_here[1], found_here[2], found_here[2])
        best = pd_index.best_rows(*(np.concatenate(pair) for pair in zip(best, rows, strict=True)), k)
        full = np.bincount(best[0], minlength=len(queries)) >= k
        worst = np.full(len(queries), pd_index.LONG)
        np.minimum.at(worst, best[0], best[1])
        floor[full] = np.maximum(floor[full], worst[full])
    assert scored < 0.6 * len(queries) * len(members)
    everything = queries @ members.T
    for q in range(len(queries)):
        order = np.lexsort((np.arange(len(members)), -everything[q]))[:k]
        assert list(best[2][best[0] == q]) == list(order)


@pytest.mark.parametrize("most", [3, 5000, 1 << 25, 1 << 40, (1 << 62)])
def test_products_are_exact(most):
    rng = np.random.default_rng(most % 1000)
    a, b = (rng.integers(-most, most, (4, 6)) for _ in range(2))
    for i in range(4):
        for j in range(4):
            exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))
            assert int(pd_index.products(a, b)[i, j]) == max(-(1 << 63), min(pd_index.LONG, exact))
