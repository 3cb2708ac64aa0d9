"""Links and components against comparing all vectors, bounds against true cosines, and rows that take no part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstack.llm import quantised_tiles

SCHEMA = "vec_id long, embedding array<double>, label int"


def _brute(rows, threshold=0.93):
    def fit(r):
        return r[2] is not None and bool(r[1]) and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    def linked(a, b):
        if not fit(a) or not fit(b) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array(v[1]) / np.abs(v[1]).max() for v in (a, b))
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold

    near = [[j for j in range(len(rows)) if j != i and linked(rows[i], rows[j])] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out, key=str)


def _clusters(seed, n, d=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in rng.permutation(n).tolist():
        centre = np.random.default_rng(i % 9).standard_normal(d)
        x = (centre + rng.standard_normal(d) * [0.02, 0.15, 0.25][i % 3]) * 10.0 ** rng.integers(-3, 4)
        rows.append((i, x.tolist(), i % 4 if i % 7 else None))
    return rows


@pytest.mark.parametrize("tile_rows", [7, 64, 8192])
def test_against_comparing_all(spark, tile_rows):
    rows = _clusters(1, 220) + [(1000 + i, [1.0, 2.0, *[0.0] * 10], 1) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("h", "n", "id", "node", "component", "d", "far")})
    got = quantised_tiles.near_duplicates(docs, tile_rows=tile_rows).collect()
    want = _brute(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({n for _, n, *_ in want}) > 6


def test_rows_that_take_no_part_and_repeats(spark):
    rows = [(1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [0.0, 0.0], 1), (6, [], 1), (7, [1.0, 1.0], None), (8, [1.0, 1.0], None)]
    rows += [(9, [1.0, 1.0], 1), (9, [1.0, 1.0], 1), (9, [1.0, -1.0], 1), (None, [2.0, 2.0], 1), (None, [-1.0, 0.0], 1), (10, [1.0, 1.0, 0.0], 1), (11, [-0.0, 3.0], 2), (12, [0.0, 3.0], 2)]
    rows += [(13, [1e300, 1e300], 3), (14, [1e-300, 1e-300], 3), (15, [5e-324, 5e-324], 3)]
    got = quantised_tiles.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 8, 10)] + [(9, 2, 9, True)] * 2 + [(9, 0, 9, True), (None, 2, 9, False), (None, 0, None, True), (11, 1, 11, True), (12, 1, 11, False), (13, 2, 13, True), (14, 2, 13, False), (15, 2, 13, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quantised_tiles.near_duplicates(empty).collect() == []
    lone = spark.createDataFrame([(3, [1.0], 1)], SCHEMA)
    assert [tuple(r) for r in quantised_tiles.near_duplicates(lone).collect()] == [(3, 0, 3, True)]


def test_labels_of_text_and_a_chain_across_tiles(spark):
    n = 60
    rows = [(n - i, [float(np.cos(0.3 * i)), float(np.sin(0.3 * i))], "chain") for i in range(n)]
    got = quantised_tiles.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), threshold=float(np.cos(0.31)), tile_rows=5).collect()
    assert {r.component_id for r in got} == {1} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("d", [1, 64, 3000])
def test_bounds_hold(d):
    rng = np.random.default_rng(d)
    x = quantised_tiles.unit(rng.standard_normal((200, d)) * rng.pareto(1, (200, d)))
    y = quantised_tiles.unit(x[:90] + rng.standard_normal((90, d)) * 0.01)
    a, b = quantised_tiles.Codes.of(x), quantised_tiles.Codes.of(y)
    cosine, error = a.bounds(slice(0, 200), b)
    assert (np.abs(cosine - x @ y.T) <= error).all()


@pytest.mark.parametrize("both", [True, False])
def test_pairs_at_the_threshold_are_computed_exactly(both):
    rng = np.random.default_rng(2)
    x = quantised_tiles.unit(rng.standard_normal((150, 16)))
    side = rng.standard_normal((150, 16))
    side = quantised_tiles.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    c = 0.93 + rng.choice([-1e-9, 1e-9], 150)
    y = quantised_tiles.unit(c[:, None] * x + np.sqrt(1 - c * c)[:, None] * side)
    if both:
        near, far, forest = quantised_tiles.links(x, y, np.ones(150, np.int64), np.full(150, 3), 0.93)
        truth = np.einsum("ij,kj->ik", x, y) >= 0.93
    else:
        near, _, forest = quantised_tiles.links(np.concatenate([x, y]), None, np.ones(300, np.int64), np.ones(300, np.int64), 0.93)
        z = np.concatenate([x, y])
        truth = z @ z.T >= 0.93
        np.fill_diagonal(truth, False)
    assert near.tolist() == (truth.sum(axis=1) * (3 if both else 1)).tolist()
    assert all(truth[i, j] for i, j in forest) and len({*map(tuple, forest.tolist())}) == len(forest)
