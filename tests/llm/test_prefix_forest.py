"""The forest against brute force: recall at its defaults, dimensions of few rows, tables without usable rows, clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstack.llm import prefix_forest

SCHEMA = "vec_id long, embedding array<float>"


def _brute(rows, q, k=10):
    near = [(float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(rows[q][1], np.float32)) ** 2).sum())), i) for i, v in rows if v is not None and i is not None and i != rows[q][0] and len(v) == len(rows[q][1])]
    return [(i, d) for d, i in sorted(near)[:k]]


def test_recall_at_the_defaults(spark):
    x = np.random.default_rng(4).standard_normal((12000, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in prefix_forest.search(vectors, vectors.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 120 and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in _brute(rows, q)} & set(got[q])) / 10 for q in range(0, 12000, 600)]) >= 0.9


@pytest.mark.parametrize("rare", [1, 12])
def test_a_dimension_of_few_rows_keeps_its_queries(spark, rare):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(6000)] + [(7000 + 100 * i, rng.standard_normal(4).tolist()) for i in range(rare)]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("d", "n", "ask", "block", "rn")})
    got = {}
    for r in prefix_forest.search(vectors, vectors.where("vec_id >= 7000"), sample=64).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(6000, 6000 + rare):
        want = _brute(rows, q)
        assert [i for i, _ in got.get(rows[q][0], [])] == [i for i, _ in want]


def test_tables_without_usable_rows(spark):
    bad = [(i, v) for i, v in enumerate([None, [0.0] * 3, [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, None, 2.0], []] * 500)]
    few = [(10000 + i, [float(i), 1.0, 2.0]) for i in range(6)]
    vectors = spark.createDataFrame(bad + few + [(None, [1.0, 1.0, 1.0])], SCHEMA)
    got = [tuple(r) for r in prefix_forest.search(vectors, vectors.where("vec_id >= 10000")).collect()]
    assert len(got) == 30 and {q for q, *_ in got} == {i for i, _ in few}
    assert [(v, s) for q, _, v, s in sorted(got) if q == 10002] == [(10001, 1.0), (10003, 1.0), (10000, 2.0), (10004, 2.0), (10005, 3.0)]
    assert prefix_forest.search(vectors.where("vec_id < 10000"), vectors).count() == 0
    assert prefix_forest.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_repeated_queries_and_blocks_of_queries(spark, monkeypatch):
    rows = [(i % 40, [float(i), float(i * i % 17), 1.0]) for i in range(80)] + [(3, [3.0, 9.0, 1.0])] * 5
    vectors = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, prefix_forest.search(vectors, vectors, k=3).collect()))
    monkeypatch.setattr(prefix_forest, "QUERY_BYTES", 24 * 20)
    assert sorted(map(tuple, prefix_forest.search(vectors, vectors, k=3).collect())) == whole
    assert len(whole) == 80 * 3 and all(q != v for q, _, v, _ in whole)


def test_huge_numbers(spark):
    rows = [(i, [10.0 ** (300 if i % 2 else 3) * (i + 1), 1.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in prefix_forest.search(vectors, vectors.where("vec_id = 0"), k=2).orderBy("rank").collect()]
    assert got == [2, 4]
