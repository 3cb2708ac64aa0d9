"""Codebooks against a plain computation, ties, rows that take no part, and the tree against comparing with every entry."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstack.llm import vector_codes
from emberstack.llm.queries import op11_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def _brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label) and the codebooks of usable rows of one dimension, with Python's integers."""
    rows = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    cut = []
    for _, v, _ in rows:
        ints = [int(np.floor(4096 * x)) for x in v]
        w = len(ints) // parts
        cut.append([ints[p * w : (p + 1) * w] for p in range(parts)])
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, xs in own.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), r[2]) for r, f in zip(rows, found)], books


def _check(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("d", "v", "code", "of")}).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_vector_codes(spark, str(tmp_path)).collect()
    want, books = _brute(rows)
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(i, code, error, sums[label], digest) for i, code, error, label in want], key=str)


def test_against_a_plain_computation(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.standard_normal(16).tolist(), [0, 1, None][i % 3]) for i in rng.permutation(300)]
    rows += [(900, None, 1), (901, [None, *[1.0] * 15], 1), (902, [float("nan")] * 16, 2), (903, [float("inf"), *[0.0] * 15], 0), (904, [], 1), (905, [0.0] * 16, None), (906, [-1e-9] * 16, 5)]
    _check(spark, tmp_path, rows)


def test_ties_and_unused_entries(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 8) / 4096).tolist(), 0) for i in range(200)]
    rows += [(300, rows[3][1], 0)] * 5 + [(-1, [0.0] * 8, 0), (-2, [0.0] * 8, 0), (-3, [9.0] * 8, None)]
    _check(spark, tmp_path, rows)


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_rows_than_entries(spark, tmp_path, n):
    _check(spark, tmp_path, [(i, [float(i), *[-1.0] * 7], None) for i in range(n)])


def test_tables_without_usable_rows(spark, tmp_path):
    rows = [(1, None, 1), (None, [1.0] * 7, 2), (2, [], 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op11_vector_codes(spark, str(tmp_path)).collect() == []
    books, coded = vector_codes.train(spark.createDataFrame([], SCHEMA))
    assert not books.entries and vector_codes.encode(coded, books).count() == 0


def test_dimensions_have_codebooks_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8 * (1 + i % 2)).tolist(), 0) for i in range(120)]
    books, coded = vector_codes.train(spark.createDataFrame(rows, SCHEMA))
    got = {r.vec_id: (r.code.hex(), r.error) for r in vector_codes.encode(coded, books).collect()}
    for odd in (0, 1):
        want, plain = _brute(rows[odd::2])
        assert {i: got[i] for i, *_ in want} == {i: (code, error) for i, code, error, _ in want}
        assert books.entries[8 * (1 + odd)].tolist() == plain


def test_huge_components_stop_at_the_widest_integer(spark):
    rows = [(i, [1e300 * (-1) ** i, *[float(i)] * 63], 0) for i in range(20)]
    books, coded = vector_codes.train(spark.createDataFrame(rows, SCHEMA))
    assert np.abs(books.entries[64]).max() == vector_codes.widest(64) == 1 << 27
    assert all(r.error >= 0 for r in vector_codes.encode(coded, books).collect())


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((16, 16))
    rows = [(i, (centres[i % 16] + rng.standard_normal(16) / 1000).tolist(), 0) for i in range(320)]
    books, coded = vector_codes.train(spark.createDataFrame(rows, SCHEMA))
    back = {r.vec_id: r.embedding for r in vector_codes.decode(vector_codes.encode(coded, books), books).collect()}
    assert max(np.abs(np.array(back[i]) - v).max() for i, v, _ in rows) < 0.02


@pytest.mark.parametrize("width,entries", [(1, 16), (3, 1), (8, 16), (8, 200)])
def test_the_tree_finds_the_lowest_of_equally_near_entries(width, entries):
    rng = np.random.default_rng(width * entries)
    book, x = rng.integers(-3, 4, (entries, width)), rng.integers(-4, 5, (3000, width))
    near, far = vector_codes.Tree(book).nearest(x)
    all_far = ((x[:, None] - book) ** 2).sum(axis=2)
    assert near.tolist() == all_far.argmin(axis=1).tolist() and far.tolist() == all_far.min(axis=1).tolist()
