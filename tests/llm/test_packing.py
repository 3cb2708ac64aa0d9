from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstack.llm import packing
from emberstack.llm.queries import public_tokenizer

TEXTS = ["", None, "a", "Hello  world \n\n and\tmore ", "x" * 300, "It's <|endoftext|> here", "word " * 3000, " lead", "trail ", "é à b  12 345!!\nNew", "a  b", "one\x1c two", "the the\n the"]


def _ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizer()["tokenizers_file"]).encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_encoder_equals_tokenizers():
    encode = packing.Encoder(**public_tokenizer(), remember=20)
    for _ in range(2):
        for text, body in zip(TEXTS, encode([t or "" for t in TEXTS])):
            assert np.frombuffer(body, "<u4").tolist() == _ids(text)[:-1], repr(text)


def test_pack_covers_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "again"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    out = packing.pack(packing.pieces(docs, **public_tokenizer())).collect()
    want = []
    for i, t in rows:
        ids = _ids(t)
        n = len(ids)
        edges = [0, *range(n % 1024 or 1024, n + 1, 1024)] if n > 1024 else [0, n]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in out), key=key) == sorted(want, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024


def test_empty(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), **public_tokenizer())).count() == 0


def _optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= items[k] and bins[b] not in bins[:b]:
                bins[b] -= items[k]
                go(k + 1, bins)
                bins[b] += items[k]
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = 20
    items = rng.integers(1, capacity + 1, 9).tolist()
    count = np.bincount(items, minlength=capacity + 1)
    fixed = packing.reduce_by_dominance(count, capacity)
    left = [w for w in range(capacity + 1) for _ in range(int(count[w]))]
    done = [w for n, held in fixed for w in held * n]
    assert sorted(done + left) == sorted(items)
    assert all(sum(held) <= capacity for _, held in fixed)
    assert sum(n for n, _ in fixed) + _optimum(left, capacity) == _optimum(items, capacity)


def test_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5.5, 1, 20000).astype(int) + 1, 1024)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    places = packing.plan(histogram, 1024)
    count = np.zeros(1025, np.int64)
    for k, n in histogram.items():
        count[k] = n
    bins = sum(n for n, _ in packing.reduce_by_dominance(count, 1024) + packing.best_fit(count, 1024))
    assert bins <= np.ceil(lengths.sum() / 1024) * 1.01
    assert sum(len(p) for p in places.values()) < 20000
