"""Runs and collapsed texts against brute force over every period."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstack.llm import periodic_runs
from emberstack.llm.queries import op12_periodic_runs

SCHEMA = "doc_id long, text string"


def _brute(words, least=6, times=4):
    runs = {}
    for p in range(1, len(words) // times + 1):
        s = 0
        while s + p < len(words):
            e = s
            while e + p < len(words) and words[e] == words[e + p]:
                e += 1
            if e > s and e + p - s >= max(least, times * p):
                runs.setdefault((s, e + p - s), p)
            s = max(e, s) + 1
    runs = sorted((s, n, p) for (s, n), p in runs.items())
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return sorted(runs, key=lambda r: (r[0], r[2])), [w for i, w in enumerate(words) if i not in gone]


def _random_words(rng, n, letters):
    """Stretches repeated within stretches."""
    words: list[str] = []
    while len(words) < n:
        if words and rng.random() < 0.5:
            p = int(rng.integers(1, min(len(words), 12) + 1))
            at = int(rng.integers(0, len(words) - p + 1))
            words += (words[at : at + p] * int(rng.integers(1, 8)))[: int(rng.integers(1, 60))]
        else:
            words.append(f"w{rng.integers(0, letters)}")
    return words[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_of_random_texts(spark, letters):
    rng = np.random.default_rng(letters)
    texts = [_random_words(rng, int(rng.integers(0, 150)), letters) for _ in range(150)]
    gaps = [" ", "  ", "\n", "\t \r"]
    rows = [(i, "".join(f"{gaps[int(rng.integers(0, 4))]}{w}" for w in t) + " " * (i % 2)) for i, t in enumerate(texts)]
    got = periodic_runs.collapse(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        runs, kept = _brute(texts[r.doc_id])
        assert [tuple(x) for x in r.runs] == runs, texts[r.doc_id]
        assert r.collapsed == " ".join(kept) and r.n_words == len(texts[r.doc_id])
        assert r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest()


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, 1), (1, "", 2), (None, "a b " * 9, 3), (None, "a b " * 9, 3), (2, "é é é é é é", 4), (3, " \n ", 5), (4, "a a a a a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumns({c: F.lit("x") for c in ("collapsed", "n_words", "period")})
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.collapse(docs, with_text=True).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, [], ""), (1, 0, [], ""), (None, 18, [(0, 18, 2)], "a b"), (None, 18, [(0, 18, 2)], "a b"), (2, 6, [(0, 6, 1)], "é"), (3, 0, [], ""), (4, 5, [], "a a a a a")], key=str)
    assert periodic_runs.collapse(docs.limit(0)).count() == 0


def test_very_long_texts():
    n = 300_000
    one = np.zeros(n, np.int64)
    assert [x.tolist() for x in periodic_runs.find_runs(one, np.array([0]), np.array([n]))] == [[0], [n], [1]]
    odd = np.arange(n) % 1001
    assert [x.tolist() for x in periodic_runs.find_runs(odd, np.array([0]), np.array([n]))] == [[0], [n], [1001]]
    nested = np.where(np.arange(n) % 50 < 40, 7, np.arange(n) % 50)  # 40 equal words in each of many equal stretches
    start, end, period = periodic_runs.find_runs(nested, np.array([0]), np.array([n]))
    assert len(start) == n // 50 + 1 and (period == 50).sum() == 1 and ((end - start)[period == 1] == 40).all()
    morse = np.array([bin(i).count("1") % 2 for i in range(1 << 13)])  # its halves collide under many hashes; it has no cube
    assert not len(periodic_runs.find_runs(morse, np.array([0]), np.array([1 << 13]))[0])


def test_colliding_hashes_are_found_out(monkeypatch):
    ids = np.array(_random_words(np.random.default_rng(3), 200, 2))
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    want = [x.tolist() for x in periodic_runs.find_runs(ids, np.array([0, 90]), np.array([90, 200]))]
    mask = np.uint64(0x3)
    monkeypatch.setattr(periodic_runs.Sequence, "equal", lambda self, i, p, n: (((self.sums[i + n] - self.sums[i]) * self.power[p]) & mask) == ((self.sums[i + p + n] - self.sums[i + p]) & mask))
    got = periodic_runs._by_every_period(ids, 0, 90, 6, 4)
    assert {tuple(r[:3]) for r in got.tolist()} == {(s, e, p) for s, e, p in zip(*want) if e <= 90}
    found = list(zip(*(x.tolist() for x in periodic_runs.find_runs(ids, np.array([0, 90]), np.array([90, 200])))))
    assert all(periodic_runs._is_run(ids, s, e, p, 0 if e <= 90 else 90, 90 if e <= 90 else 200) for s, e, p in found)


def test_the_query_with_texts_made_periodic(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(_random_words(rng, int(rng.integers(0, 120)), 30))) for i in range(250)] + [(None, "a b a b a b a b"), (7, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.collapsed_sha256): r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs, kept = _brute(words)
        r = got[i, hashlib.sha256(" ".join(kept).encode()).hexdigest()]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    assert changed > 5
