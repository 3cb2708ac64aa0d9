from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberstack.llm import ngram_join as nj


def _set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _brute(rows, k, percent):
    """Least id reachable over rows of non-null ids; rows of an id are one node."""
    sets = [(i, _set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, a) in enumerate(named):
        for j, b in named[n + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    out = []
    for i, s in sets:
        twins = [find(j) for j, t in named if t == s]
        out.append((i, len(s), find(i) if i is not None else min(twins, default=None)))
    return out


def _rows(seed):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(400)}"
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, None), (4, "one"), (5, "One"), (6, "one two"), (7, "two one")]
    n = 10
    for _ in range(18):
        base = [word() for _ in range(int(rng.choice([4, 6, 9, 14, 25, 60, 150, 400])))]
        for _ in range(int(rng.integers(1, 7))):
            text = list(base)
            for _ in range(int(rng.integers(0, max(2, len(text) // 12)))):
                at = int(rng.integers(len(text)))
                if rng.random() < 0.5:
                    text[at] = word()
                elif rng.random() < 0.5:
                    text.insert(at, word())
                else:
                    del text[at : at + 1]
            rows.append((n, " ".join(text).title() if rng.random() < 0.2 else "  ".join(text)))
            n += 1
    rows += [rows[20], rows[25], (30, rows[40][1]), (None, rows[50][1])]
    return rows


@pytest.mark.parametrize("seed, k, percent", [(1, 5, 80), (2, 4, 85), (3, 3, 60)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = _rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "component_id": F.lit(2)})
    got = [tuple(r) for r in nj.near_duplicates(docs, k, percent).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(_brute(rows, k, percent), key=key)
    assert len({r[2] for r in got}) < len(got)


def _components(rows, k, percent):
    """Component numbers of rows, each a document of its own whatever its id."""
    sets = [_set(t, k) for _, t in rows]
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                of = [of[b] if v == of[a] else v for v in of]
    return of


@pytest.mark.parametrize("seed", [4, 5])
def test_deduplicate_keeps_columns_and_one_row_of_each_group(spark, seed):
    rows = _rows(seed)
    rows += [(50, "alpha beta gamma delta epsilon zeta"), (50, "one two three four five six seven"), (50, "alpha beta gamma delta epsilon zeta")]
    rows += [(None, "only without a name it says so"), (None, "only without a name it says so"), (None, rows[0][1]), (51, "one two three four five six seven"), (None, None), (52, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, source string, number int")
    out = nj.deduplicate(docs, 5, 80)
    assert out.columns == docs.columns
    groups = {}
    for (i, t), c in zip(rows, _components(rows, 5, 80)):
        groups.setdefault(c, []).append((i is None, i or 0, t))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()), key=str)
    assert len(got) == len(groups)
    least = sorted((min(x[:2] for x in own) for own in groups.values()))
    assert sorted(x[:2] for x in got) == least
    texts = [{t for _, _, t in own} for own in groups.values() if _set(own[0][2], 5)]
    named = [next(n for n, own in enumerate(texts) if x[2] in own) for x in got if _set(x[2], 5)]
    assert sorted(named) == list(range(len(texts)))  # one row of each group
    again = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in nj.deduplicate(docs, 5, 80).collect()), key=str)
    assert again == got


def test_empty(spark):
    assert nj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_every_linked_pair_shares_as_many_signatures_as_it_must(percent):
    rng = np.random.default_rng(percent)
    bands = nj.Bands(percent)
    for _ in range(300):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = a.copy()
        while True:
            c = b[rng.permutation(len(b))[1:]] if rng.random() < 0.5 else np.append(b, rng.integers(0, 2**63, 1).astype(np.uint64))
            common = len(np.intersect1d(a, c))
            if len(c) == 0 or 100 * common < percent * (len(a) + len(c) - common) or rng.random() < 0.01:
                break
            b = c
        (sa, ta), (sb, tb) = nj.signatures_of(np.sort(a), bands), nj.signatures_of(np.sort(b), bands)
        shared, ia, ib = np.intersect1d(sa, sb, return_indices=True)
        if len(a) and len(b):
            ok = [np.sum(ta[ia] // nj.NEED == band) >= max(ta[ta // nj.NEED == band].max() % nj.NEED, tb[tb // nj.NEED == band].max() % nj.NEED) for band in set(ta // nj.NEED) & set(tb // nj.NEED)]
            assert any(ok), (len(a), len(b))


def test_short_templated_documents_stay_within_memory(spark):
    """Documents of few words that share most of their shingles: many signatures in common, few links."""
    rows = [(i, f"order number {i} was sent to the house of person {i * 7919 % 100000} on day {i % 28}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nj.near_duplicates(docs, 2, 50).collect()}
    sets = [_set(t, 2) for _, t in rows]
    by_day = {}
    for i in range(6000):
        by_day.setdefault(i % 28, []).append(i)
    assert 100 * len(sets[0] & sets[28]) >= 50 * len(sets[0] | sets[28]) and 100 * len(sets[0] & sets[29]) < 50 * len(sets[0] | sets[29])
    assert all(got[i] == got[day[0]] for day in by_day.values() for i in day)


def test_links_in_strips(monkeypatch):
    rows = _rows(9)
    texts = nj.pa.array([t for _, t in rows])
    whole = nj.links_of(texts, 4, 70)
    monkeypatch.setattr(nj, "CELLS", 1)
    assert nj.links_of(texts, 4, 70) == whole


def test_frequent_signatures_are_spread(spark, monkeypatch):
    rows = _rows(5)
    want = sorted(map(str, _brute(rows, 4, 70)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nj, "_frequent_slots", lambda *a: np.arange(0, nj.SLOTS, 2))
    assert sorted(str(tuple(r)) for r in nj.near_duplicates(docs, 4, 70).collect()) == want


def test_frequent_slots_are_found(spark):
    docs = spark.createDataFrame([(i, "the same ten words stand in every one of these") for i in range(64 * 100)], "doc_id long, text string").repartition(200)
    assert len(nj._frequent_slots(docs, 4, 85)) > 0
