"""The pipeline's stages on a small corpus with nulls, repeated rows and clashing names, each against what it must keep."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus() -> list[tuple]:
    rng = np.random.default_rng(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    good = {i: " ".join(rng.choice(words, 60)).capitalize() + ". Another plain sentence follows it." for i in range(120)}
    bad = {1000 + i: f"BUY!! N{i}!! NOW$$$ %%% *** " * 8 for i in range(120)}
    more = {200: good[0] + " with its end", 201: good[0], 202: good[1] + " " + good[2], 203: good[3][::-1].replace(".", "") + " Mail ann@site.org today.", 204: good[4] + " " + " ".join(rng.choice(words, 3000))}
    rows = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t)) for i, t in {**good, **bad, **more}.items()]
    return rows + [(None, good[5] + " once more", None, "a", None), (300, None, None, None, None), (301, "", "en", "b", 0), (7, good[7], "en", "a", 1)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    clash = {c: F.lit(3) for c in ("score", "size", "node", "sig", "copies", "length", "text_1")}
    spark.createDataFrame(_corpus(), SCHEMA).withColumns(clash).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(r[0] < 1000), 0) for r in _corpus() if r[0] is not None and (r[0] < 120 or r[0] >= 1000)]
    spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "private_data", "mixing", "packing"]

    kept = stages["quality"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(120)) <= ids and not any(i is not None and i >= 1000 for i in ids)

    rows = kept.collect()
    sets = [_shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root = [root[b] if v == root[a] else v for v in root]
    least = {}
    for r, c in zip(rows, root):
        least[c] = min(least.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    single = stages["near_copies"](spark, kept, sf_dir)
    assert single.columns == docs.columns
    got = [(r.doc_id is None, r.doc_id or 0) for r in single.collect()]
    assert Counter(got) == Counter(least.values())
    assert (False, 200) not in got and (False, 201) not in got and (True, 0) not in got

    clean = stages["private_data"](spark, single, sf_dir)
    assert clean.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (single, clean))
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {203} & set(before) and all("[email]" in after[i] for i in changed)

    mixed = stages["mixing"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    times = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    assert max(times.values()) <= 2 and {k[0] for k in times} <= set(after)
    total = sum(len((t or "").split()) for t in after.values())
    longest = max(len((t or "").split()) for t in after.values())
    assert 1.5 * total - 4 * longest <= sum(n * len((k[2] or "").split()) for k, n in times.items()) <= 1.5 * total

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = Counter()
    for (i, _, text), n in times.items():
        size[i] += n * (len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1)
    found, bins = Counter(), {}
    for r in packed:
        found[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == size
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
