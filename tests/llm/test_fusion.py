"""Quality votes and language evidence against plain Python that says the same."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from emberstack.llm import language_id, quality


def _terms(text: str) -> dict[int, float]:
    raw = text.encode()
    words = raw.split()
    code = [int(quality.CLASS[b]) for b in raw]
    out = Counter((a * 13 + b) * 13 + c for a, b, c in zip(code, code[1:], code[2:]))
    for k in (1, 2, 3):
        same = sum(x == y for x, y in zip(words, words[k:]))
        if same:
            out[13**3 + k - 1] = 6.0 * same
    total = sum(out.values())
    return {t: math.sqrt(n / max(total, 1)) for t, n in out.items()}


def _dense(text: str) -> np.ndarray:
    v = np.zeros(quality.TERMS)
    for t, x in _terms(text).items():
        v[t] = x
    return v


def _texts(rng) -> list[str]:
    words = "alpha beta Gamma delta, epsilon. zeta eta 42 theta!! iota kappa über naïve the the the".split()
    return [" ".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(90)] + ["", " ", "a", "€uro 12", "x" * 5000]


def test_votes(spark):
    texts = _texts(np.random.default_rng(8))
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(500, None, "z")] + [(3, texts[3], "z")] * 50, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 0), (70, None)], "doc_id long, quality int")
    import zlib

    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = quality.train(docs, labels, dimensions=12, neighbours=5)
    assert len(model.labels) == len(learned)  # copies of a row are one
    rows = np.stack([_dense(texts[i]).astype(np.float16).astype(float) for i in learned])
    y = np.array([min(i % 2, 1) for i in learned], float)
    _, directions = np.linalg.eigh(rows.astype(np.float32).T @ rows.astype(np.float32))
    directions = model.directions.astype(float)  # their signs and the basis of equal values are free
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    base = np.stack([unit(r @ directions) for r in rows])
    got = {r.doc_id: r.found for r in quality.score(docs, model, ["doc_id"], "found").collect()}
    for i, t in [*enumerate(texts), (500, "")]:
        near = base @ unit(_dense(t) @ directions)
        top = np.argsort(-near)[:5]
        sim = np.maximum(near[top], 0) ** 16
        want = float((sim * y[top]).sum() / sim.sum()) if sim.sum() > 1e-9 else float(y.mean())
        cut = np.sort(-near)
        if cut[5] - cut[4] > 1e-5:  # no tie at the last neighbour
            assert abs(got[i] - want) < 1e-3, i
    assert quality.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_blocks_bound_memory(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 3000)], ["text"])
    from emberstack.llm.hashing import slices

    assert max(len(b) for b in slices([batch], rows=quality.BLOCK)) == quality.BLOCK and sum(len(b) for b in slices([batch], rows=quality.BLOCK)) == 3000


def test_evidence(spark):
    rng = np.random.default_rng(6)
    words = {"de": "das haus und der garten mit wasser nicht ist", "en": "the house and garden with water not is", "fr": "la maison et le jardin avec eau ne pas"}
    docs = [(k * 100 + i, " ".join(rng.permutation(w.split() * 2)), x) for k, (x, w) in enumerate(words.items()) for i in range(30)]
    model = language_id.train(spark.createDataFrame([*docs, (None, "zzz", "en"), (9999, None, "en"), (9998, "q", None)], "doc_id long, text string, lang string"))
    counts = {x: Counter() for x in words}
    for _, t, x in docs:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            counts[x][((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16] += 1
    for k, x in enumerate(model.languages):
        own = np.full(language_id.SLOTS, 0.5)
        for slot, n in counts[x].items():
            own[slot] += n
        assert np.allclose(model.table[k], np.log(own / own.sum()), atol=1e-5)

    hosts = ["a.x.de", "b.x.de", "y.de", "c.com", "d.c.com", "plain", "e.fr.", "", None]
    units = []
    for i in range(150):
        x = ["de", "en", "fr"][int(rng.integers(3))]
        text = [" ".join(rng.choice(words[x].split(), 6)), "", None, "la das the", "ab"][int(rng.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]
        units.append((i, text, hosts[int(rng.integers(len(hosts)))], [x, "de", None][int(rng.integers(3))], "clash"))
    units.append((200, "das haus " * 100_000, "a.x.de", None, "clash"))
    df = spark.createDataFrame(units, "p long, text string, host string, declared string, w string")
    got = {r.p: r for r in language_id.identify(df, model, ["p", "w"]).collect()}
    assert len(got) == len(units) and got[0].w == "clash"

    langs, n, strength = model.languages, 3, 20.0
    p = {u[0]: model.posterior(pa.array([u[1]], pa.string()))[0] for u in units}
    sums = defaultdict(lambda: np.zeros(n))
    keys = {}
    for i, _, host, said, _ in units:
        bare = None if host is None else host.rstrip(".")
        suffix = bare.rsplit(".", 1)[-1] if bare and "." in bare else None
        domain = None if bare is None else ".".join(bare.split(".")[-2:])
        keys[i] = [("all",), suffix is not None and ("s", suffix), domain is not None and ("d", domain), host is not None and ("h", host)]
        for k in keys[i]:
            if k:
                sums[k] += p[i]
        if said is not None:
            sums[("said", said)] += p[i]
    kinds = [k for k in sums if k[0] == "said"]
    any_ = sum(sums[k] for k in kinds)
    for i, _, _, said, _ in units:
        q = (sums[("all",)] - p[i] + 1) / (sums[("all",)].sum() - 1 + n)
        for k in keys[i][1:]:
            if k:
                q = (np.maximum(sums[k] - p[i], 0) + strength * q) / (max(sums[k].sum() - 1, 0) + strength)
        w = p[i] * q
        if said is not None:
            w = w * (np.maximum(sums[("said", said)] - p[i], 0) + 1) / (np.maximum(any_ - p[i], 0) + len(kinds))
        best = int(np.argmax(w))
        assert abs(got[i].confidence - w[best] / w.sum()) < 1e-6 and got[i].lang == langs[best] and got[i].text_lang == langs[int(np.argmax(p[i]))], i


def test_ties_go_to_the_first_language_and_no_rows_give_none(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, "abc", "de")], "doc_id long, text string, lang string")
    units = spark.createDataFrame([(1, "abc", None, None)], "id long, text string, host string, declared string")
    model = language_id.train(docs)
    assert language_id.identify(units, model, ["id"]).first().lang == "de"
    assert language_id.identify(units.limit(0), model, ["id"]).count() == 0
    none = language_id.identify(units, language_id.train(docs.limit(0)), ["id"]).first()
    assert none.lang is None and language_id.train(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []
