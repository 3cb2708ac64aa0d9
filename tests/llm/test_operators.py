"""Small cases of the other operators against brute force: nulls, empty texts and tables, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emberstack.llm import fair_mix, host_reputation, language_id, prefix_forest, private_data, quality, queries, spot_signatures, substring_dedup

DOCS = "doc_id long, text string, source string, lang string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], DOCS).withColumns({"rk": F.lit(1), "p": F.lit(2), "size": F.lit("x")})


def _key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_substring_dedup(spark):
    rng = np.random.default_rng(3)
    prose = [f"w{x}" for x in rng.integers(0, 5000, 900)]
    shared = prose[:50]
    rows = [(1, " ".join(prose[:200])), (2, " ".join([*prose[300:360], *shared, *prose[400:450]])), (3, "\t\n".join(shared)), (4, " ".join(prose[500:534])), (5, " ".join(prose[500:534])), (6, None), (7, ""), (8, "a " * 80), (9, " ".join(prose[600:700])), (9, " ".join(prose[600:700])), (None, " ".join(prose[620:660])), (10, " ".join(prose[700:900]))]
    words = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, words):
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(_docs(spark, rows)).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert substring_dedup.remove_repeats(_docs(spark, rows).limit(0)).count() == 0


def test_fair_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None], 400, p=[0.5, 0.2, 0.1, 0.1, 0.1]).tolist())]
    rows += [(None, "x y", "a"), (None, None, None), (5, "", "a"), (5, "", "a")]
    got = fair_mix.mix(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target = {r.source: r.target for r in got}
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 and all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 80 for s in size)
    again = fair_mix.mix(_docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(map(tuple, again), key=_key)
    assert fair_mix.mix(_docs(spark, rows).limit(0)).count() == 0


def test_host_reputation(spark):
    urls = ["http://A.Example.net/en/x", "https://example.net/de/", "x://a.example.com/de/1?q", "http://b.org/fr/", "http://net", "nothing", None, "http://bad.info/x#y", "://e.com"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://bad.info/") for i in range(30)] + [(200 + i, "http://good.info/") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(200 + i, 0) for i in range(30)] + [(None, 1), (7, None)], "page_id long, bad int")
    got = {r.page_id: r for r in host_reputation.judge(pages, outcomes).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/de/", "net/"), ("a.example.com", "/de/1", "example.com/de/"), ("b.org", "/fr/", "org/fr/"),
        ("net", "", None), ("", "", None), ("", "", None), ("bad.info", "/x", None), ("e.com", "", None)]
    assert [got[i].verdict for i in (0, 1, 2, 3, 7, 200)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert host_reputation.judge(pages.limit(0), outcomes).count() == 0


def test_sites_domains_and_suffixes(spark):
    known = {  # host: site, registered domain, suffix
        "a.com:8080": ("a.com", "a.com", "com"), "u:p@w.a.com": ("w.a.com", "a.com", "com"), "a.com.": ("a.com", "a.com", "com"), "10.1.2.3:80": ("10.1.2.3", "10.1.2.3", "[address]"),
        "[::1]:80": ("[::1]", "[::1]", "[address]"), "x.a.co.uk": ("x.a.co.uk", "a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"), "a.or.jp": ("a.or.jp", "a.or.jp", "or.jp"),
        "b.com": ("b.com", "b.com", "com"), "localhost": ("localhost", "localhost", "localhost"), "": ("", "", ""), "...": ("", "", ""), "1.2.3": ("1.2.3", "2.3", "3"), "m.b.city.tokyo": ("m.b.city.tokyo", "city.tokyo", "tokyo"),
        "a\nb.com": ("a\nb.com", "a\nb.com", "com"), "u@v@a.com:": ("a.com", "a.com", "com")}
    rows = spark.createDataFrame([(h,) for h in known], "host string").withColumn("site", host_reputation.site_of(F.col("host")))
    found = rows.select("host", "site", host_reputation.registered_domain(F.col("site")), host_reputation.suffix_of(F.col("site"))).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == known
    own = rows.where("site = 'm.b.city.tokyo'").select(host_reputation.registered_domain(F.col("site"), ["city.tokyo"]), host_reputation.suffix_of(F.col("site"), ["city.tokyo"])).first()
    assert tuple(own) == ("b.city.tokyo", "city.tokyo")


def test_ports_and_users_share_a_reputation_and_sql_says_the_same(spark, tmp_path):
    sites = ["bad.info:81", "u@bad.info", "bad.info.", "10.0.0.1:9", "10.0.0.2", "w.good.co.uk", "good.co.uk", "bad.co.uk", "[::1]", "", "localhost:1"]
    urls = [f"http://{sites[i % len(sites)]}/{'x' * (i % 3)}" for i in range(330)] + ["http://bad.info/" + "y" * 300_000, None, "none"]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    labels = pd.DataFrame({"doc_id": range(330), "quality": [0 if "bad" in u or i % 7 == 0 else 1 for i, u in enumerate(urls[:330])]})
    pages.to_parquet(tmp_path / "pages.parquet")
    labels.to_parquet(tmp_path / "labels.parquet")
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.SQL['op5_host_reputation']})").fetchall()
    got = queries.QUERIES["op5_host_reputation"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    verdicts = {r.host: r.verdict for r in got}
    assert {verdicts[h] for h in ("bad.info:81", "u@bad.info", "bad.info.", "bad.info", "bad.co.uk")} == {"block"} and verdicts["good.co.uk"] == "allow"


def test_private_data(spark):
    text = "a.b@x.co, 1.2.3.4 and 999.1.1.1 or 4111 1111 1111 1111 not 4111111111111112 but +1 (487) 555-7209 nor +12"
    base, every = private_data.all_spans(text)
    assert base == every and [(k, text[a:b]) for k, a, b in base] == [("email", "a.b@x.co"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (487) 555-7209")]
    hidden = {"mail john [at] site (dot) org now": "john [at] site (dot) org", "jane dot doe at site dot org": "jane dot doe at site dot org", "tell jоhn@ехample.com": "jоhn@ехample.com", "call plus four nine one five one two three four five six now": "plus four nine one five one two three four five six", "ip １２.0.0.１ end": "１２.0.0.１"}
    for t, want in hidden.items():
        base, every = private_data.all_spans(t)
        assert [t[a:b] for _, a, b in every] == [want], t
    for clean in ("meet at noon", "one two three four", "connect the dot at once", "at the dot com boom", "", "the value 12 of 3"):
        assert private_data.all_spans(clean) == ([], [])
    out = private_data.find(_docs(spark, [(1, text), (1, text), (None, None)])).collect()
    assert [tuple(r)[:5] for r in out] == [(1, 1, 1, 1, 1)] * 2 + [(None, 0, 0, 0, 0)]
    red = private_data.redact(_docs(spark, [(1, "x a@b.cd y"), (2, None)])).collect()
    assert [r.text for r in red] == ["x [email] y", None] and len(red[0]) == 7


def test_every_spelled_run_and_every_digit():
    said = "five five five zero one nine two eight three four".split()
    bengali, maths = "".join(chr(0x9E6 + int(c)) for c in "5550192834"), "".join(chr(0x1D7CE + int(c)) for c in "5550192834")
    thai = ".".join("".join(chr(0xE50 + int(c)) for c in n) for n in ("10", "20", "30", "40"))
    runs = ["-".join(said), "\n".join(said), "\r\n".join(said), "-".join(said).upper(), " ".join(["four 4"] * 5), "\tnull, null".join(["", "", "", "", "", ""]).strip()]
    for kind, hidden in [*(("phone", x) for x in runs), ("phone", f"+{bengali}"), ("phone", f"+{maths}"), ("ip", thai)]:
        for t in (hidden, f"call {hidden}", f"call\n{hidden}\nnow"):
            assert [(k, t[a:b]) for k, a, b in private_data.all_spans(t)[1]] == [(kind, hidden)], t
    assert private_data.redacted(f"call {runs[0]} or +{bengali}!") == "call [phone] or [phone]!"


def test_disguised_span_around_a_plain_one():
    for kind, plain, whole in [
        ("email", "hn.doe@example.com", "j\u043ehn.doe@example.com"), ("email", "hn@example.com", "jo\u200bhn@example.com"), ("email", "doe@example.com", "john [dot] doe@example.com"),
        ("email", "doe@mail.example", "j.john (dot) doe@mail.example [dot] com"), ("email", "jo@mail.example", "jo@mail.example [dot] com"),
        ("phone", "+1 487 555 72", "+1 487 555 72\u200b09"), ("phone", "+1 487 555 72", "+1 487 555 72\uff10\uff19"), ("ip", "2.3.4.5", "\uff112.3.4.5"),
    ]:
        t = f"write {whole} now"
        base, every = private_data.all_spans(t)
        assert [(k, t[a:b]) for k, a, b in base] == [(kind, plain)], t
        assert sorted((k, t[a:b]) for k, a, b in every) == sorted([(kind, plain), (kind, whole)]), t
        assert private_data.redacted(t) == f"write [{kind}] now"


def test_quality(spark):
    good, bad = [(i, f"A plain sentence number {i}, with words. And another one." * (1 + i % 3)) for i in range(60)], [(100 + i, f"BUY!! N{i}!! NOW$$$ %%% ***" * (1 + i % 3)) for i in range(60)]
    docs = _docs(spark, [*good, *bad, (500, None), (501, "")])
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in [*good, *bad]] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert all(got[i] >= 0.7 for i, _ in good) and all(got[i] < 0.3 for i, _ in bad) and 0 <= got[500] == got[501] <= 1
    assert quality.score(docs, quality.train(docs, labels.limit(0)), ["doc_id"]).first().score == 0.5


def test_spot_signatures(spark):
    rows = [(3, "the cat sat on a mat by night"), (1, "the dog ran of the hill over two rivers"), (7, None), (5, ""), (9, "x"), (3, "the cat sat on a mat by night"), (None, "was it the last of many small things")]
    docs = _docs(spark, rows)
    order = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    want = []
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    for ranges in (1, 3, 50):
        got = spot_signatures.fingerprints(docs, ranges).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert spot_signatures.fingerprints(docs.limit(0)).count() == 0
    text = " ".join(f"the w{i} x{i} y{i}" for i in range(60))
    near = {r.doc_id: (r.class_id, r.links) for r in spot_signatures.near_duplicates(_docs(spark, [(1, text), (2, text), (3, text + " the end all good things here"), (4, "of other things entirely here")])).collect()}
    assert near == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0)}


def test_language_id(spark):
    words = {"en": "the house and garden with water", "de": "das haus und der garten mit wasser", "fr": "la maison et le jardin avec eau"}
    docs = _docs(spark, [(k * 50 + i, " ".join(np.random.default_rng(i).permutation(w.split() * 4)), "s", x) for k, (x, w) in enumerate(words.items()) for i in range(40)])
    model = language_id.train(docs)
    units = spark.createDataFrame([(1, words["de"], "h.de", "de"), (2, None, "h.de", "de"), (3, words["fr"], None, None), (4, "", None, None)] + [(10 + i, words["de"], "h.de", "de") for i in range(30)], "id long, text string, host string, declared string")
    got = {r.id: r for r in language_id.identify(units, model, ["id"]).collect()}
    assert len(got) == 34 and got[1].lang == got[2].lang == "de" and got[3].lang == "fr" and 0 < got[4].confidence <= 1
    assert language_id.identify(units.limit(0), model, ["id"]).count() == 0


def test_a_host_that_ends_in_a_dot_doubles_no_row(spark):
    docs = _docs(spark, [(k * 20 + i, f"{w} {i}", "s", x) for k, (x, w) in enumerate({"en": "the house and garden", "de": "das haus und der garten"}.items()) for i in range(20)])
    hosts = ["example.com.", "example.com", "a.example.com..", "b.de", "plain", "other", "plain.", ".", "", None]
    units = spark.createDataFrame([(i, "das haus", h, None) for i, h in enumerate(hosts * 2)], "id long, text string, host string, declared string")
    got = language_id.identify(units, language_id.train(docs), ["id"]).collect()
    assert sorted(r.id for r in got) == list(range(20)) and {r.lang for r in got} == {"de"}


def test_prefix_forest(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((20, 16))
    x = (centre[rng.integers(0, 20, 3000)] + 0.2 * rng.standard_normal((3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, []), (None, x[0].tolist())] + [(5000 + i, x[7].tolist()) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in prefix_forest.search(vectors, vectors.where("vec_id % 100 = 0"), share=0.02, least=50).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids = np.array([*range(3000), *range(5000, 5030)])
    full = np.concatenate([x, np.repeat(x[7:8], 30, axis=0)]).astype(np.float64)
    hits = []
    for q in range(0, 3000, 100):
        d = np.sqrt(((full - full[q]) ** 2).sum(1))
        keep = ids != q
        top = np.lexsort((ids[keep], d[keep]))[:10]
        hits.append(len(set(ids[keep][top]) & {v for v, _ in got[q].values()}) / 10)
    assert np.mean(hits) >= 0.9 and set(got) == {*range(0, 3000, 100), 5000}
    assert [got[5000][k] for k in range(1, 11)] == [(7, 0.0), *((5000 + i, 0.0) for i in range(1, 10))]


def test_base_patterns_match_their_definition():
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    text = "a@b.c@d.e x@@y.z q@r .@s.t"
    assert [s[1:] for s in private_data.base_spans(text)] == [m.span() for m in pattern.finditer(text)]
