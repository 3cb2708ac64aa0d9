"""Base patterns against their definition, transducers' offsets, and very long texts of one kind."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberstack.llm import private_data
from emberstack.llm.private_data import Tape

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


def _brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("a1.@-+ _\n", max_size=60), st.text("0123456789.", max_size=60), st.text("0123456789 -+()", max_size=80), st.text("ab@.é٣", max_size=40)))
@example("1.2.3.4.5.6.7.8.9 1.2.3.256 01.002.0003.4 1..2.3.4")
@example("4111 1111 1111 1111 4111-1111-1111-1111 a@b.c@d.e x@@y.z q@r .@s.t +12345678+123456789")
def test_base_patterns(text):
    assert private_data.base_spans(text) == _brute(text)


def test_the_query_s_columns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a1.@-+ 0459") for _ in range(200)) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_email": F.lit(9), "spans": F.lit("x")})
    for r in private_data.find(docs).collect():
        base = _brute(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)
        listed = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(",") if r.spans else [])
    assert private_data.find(docs.limit(0)).count() == 0 and private_data.redact(docs.limit(0)).count() == 0


def test_offsets_through_every_tape():
    source = "​call fоur １ or j​o [at] b dot co"
    tape = private_data.plain_characters(Tape(source))
    assert tape.text == "call four 1 or jo [at] b dot co"
    a = tape.text.index("four")
    assert tape.span(a, a + 4) == (6, 10) and source[6:10] == "fоur"
    marked = private_data.marked_disguises(tape)
    assert marked.text == f"call four 1 or jo{private_data.AT}b{private_data.BARE_DOT}co"
    a = marked.text.index("jo")
    assert source[slice(*marked.span(a, len(marked.text)))] == "j​o [at] b dot co"
    assert marked.span(a + 2, a + 3) == (source.index(" [at] "), source.index(" [at] ") + 6)
    again = marked.rewritten([(0, 4, "x"), (5, 9, "4")])
    assert again.text.startswith("x 4 1 or") and again.span(2, 3) == (6, 10)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("pay 4111 1111 one one one one 1111 now", "card", "4111 1111 one one one one 1111"),
    ("ring plus one four eight seven 555 seven two zero nine today", "phone", "plus one four eight seven 555 seven two zero nine"),
    ("host one nine two dot 168 dot zero dot one is up", "ip", "one nine two dot 168 dot zero dot one"),
    ("tel trois trois un deux trois quatre cinq six sept huit", "phone", "trois trois un deux trois quatre cinq six sept huit"),
    ("llame cero uno dos tres cuatro cinco seis siete ocho nueve", "phone", "cero uno dos tres cuatro cinco seis siete ocho nueve"),
    ("x jоhn​ [ at ] exаmple dot com y", "email", "jоhn​ [ at ] exаmple dot com"),
])
def test_rewritten_identifiers(text, kind, found):
    base, every = private_data.all_spans(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == [(kind, found)]


@pytest.mark.parametrize("piece", ["a", "0", "a dot ", "a at ", "0.", "1.2.3.", "one ", "1 ", "@", "a@", "a@b.", "+1 ", "+", "(", "[at]", " ", "а", "٣", "x [dot] ", "a.b [at] c dot d "])
def test_very_long_texts(piece):
    text = piece * (1_000_000 // len(piece))
    for t in (text, text + "z@y.x", "9" * 5000 + ".1.1.1 " + text):
        start = time.process_time()
        private_data.all_spans(t)
        assert time.process_time() - start < 8  # a second or two here; what was quadratic took hours


@pytest.mark.parametrize("text", [
    "we look at the dot com bubble", "good at all dot net things", "count: 1, 2, three, four, 5, 6, 7, 8, 9, 10",
    "one, two, three, four, five, six, seven, eight, nine, zero", "see a\ue000b.c end", "a\ue001b\ue003c",
])
def test_clean_texts_stay_clean(text):
    assert private_data.all_spans(text) == ([], []) and private_data.redacted(text) == text


@pytest.mark.parametrize(("text", "found"), [
    ("see [at] a\ue000b.c or jo [at] b.co end", "jo [at] b.co"), ("write john at example dot com now", "john at example dot com"),
    ("ring five five five, one two three, four five six seven", "five five five, one two three, four five six seven"),
])
def test_disguises_beside_them_are_found(text, found):
    assert found in [text[a:b] for _, a, b in private_data.all_spans(text)[1]]


@pytest.mark.parametrize("piece", ["٣", "\u200b", "а", "！", "٣\u200b", "\ue000"])
def test_twice_the_length_takes_about_twice_the_time(piece):
    def took(n):
        start = time.process_time()
        private_data.all_spans(piece * (n // len(piece)))
        return time.process_time() - start

    short, long = min(took(300_000) for _ in range(3)), min(took(600_000) for _ in range(3))
    assert long < 3 * short + 0.1
