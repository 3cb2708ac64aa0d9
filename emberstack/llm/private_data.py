"""Personal data in text, also where it is disguised, with spans in the source's code points.

Base patterns find plain identifiers. Then transducers rewrite the text onto tapes. A tape holds, for each character it
was written, the span of the source that the character stands for, whatever was rewritten before; so an identifier
detected on a tape is mapped back to the source by the spans of its first and last character.

- characters: look-alike letters, full-width forms and other scripts' digits become plain, invisible ones go;
- at and dot: disguises such as " [at] " or " dot " become single marks;
- spelled digits: in runs of digits and digit words, words become digits and what parts them one space, or nothing.

Everything is linear in the text: an address is read outward from its at, an ip from the run of digits and dots it is in.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from emberstack.llm.hashing import slices

KINDS = ("email", "ip", "card", "phone")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alike letters of other scripts and the Latin letters they stand for.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαονικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaovikptuxABEZHIKMNOPTYX"))
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
# Digit words of English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# The second part is every decimal digit but ASCII's.
ODD = re.compile(rf"[{''.join(LOOKALIKES)}{INVISIBLE}！-～\ue000-\ue003]|[^\D0-9]")
# What the at and dot transducer writes: marks of private use, so that a tape still says how plainly a character was written. In a
# source they become the replacement character first.
AT, BARE_AT, DOT, BARE_DOT = "\ue000", "\ue001", "\ue002", "\ue003"
HIDDEN = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:(?P<at>at)|(?P<dot>dot))\s{0,3}[\])}>]\s{0,3}|\s{1,3}(?:(?P<bare_at>at)|(?P<bare_dot>dot))(?=\s)\s{1,3}", re.IGNORECASE)
HINT = re.compile(r"[\[({<]\s{0,3}(?:at|dot)\s{0,3}[\])}>]|\sdot\s", re.IGNORECASE)
NAMED = re.compile(rf"[A-Za-z0-9_%+-]+(?:[.{DOT}{BARE_DOT}][A-Za-z0-9_%+-]+)*")
HOSTED = re.compile(rf"[A-Za-z0-9-]+(?:[.{DOT}{BARE_DOT}][A-Za-z0-9-]+)+")
ANY_AT = re.compile(rf"[@{AT}{BARE_AT}]")
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus\s+|\+\s?)?(?:{_WORD}|[0-9]+)(?:(?:[\s,-]{{1,2}}|\s(?:dot|point)\s)(?:{_WORD}|[0-9]+))+(?!\w)", re.IGNORECASE)
_NUMBER = re.compile(rf"{_WORD}|[0-9]+", re.IGNORECASE)
_PART = re.compile(rf"{_WORD}|[0-9]|dot|point|plus|\+", re.IGNORECASE)

# Words that a sentence has after its own "at", so that what follows is no host ("look at the dot com bubble").
NO_HOST = frozenset("the a an this that these those my our your his her its their all any some every each most least first last what which where".split())

Span = tuple[str, int, int]


class Tape:
    """What a transducer wrote, and for each character the span of the source it stands for (None: the source itself)."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """A tape on which each ``(from, to, with)``, in order and apart, is replaced; the new characters stand for the replaced."""
        if not edits:
            return self
        starts, ends = (range(len(self.text)), range(1, len(self.text) + 1)) if self.starts is None else (self.starts, self.ends)
        out, at, upto, done = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[done:a], new]
            at += starts[done:a]
            upto += ends[done:a]
            if new:
                first, last = self.span(a, b)
                at += [first] * len(new)
                upto += [last] * len(new)
            done = b
        out.append(self.text[done:])
        return Tape("".join(out), [*at, *starts[done:]], [*upto, *ends[done:]])

    def found(self, spans: list[Span]) -> list[Span]:
        return [(k, *self.span(a, b)) for k, a, b in spans]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local part, at and two labels or more, each read outward from its at."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := LABELS.match(text, at + 1)):
            out.append(("email", a, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def _ips(text: str) -> list[Span]:
    """Of a run of numbers and dots every four numbers from the left; those with a part above 255 are dropped."""
    out = []
    for run in NUMBERS.finditer(text):
        parts = run[0].split(".")
        a = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            b = a + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in four):
                out.append(("ip", a, b))
            a = b + 1
    return out


def base_spans(text: str) -> list[Span]:
    """Plain identifiers, in the order of KINDS and then of their start; leftmost, non-overlapping within a kind."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    if DIGIT.search(text):
        if text.count(".") > 2:
            out += _ips(text)
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = "".join(DIGIT.findall(m[0]))
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c in (AT, BARE_AT, DOT, BARE_DOT):
        return "\ufffd"
    return str(unicodedata.digit(c))


def plain_characters(tape: Tape) -> Tape:
    """Look-alikes, full-width forms and digits made plain, invisible characters gone. What is one character for one is
    translated all at once, as no span changes; only runs of characters that go are edits."""
    if tape.text.isascii():
        return tape
    plain = {ord(c): _plain(c) for c in set(tape.text) if ODD.match(c)}
    if not plain:
        return tape
    text = tape.text.translate({c: p for c, p in plain.items() if p})
    gone = "".join(chr(c) for c, p in plain.items() if not p)
    told = Tape(text, tape.starts, tape.ends)
    return told.rewritten([(m.start(), m.end(), "") for m in re.finditer(f"[{gone}]+", text)]) if gone else told


def marked_disguises(tape: Tape) -> Tape:
    """Disguises of at and dot as marks."""
    marks = {"at": AT, "dot": DOT, "bare_at": BARE_AT, "bare_dot": BARE_DOT}
    return tape.rewritten([(m.start(), m.end(), marks[m.lastgroup]) for m in HIDDEN.finditer(tape.text)])


def disguised_emails(tape: Tape) -> list[Span]:
    """Addresses on a tape of marks. A bracketed at may have any dots; a bare one needs a disguised dot in its domain, a plain
    one a bracketed dot somewhere or any disguised one in its domain. After a bare at no article or the like is a host."""
    text, out, done = tape.text, [], 0
    for m in ANY_AT.finditer(text):
        at = m.start()
        a = at
        while a > done and (text[a - 1] in LOCAL or text[a - 1] in (DOT, BARE_DOT)):
            a -= 1
        host = HOSTED.match(text, at + 1)
        if a == at or not host:
            continue
        # The name is the last part of what is before the at that has no two dots together.
        name = None
        for name in NAMED.finditer(text, a, at):
            pass
        if name is None or name.end() != at:
            continue
        shown = text[name.start() : host.end()]
        if m[0] == BARE_AT and re.match("[A-Za-z0-9-]+", host[0])[0].lower() in NO_HOST:
            continue
        if m[0] == AT or any(c in (DOT, BARE_DOT) for c in host[0]) or m[0] == "@" and DOT in shown:
            out.append(("email", name.start(), host.end()))
            done = host.end()
    return tape.found(out)


def spelled_numbers(tape: Tape) -> list[Span]:
    """Identifiers in runs of digits of which two or more are spelled. A run is rewritten twice: what parts digits as one space,
    for cards and phones, or as nothing, for ips. A run of 10 to 15 digits is a phone without a plus too, unless most of its
    numbers are parted by commas, as those of a list are."""
    out: list[Span] = []
    for run in SPELLED_RUN.finditer(tape.text):
        parts = [(m.start() + run.start(), m.end() + run.start(), m[0].lower()) for m in _PART.finditer(run[0])]
        if sum(p in SPELLED for *_, p in parts) < 2:
            continue
        said = [(a, b, {"dot": ".", "point": ".", "plus": "+"}.get(p, SPELLED.get(p, p))) for a, b, p in parts]
        digits = "".join(c for *_, c in said if c.isdigit())
        own: list[Span] = []
        if any(c == "." for *_, c in said):
            joined = _written(tape, said, "")
            own = joined.found([s for s in base_spans(joined.text) if s[0] == "ip"])
        else:
            spaced = _written(tape, said, " ")
            own = spaced.found([s for s in base_spans(spaced.text) if s[0] in ("card", "phone")])
            listed = 2 * run[0].count(",") >= len(_NUMBER.findall(run[0])) - 1
            if not own and 10 <= len(digits) <= 15 and not listed:
                own = [("phone", *tape.span(run.start(), run.end()))]
        out += own
    return out


def _written(tape: Tape, said: list[tuple[int, int, str]], between: str) -> Tape:
    """A tape of the characters ``said``, with ``between`` where digits were apart on ``tape``."""
    text, starts, ends, before = [], [], [], None
    for a, b, c in said:
        if before is not None and between and a > before[1] and before[2].isdigit():
            text.append(between)
            starts.append(tape.span(before[0], before[1])[1])
            ends.append(tape.span(a, b)[0])
        text.append(c)
        first, last = tape.span(a, b)
        starts.append(first)
        ends.append(last)
        before = (a, b, c)
    return Tape("".join(text), starts, ends)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Disguised identifiers that lie within no plain one of their kind, nor within another of these; they may overlap it."""
    tape = plain_characters(Tape(text))
    found = tape.found(base_spans(tape.text)) if tape.text != text else []
    if HINT.search(tape.text):
        found += disguised_emails(marked_disguises(tape))
    found += spelled_numbers(tape)
    if not found:
        return found
    out: list[Span] = []
    for kind in KINDS:
        plain = [(a, b) for k, a, b in base if k == kind]
        upto = -1
        for _, a, b in sorted((s for s in found if s[0] == kind), key=lambda s: (s[1], -s[2])):
            within = bisect_right(plain, (a, len(text) + 1)) - 1
            if b > upto and not (within >= 0 and b <= plain[within][1]):
                out.append((kind, a, b))
                upto = b
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in the order of KINDS and then of their start."""
    base = base_spans(text)
    return base, sorted([*base, *added_spans(text, base)], key=lambda s: (KINDS.index(s[0]), s[1]))


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names their union."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind}]"]
        done = b
    return "".join(out) + text[done:]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``, a row for each row of ``docs(doc_id, text)``.

    The counts are of base spans, ``spans`` lists all, ``n_added`` counts those the transducers add. Null texts are empty.
    Repeated rows are found again; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [all_spans(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in rows], pa.string())
            spans = pa.array([_listed(every) for _, every in rows], pa.string())
            added = pa.array([len(every) - len(base) for base, every in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, spans, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and rows, personal data in ``text`` replaced; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
