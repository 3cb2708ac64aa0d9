"""Periodic runs of words, found by divide and conquer, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period p, at least ``least`` words and ``times`` periods long, which no
neighbouring word extends. As Main and Lorentz do it, a text is halved again and again; a run lies across the first middle that
cuts it, and at least half of it, so two whole periods, on one side of that middle. The Z-values of the right half, and of the left half
read backwards, are therefore tested for every period at once: first one word, then (few are left) a hash of p words. What
remains is extended to both sides over the whole text, and periods that a run found before explains are dropped, so that a stretch of
one word costs no more than any other. All middles of one level, of all texts of a slice, are worked on together.

Extents come from hashes of words; each run is verified word by word before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberstack.llm import hashing
from emberstack.llm.hashing import Words, slices

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Sequence:
    """Interned words with prefix hashes, to compare stretches of them and to extend a period."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.power = hashing._power(hashing._WORD_BASE, len(ids) + 1)[0]
        self.sums = hashing._prefix(hashing.mix(ids.astype(np.uint64) + np.uint64(1)), hashing._WORD_BASE)

    def equal(self, i: np.ndarray, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether ``count`` words from i on are those from i + p on."""
        here = (self.sums[i + count] - self.sums[i]) * self.power[p]
        return here == self.sums[i + p + count] - self.sums[i + p]

    def extent(self, i: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch around i with period p within [low, high), which holds the p words before and after i + p."""

        def most(bound: np.ndarray, holds) -> np.ndarray:
            least, bound = np.zeros_like(bound), bound.copy()
            while (least < bound).any():
                middle = (least + bound + 1) // 2
                ok = holds(middle)
                least, bound = np.where(ok, middle, least), np.where(ok, bound, middle - 1)
            return least

        after = most(high - i - p, lambda n: self.equal(i, p, n))
        before = most(i - low, lambda n: self.equal(i - n, p, n))
        return i - before, i + p + after


def _squares(seq: Sequence, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the segments [left, right): (segment, period, first word) of all squares that begin or end at a middle, within its side."""
    middle = (left + right) // 2
    for ahead, room in ((True, (right - middle) // 2), (False, (middle - left) // 2)):
        upto = np.cumsum(room)
        segment = np.repeat(np.arange(len(left)), room)
        p = np.arange(len(segment)) - np.repeat(upto - room, room) + 1
        at = middle[segment] - (not ahead)
        same = np.flatnonzero(seq.ids[at] == seq.ids[at + p if ahead else at - p])
        segment, p = segment[same], p[same]
        i = middle[segment] - (0 if ahead else 2 * p)
        same = seq.equal(i, p, p)
        yield segment[same], p[same], i[same]


def find_runs(ids: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of the texts [low, high) within ``ids``, ordered by start, then period."""
    seq = Sequence(ids)
    found = [np.zeros((0, 5), np.int64)]
    left, right = low, high
    text = np.arange(len(low))
    while True:
        live = right - left >= least
        left, right, text = left[live], right[live], text[live]
        if not len(left):
            break
        for segment, p, i in _squares(seq, left, right):
            while len(p):
                head = np.ones(len(p), bool)
                head[1:] = segment[1:] != segment[:-1]
                own, which = text[segment[head]], np.cumsum(head) - 1
                start, end = seq.extent(i[head], p[head], low[own], high[own])
                found.append(np.stack([start, end, p[head], low[own], high[own]], axis=1))
                told = head | (p % p[head][which] == 0) & (i >= start[which]) & (i + 2 * p <= end[which])
                segment, p, i = segment[~told], p[~told], i[~told]
        middle = (left + right) // 2
        left, right, text = np.concatenate([left, middle]), np.concatenate([middle, right]), np.concatenate([text, text])
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, times * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    wrong = sorted({(r[3], r[4]) for r in runs.tolist() if not _is_run(ids, *r)})
    for lo, hi in wrong:  # two different stretches had one hash
        runs = np.concatenate([runs[runs[:, 3] != lo], _by_every_period(ids, lo, hi, least, times)])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _is_run(ids: np.ndarray, start: int, end: int, p: int, low: int, high: int) -> bool:
    whole = np.array_equal(ids[start : end - p], ids[start + p : end])
    return whole and (start == low or ids[start - 1] != ids[start - 1 + p]) and (end == high or ids[end] != ids[end - p])


def _by_every_period(ids: np.ndarray, low: int, high: int, least: int, times: int) -> np.ndarray:
    """The runs of one text without hashes, by comparing it with itself for every period."""
    best: dict[tuple[int, int], int] = {}
    for p in range(1, (high - low) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids[low : high - p] == ids[low + p : high], [0]])))
        for s, e in edge.reshape(-1, 2).tolist():
            if e - s + p >= max(least, times * p):
                best.setdefault((low + s, low + e + p), p)
    return np.array([[s, e, p, low, high] for (s, e), p in best.items()], np.int64).reshape(-1, 5)


def _kept_texts(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts made of the ``kept`` words joined by one space."""
    words = np.flatnonzero(kept)
    last = np.ones(len(words), bool)
    last[:-1] = w.doc[words[1:]] != w.doc[words[:-1]]
    step = np.zeros(len(w.data) + 1, np.int8)
    step[w.starts[words]] += 1
    step[w.ends[words]] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    gap = w.ends[words[~last]]  # a later word follows, so a space does
    mask[gap] = True
    data = w.data.copy()
    data[gap] = 0x20
    before = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=before[1:])
    return data[mask], before[w.offsets]


def collapse(docs: DataFrame, least: int = 6, times: int = 4, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed_sha256[, collapsed])``, one row for each row of ``docs(doc_id, text)``.

    ``runs`` lists (start, length, period), in words numbered from 0, by start, then period. ``collapsed`` are the words that no run
    holds beyond its first period, joined by one space. A null or empty text has no words and no runs; whole texts are
    taken, of any length. Rows that repeat a doc_id, and null ids, are documents of their own. Of two periods of one
    stretch only the smaller counts. Other columns are ignored; an empty table gives one. ``times`` is at least 4: half of a
    run then holds a square.

    Each row is worked on where it is read, without a shuffle; a worker holds one slice of about 1 MB or one longer text.
    """
    if times < 4:
        raise ValueError("times must be at least 4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = Words(batch.column("text"))
            start, end, period = find_runs(w.hashes, w.first[:-1], w.first[1:], least, times)
            step = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, end, -1)
            data, at = _kept_texts(w, np.cumsum(step[:-1]) == 0)
            doc = w.doc[start] if len(start) else start
            fields = [pa.array(a) for a in (start - w.first[doc], end - start, period)]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            body = memoryview(data)
            digests = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(w.counts), "runs": lists, "collapsed_sha256": pa.array(digests, pa.string())}
            if with_text:
                columns["collapsed"] = pa.Array.from_buffers(pa.large_string(), w.n_docs, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed_sha256 string" + ", collapsed string" * with_text)
