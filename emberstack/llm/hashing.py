"""Vectorised words and rolling hashes over Arrow string buffers (numpy inside tasks; no per-word Python).

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes. Hashes are 64-bit polynomials modulo 2**64 over bytes
(a word) or over mixed word hashes (a gram), each finished by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE, _WORD_BASE, _CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept per worker and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, dtype=np.uint64)
            step[0] = 1
            both.append(np.cumprod(step, dtype=np.uint64))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values))[0][: len(values)], out=out[1:])
    return out


class Words:
    """The words of a column of texts: byte ranges, documents and hashes. Null texts have no words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        self.n_docs = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        body = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[raw] if lower else raw
        space = SPACE[raw]
        before = np.ones(len(raw), dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(len(raw), dtype=bool)
        after[:-1] = space[1:]
        edge = self.offsets[:-1]
        before[edge[edge < len(raw)]] = True
        edge = self.offsets[1:] - 1
        after[edge[edge >= 0]] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # words of d: first[d] up to first[d + 1]
        self.counts = np.diff(self.first)
        total = _prefix(self.data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        inverse = _power(_BYTE_BASE, len(self.data) + 1)[1]
        length = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + length)
        self._sums: dict[int, np.ndarray] = {}

    def grams(self, k: int, check: bool = False) -> np.ndarray:
        """Hash of words i .. i+k-1 for every i with i+k words in the batch; mask with ``whole``."""
        base = _CHECK_BASE if check else _WORD_BASE
        if base not in self._sums:
            self._sums[base] = _prefix(self.hashes, base)
        n = max(0, len(self.hashes) - k + 1)
        p = self._sums[base]
        return mix((p[k : k + n] - p[:n]) * _power(base, n + 1)[1][:n] + np.uint64(k))

    def whole(self, k: int) -> np.ndarray:
        """For every i of ``grams(k)``: whether its words are of one document."""
        n = max(0, len(self.hashes) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]

    def span(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Hash of ``count`` words from word ``first`` on, as ``grams(count)`` gives it."""
        if _WORD_BASE not in self._sums:
            self._sums[_WORD_BASE] = _prefix(self.hashes, _WORD_BASE)
        p = self._sums[_WORD_BASE]
        return mix((p[first + count] - p[first]) * _power(_WORD_BASE, len(p))[1][first] + count.astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1_000_000, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text and at most ``rows`` rows; a longer document is a slice
    of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size)
        at = 0
        while at < len(size):
            done = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, done + most, side="right"))))
            yield batch.slice(at, end - at)
            at = end
