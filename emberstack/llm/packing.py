"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram with at most ``capacity`` entries whatever
the corpus. The driver plans on the histogram alone: first the dominance reduction fixes sets of lengths that dominate
every alternative (a length with its exact complement, a length that fits with one other only, or with two), shrinking
the instance, then best-fit decreasing places the remainder, equal bins and equal lengths at once. The plan is a list of
bin patterns with multiplicities, and so, for each length, intervals of ranks with their bins and offsets. Executors
tokenize, rank the pieces of a length in hash buckets (bucket totals give the rest of the rank) and look up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberstack.llm.hashing import slices
from emberstack.llm.scratch import saved

END_ID = 2
RANK_BUCKETS = 1024
SPECIAL = "<|"  # texts with it may hold special tokens and go through the full tokenizer


class Encoder:
    """Ids of texts as the tokenizers file gives them, without special tokens added.

    A text is cut at single spaces. A cut that neither starts nor ends with white space is encoded on its own: no pattern of
    this vocabulary joins what precedes a space with what follows. Cuts seen before come from a bounded memory; new ones
    are encoded joined, by the same vocabulary as ranks, and split by byte lengths. Other texts are encoded whole.
    """

    def __init__(self, tokenizers_file: str, ranks_file: str, pattern: str, remember: int = 300_000):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(tokenizers_file)
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.remember, self.known = remember, {}

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(part)), dtype="<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            body, begin = ids.tobytes(), 0
            for w, cut in zip(part, cuts.tolist()):
                self.known[w] = body[4 * begin : 4 * cut]
                begin = cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cuts: list[list[str] | None] = []
        need: set[str] = set()
        for text in texts:
            if SPECIAL in text:
                cuts.append(None)
                continue
            parts = text.split(" ")
            cuts.append(parts)
            need.update(parts[1:])
        need -= self.known.keys()
        if len(self.known) + len(need) > self.remember:
            need.update(w for parts in cuts if parts for w in parts[1:])
        odd = {w for w in need if not w or w[0].isspace() or w[-1].isspace()}
        self._learn([w for w in need if w not in odd])
        out = []
        for text, parts in zip(texts, cuts):
            if parts is None:
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            try:
                rest = b"".join(map(self.known.__getitem__, parts[1:]))
                head = parts[0]
                if parts[1:] and (not head or head[-1].isspace()):
                    raise KeyError(head)
                out.append(np.array(self.fast.encode_ordinary(head), dtype="<u4").tobytes() + rest)
            except KeyError:
                out.append(np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes())
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def pieces(docs: DataFrame, tokenizers_file: str, ranks_file: str, pattern: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text)`` to rows ``(doc_id, piece, start, length, ids_crc32)``; a null text is an empty one.

    A document's ids end with ``end_id``. Only documents longer than ``capacity`` are cut, into pieces of ``capacity``, of which
    the first may be shorter.
    """
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((tokenizers_file, ranks_file))
        if encoder is None:
            encoder = _encoders[(tokenizers_file, ranks_file)] = Encoder(tokenizers_file, ranks_file, pattern)
        for batch in slices(batches):
            rows: list[tuple] = []
            for i, body in enumerate(encoder(pc.fill_null(batch.column("text"), "").to_pylist())):
                body += tail
                n = len(body) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k in range(len(edges) - 1):
                    a, b = edges[k], edges[k + 1]
                    rows.append((i, k, a, b - a, zlib.crc32(body[4 * a : 4 * b])))
            i, k, a, n, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(i)), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Fix dominating sets in ``count`` (items by length, changed in place); gives ``(bins, lengths in a bin)``.

    For the longest item j with free space f, in this order: nothing fits: {j}. An item of exactly f: {j, f}, since what
    any other set holds beside j fits in its place. The two smallest others don't fit together: {j, the longest that fits}.
    The three smallest don't: {j, a, b} with a the longest that fits and b the longest beside it, if each rival pair fits
    into them. A set stays dominating while its lengths last, as rivals only become fewer.
    """
    fixed: list[tuple[int, list[int]]] = []

    def fix(*lengths: int) -> None:
        kinds, times = np.unique(lengths, return_counts=True)
        n = int(min(count[k] // t for k, t in zip(kinds, times)))
        count[kinds] -= n * times
        fixed.append((n, sorted(lengths, reverse=True)))

    def longest(upto: int, *taken: int) -> int:
        have = np.flatnonzero(count[: max(upto, 0) + 1] > 0)[::-1]
        return next((int(x) for x in have if count[x] > taken.count(x)), 0)

    def smallest(k: int, taken: int) -> int:
        """Sum of the k smallest items besides one of length ``taken``; beyond any capacity if there are fewer."""
        total, left = 0, k
        for x in np.flatnonzero(count > 0):
            n = min(left, int(count[x]) - (x == taken))
            total, left = total + n * int(x), left - n
            if not left:
                return total
        return 2 * capacity

    j = capacity
    while j > 0:
        if count[j] <= 0:
            j -= 1
            continue
        free = capacity - j
        best = longest(free, j)
        if not best:
            fix(j)
        elif best == free or smallest(2, j) > free:
            fix(j, best)
        elif smallest(3, j) > free:
            second = longest(free - best, j, best)
            rivals = [int(x) for x in np.flatnonzero(count[:best] > 0)]
            beside = {x: longest(min(x, free - x), j, x) for x in rivals}
            if second and all(y <= second or x + y <= best for x, y in beside.items()):
                fix(j, best, second)
            else:
                j -= 1
        else:
            j -= 1
    return [x for x in fixed if x[0]]


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over items by length: each goes to the open bin with the least space that holds it."""
    open_bins: dict[int, list[tuple[int, list[int]]]] = {}
    for w in range(capacity, 0, -1):
        left = int(count[w])
        while left:
            space = min((r for r in open_bins if r >= w), default=None)
            if space is None:
                each = capacity // w
                n, each = (left // each, each) if left >= each else (1, left)
                open_bins.setdefault(capacity - w * each, []).append((n, [w] * each))
                left -= n * each
                continue
            n, held = open_bins[space].pop()
            t = min(n, left)
            if n > t:
                open_bins[space].append((n - t, held))
            if not open_bins[space]:
                del open_bins[space]
            open_bins.setdefault(space - w, []).append((t, [*held, w]))
            left -= t
    return [x for group in open_bins.values() for x in group]


def plan(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length an array of rows (first rank, first bin, offset): rank r of an interval is in bin first bin + r - first rank."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    patterns = reduce_by_dominance(count, capacity) + best_fit(count, capacity)
    rank, places, first = dict.fromkeys(histogram, 0), {length: [] for length in histogram}, 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            places[length].append((rank[length], first, offset))
            rank[length] += n
            offset += length
        first += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in places.items()}


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``cut``, the rows of ``pieces``; no sequence holds more than ``capacity`` ids.

    Equal rows are interchangeable; null doc_ids are documents; an empty table gives an empty result. Pieces of a length are
    ranked within hash buckets, so no length, however frequent, is one group. The plan that tasks carry is bounded by the
    capacity, not by the corpus.
    """
    cut = saved(cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")))
    totals = saved(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = plan(histogram, capacity)
    before = totals.select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("rn", rank).join(before, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = places[int(n)]
                k = np.searchsorted(rows[:, 0], at[own], side="right") - 1
                seq[own] = rows[k, 1] + at[own] - rows[k, 0]
                offset[own] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
