"""Compression of vectors to a few bytes, by a codebook for each part of a vector.

Components become integers, so that sums, distances and ties are exact and every rerun agrees. In each round the codebooks are
broadcast as kd-trees (their size is that of ``entries`` vectors, whatever the table's); every part is assigned to its nearest entry
by branch and bound, tasks add up what they assigned, and the sums of tasks are added by Spark. What reaches the driver are those
sums, one for each component of each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.llm.prefix_forest import _by_dimension as by_dimension
from emberstack.llm.prefix_forest import _matrix as matrix
from emberstack.llm.scratch import saved


class Tree:
    """A kd-tree of the entries of one codebook: boxes, halved at the median of their widest side."""

    def __init__(self, entries: np.ndarray, leaf: int = 2):
        self.entries, self.leaf = entries, leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> tuple:
        low, high = self.entries[own].min(axis=0), self.entries[own].max(axis=0)
        if len(own) <= self.leaf:
            return low, high, own, ()
        order = own[np.argsort(self.entries[own, np.argmax(high - low)], kind="stable")]
        return low, high, own, (self._node(order[: len(own) // 2]), self._node(order[len(own) // 2 :]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its nearest entry, the lowest of equally near ones, and the squared distance."""
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))

        def bound(node: tuple, rows: np.ndarray) -> np.ndarray:
            off = np.maximum(np.maximum(node[0] - x[rows], x[rows] - node[1]), 0)
            return (off * off).sum(axis=1)

        def visit(node: tuple, rows: np.ndarray) -> None:
            if not node[3]:
                for e in node[2].tolist():
                    off = x[rows] - self.entries[e]
                    distance = (off * off).sum(axis=1)
                    better = (distance < best[rows]) | (distance == best[rows]) & (e < index[rows])
                    best[rows[better]], index[rows[better]] = distance[better], e
                return
            bounds = [bound(child, rows) for child in node[3]]
            left = bounds[0] <= bounds[1]
            for own, near, far in ((left, 0, 1), (~left, 1, 0)):
                for side in (near, far):
                    open_ = rows[own][bounds[side][own] <= best[rows[own]]]  # an equal bound may hide an equally near, lower entry
                    if len(open_):
                        visit(node[3][side], open_)

        if len(x):
            visit(self.root, np.arange(len(x)))
        return index, best


def widest(d: int) -> int:
    """The largest integer of a component for which a sum of ``d`` squared differences stays within 63 bits."""
    return 1 << (61 - d.bit_length()) // 2


def integers(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """``(vec_id, label, d, v)``: the usable rows with their components as 32-bit integers floor(scale * x), in one binary."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.withColumn("d", F.size("embedding")).where(F.coalesce(finite, F.lit(False)) & (F.col("d") > 0) & (F.col("d") % parts == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own in by_dimension(batch):
                x = np.floor(np.clip(matrix(own.column("embedding"), d), -(2.0**40), 2.0**40) * scale)
                x = np.clip(x, -widest(d), widest(d)).astype("<i4")
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), own.column("d"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "d", "v"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, d int, v binary")


def _cut(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """By dimension: rows, and their integers as (row, part, position)."""
    for d, own in by_dimension(batch):
        v = np.frombuffer(b"".join(own.column("v").to_pylist()), "<i4").astype(np.int64)
        yield d, own, v.reshape(len(own), parts, d // parts)


class Codebooks:
    """By dimension an array (part, entry, position) of integers."""

    def __init__(self, entries: dict[int, np.ndarray], parts: int, scale: int):
        self.entries, self.parts, self.scale = entries, parts, scale

    def trees(self) -> dict[int, list[Tree]]:
        return {d: [Tree(part) for part in book] for d, book in self.entries.items()}

    def sha256(self, d: int) -> str:
        """Of all integers in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries[d].ravel().tolist())).encode()).hexdigest()


def _seeded(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks made of the rows of least vec_id of each dimension."""
    first = {}
    for (d,) in rows.select("d").distinct().collect():
        least = rows.where(F.col("d") == d).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        first[d] = np.stack([np.frombuffer(r.v, "<i4").astype(np.int64).reshape(parts, -1) for r in least], axis=1)
    return Codebooks(first, parts, scale)


def _improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts nearest to it."""
    parts = books.parts
    held = rows.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _cut(batch, parts):
                k = len(held.value[d][0].entries)
                total, count = sums.setdefault(d, (np.zeros((parts, k, d // parts), np.int64), np.zeros((parts, k), np.int64)))
                for p in range(parts):
                    near, _ = held.value[d][p].nearest(x[:, p])
                    count[p] += np.bincount(near, minlength=k)
                    for e in np.unique(near):
                        total[p, e] += x[near == e, p].sum(axis=0)
        for d, (total, count) in sums.items():
            part, entry, at = (i.ravel().astype(np.int32) for i in np.indices(total.shape))
            columns = [np.full(total.size, d, np.int32), part, entry, at, total.ravel(), np.repeat(count.ravel(), total.shape[2])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "part", "entry", "at", "total", "n"])

    sums = rows.select("d", "v").mapInArrow(run, "d int, part int, entry int, at int, total long, n long")
    new = {d: book.copy() for d, book in books.entries.items()}
    for r in sums.groupBy("d", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
        new[r.d][r.part, r.entry, r.at] = r.total // r.n
    held.unpersist()
    return Codebooks(new, parts, books.scale)


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[Codebooks, DataFrame]:
    """Codebooks after ``rounds`` rounds over all of ``vectors(vec_id, label, embedding)``, and the rows as saved integers.

    Rows take no part whose vector is null, holds null or non-finite components, is empty or can't be cut into ``parts`` equal
    parts. Each dimension has codebooks of its own, which begin as its rows of least vec_id (null ids last, then by
    components); of fewer than ``entries`` rows there are as many entries. An entry that no part is nearest to stays. Integers
    beyond :func:`widest` (2**27 for 64 components) count as that. An empty table gives no codebooks. ``entries`` is
    256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries are numbered in one byte")
    rows = saved(integers(vectors, parts, scale))
    books = _seeded(rows, parts, entries, scale)
    for _ in range(rounds):
        books = _improved(rows, books)
    return books, rows


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, d, code, error)`` for the rows of :func:`train` or :func:`integers`: a byte for each part, the number of its nearest
    entry, and the squared distances summed. Equal rows have equal codes; rows of a dimension without codebooks have null."""
    parts = books.parts
    held = rows.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, x in _cut(batch, parts):
                codes, errors = pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64())
                if d in held.value:
                    found = [tree.nearest(x[:, p]) for p, tree in enumerate(held.value[d])]
                    code = np.stack([near for near, _ in found], axis=1).astype(np.uint8)
                    codes, errors = pa.array([c.tobytes() for c in code], pa.binary()), pa.array(sum(far for _, far in found))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), own.column("d"), codes, errors], ["vec_id", "label", "d", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, d int, code binary, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, embedding)`` as the codes tell them: the entries, scaled back to the middle of their integer's range."""
    held = codes.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, code in zip(batch.column("d").to_pylist(), batch.column("code").to_pylist()):
                book = held.value.get(d)
                out.append(None if book is None or code is None else ((np.concatenate([book[p, e] for p, e in enumerate(code)]) + 0.5) / books.scale).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "label", "embedding"])

    kinds = {c: codes.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return codes.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, embedding array<double>")
