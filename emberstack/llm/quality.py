"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms are trigrams of character classes (small and capital letters, digits, kinds of punctuation and space) and
repetitions of words, so that they mean the same in every language. Their square-rooted frequencies in a bounded sample of
labelled documents are decomposed; labelled documents become unit vectors of the leading directions. These vectors are
broadcast (their size is a parameter, not the corpus's). Every document's cosine with every labelled vector is
computed exactly, block by block as one matrix product, and its nearest labelled vectors vote, weighted by the sixteenth
power of their cosine: latent cosines of prose are all near 1, and the power lets the nearest outweigh the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from emberstack.llm.hashing import Words, slices

CLASSES = 13
#: Documents in a block; each is a row of TERMS numbers.
BLOCK = 512
POWER = 16
TERMS = CLASSES**3 + 3
CLASS = np.full(256, 11, dtype=np.int64)  # other ASCII
CLASS[97:123] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[32] = 3
CLASS[[9, 10, 11, 12, 13]] = 4
for _k, _chars in ((5, b"."), (6, b",;:"), (7, b"!?"), (8, b"#$%&*@~^"), (9, b"|<>{}[]()\\/_=+"), (10, b"'\"-")):
    CLASS[list(_chars)] = _k
CLASS[128:] = 12


def term_vectors(texts: pa.Array) -> np.ndarray:
    """Unit rows of square-rooted term frequencies; a row of zeros for a text without three bytes and two words."""
    w = Words(texts)
    n, size = w.n_docs, np.diff(w.offsets)
    code = CLASS[w.data]
    out = np.zeros((n, TERMS), np.float32)
    if len(code) >= 3:
        doc = np.repeat(np.arange(n), size)
        tri = (code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:]
        own = doc[:-2] == doc[2:]
        out[:, : CLASSES**3] = np.bincount(doc[:-2][own] * CLASSES**3 + tri[own], minlength=n * CLASSES**3).reshape(n, -1)
    for k in (1, 2, 3):
        if len(w.hashes) > k:
            same = (w.hashes[k:] == w.hashes[:-k]) & (w.doc[k:] == w.doc[:-k])
            out[:, CLASSES**3 + k - 1] = np.bincount(w.doc[k:][same], minlength=n) * 6.0
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def leading_directions(rows: np.ndarray, dimensions: int, rounds: int = 30) -> np.ndarray:
    """The leading right singular vectors of ``rows`` as columns, by orthogonal iteration over a few more of them than are wanted: no
    matrix of terms by terms is made."""
    n = min(dimensions + 16, *rows.shape)
    if not n:
        return np.zeros((rows.shape[1], 0), np.float32)
    basis, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((rows.shape[1], n)))
    for _ in range(rounds):
        basis, _ = np.linalg.qr((rows.T @ (rows @ basis.astype(np.float32))).astype(np.float64))
    seen = (rows @ basis.astype(np.float32)).astype(np.float64)
    _, turn = np.linalg.eigh(seen.T @ seen)
    return (basis @ turn[:, ::-1])[:, :dimensions].astype(np.float32)


class Model:
    """Latent directions, unit vectors of the labelled sample with their labels, and the share of label 1."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dimensions: int = 48, neighbours: int = 25):
        self.neighbours, self.labels = neighbours, labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.directions = leading_directions(rows, dimensions)
        self.vectors = self.latent(rows)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        v = rows @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the prior for a row of zeros or without labels."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        near = self.latent(rows) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
        sim = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** POWER
        total = sim.sum(axis=1)
        vote = (sim * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, vote, self.prior), 0.0, 1.0).astype(np.float64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, dimensions: int = 48, neighbours: int = 25) -> Model:
    """Learn from ``labels(doc_id, quality)`` on ``docs(doc_id, text)``, never from held-out ids.

    At most ``most`` labelled documents are used, the ones of least hash; null labels and ids are left out, and of a label
    that is repeated the least counts. Of the rows of a repeated doc_id one is learned from, of the least terms; rows are
    reduced before they are sent, so at most ``most`` of them reach the driver.
    """
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "c_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("c_id"))  # bounded by ``most``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=BLOCK):
            v = term_vectors(batch.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x in v], pa.binary())], ["doc_id", "quality", "terms"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each id, of at most ``most`` ids: of the least terms."""
        held: dict = {}
        for batch in batches:
            for i, q, terms in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in held or terms < held[i][1]:
                    held[i] = (q, terms)
        if held:
            kinds = [f.type for f in batch.schema]
            yield pa.RecordBatch.from_arrays([pa.array(held, kinds[0]), pa.array([q for q, _ in held.values()], kinds[1]), pa.array([t for _, t in held.values()], kinds[2])], ["doc_id", "quality", "terms"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "quality")]
    schema = f"doc_id {kinds[0]}, quality {kinds[1]}, terms binary"
    got = rows.select("doc_id", "quality", "text").mapInArrow(lambda batches: least(run(batches)), schema)
    # Of each task, then of all: no sort of wide rows, which would fill an executor's heap.
    got = got.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").mapInArrow(least, schema).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy()) if len(got) else np.zeros(0, int)
    matrix = np.zeros((len(got), TERMS), np.float32)
    for at, row in enumerate(order.tolist()):
        matrix[at] = np.frombuffer(got.column("terms")[row].as_buffer(), np.float16)
    kept = got.column("quality").to_numpy()[order] if len(got) else np.zeros(0)
    del got
    return Model(matrix, kept, dimensions, neighbours)


def score(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and a DOUBLE column ``name``: how likely the text has label 1. Null texts are empty.

    Only the text is an input. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = "text" if "text" in columns else "__text"
    rows = docs.select(*columns) if "text" in columns else docs.select(*columns, F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, rows=BLOCK):
            found = shared.value.score(term_vectors(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found)], [*columns, name])

    schema = StructType([*(rows.schema[c] for c in columns)]).add(name, DoubleType())
    return rows.mapInArrow(run, schema)
