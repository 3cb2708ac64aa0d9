"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a long string of bits: on which side of the median of 32 random projections it lies. Each block of
rows is indexed as one sorted array of those strings for each tree, built once and written. A query descends to its
longest prefix matches in all trees and ascends in all of them together, a bit at a time, until enough rows share a
prefix with it; the rows at that level, all of them, are compared exactly.

Medians are fitted for every dimension on a bounded sample of its own usable rows; every usable row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberstack.llm.scratch import discard, saved

BITS = 32
BLOCK_BYTES = 1 << 24  # of vectors in a block of the index
BLOCK_ROWS = 1 << 15
QUERY_BYTES = 1 << 25  # of vectors in a block of queries, which is broadcast
SAMPLE_PARTS = 32

INDEX = "d int, n int, ids binary, vectors binary, keys binary, places binary"


def usable(vector: Column) -> Column:
    """Whether an array of doubles is whole, finite and not zero; false for null and empty ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("d").to_numpy()
    for d in np.unique(sizes):
        yield int(d), batch.filter(pa.array(sizes == d))


def planes(d: int, trees: int) -> np.ndarray:
    """The random projections of a dimension, the same in every task."""
    return np.random.default_rng(7 + d).standard_normal((d, trees * BITS)).astype(np.float32)


class Forest:
    """Projections of each dimension with their medians over a sample of it."""

    def __init__(self, middles: dict[int, np.ndarray], trees: int):
        self.trees, self.middles, self._planes = trees, middles, {}

    def __getstate__(self) -> dict:
        return {"trees": self.trees, "middles": self.middles, "_planes": {}}

    def strings(self, x: np.ndarray) -> np.ndarray:
        """One 32-bit string for each tree (rows) and vector (columns)."""
        d = x.shape[1]
        if d not in self._planes:
            self._planes[d] = planes(d, self.trees)
        out = np.empty((self.trees, len(x)), np.uint32)
        for at in range(0, len(x), 2048):
            bits = (_bounded(x[at : at + 2048]) @ self._planes[d] > self.middles[d]).reshape(-1, self.trees, BITS)
            out[:, at : at + 2048] = np.packbits(bits, axis=2).view(">u4")[:, :, 0].T
        return out


def _bounded(x: np.ndarray) -> np.ndarray:
    """As floats whose projections stay finite: signs are all that matters for larger ones."""
    return np.clip(x, -1e30, 1e30).astype(np.float32)


def candidates(keys: np.ndarray, wanted: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ranges (low, high) in each tree's sorted ``keys`` at the deepest level with ``enough`` rows in all."""
    trees, n = wanted.shape
    low, high = np.zeros((trees, n), np.int64), np.full((trees, n), keys.shape[1], np.int64)
    open_ = np.arange(n)
    for depth in range(BITS, 0, -1):
        mask = np.uint32(0xFFFFFFFF << (BITS - depth) & 0xFFFFFFFF)
        lo, hi = np.empty((trees, len(open_)), np.int64), np.empty((trees, len(open_)), np.int64)
        for t in range(trees):
            prefix = wanted[t, open_] & mask
            lo[t] = np.searchsorted(keys[t], prefix, side="left")
            hi[t] = np.searchsorted(keys[t], prefix | ~mask, side="right")
        done = (hi - lo).sum(axis=0) >= enough
        low[:, open_[done]], high[:, open_[done]] = lo[:, done], hi[:, done]
        open_ = open_[~done]
        if not len(open_):
            break
    return low, high


def _nearest(ids: np.ndarray, x: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, q_id, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of the rows in a query's ranges, by distances of the vectors themselves."""
    seen = np.zeros(len(ids), bool)
    for t in range(len(places)):
        seen[places[t, low[t] : high[t]]] = True
    rows = np.flatnonzero(seen & (ids != q_id))
    distance = np.empty(len(rows))
    for at in range(0, len(rows), 4096):
        distance[at : at + 4096] = np.sqrt(((x[rows[at : at + 4096]] - q) ** 2).sum(axis=1))
    if len(rows) > k:
        near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        rows, distance = rows[near], distance[near]
    top = np.lexsort((ids[rows], distance))[:k]
    return ids[rows[top]], distance[top]


def fitted(rows: DataFrame, trees: int, sample: int) -> Forest:
    """Medians of each dimension over ``sample`` of ``rows(vec_id, d, embedding)``, the ones of least hash in each of 32 parts.

    What reaches the driver is one row of ``trees * 32`` numbers for each distinct dimension.
    """
    order = F.xxhash64("vec_id", "embedding")
    part = Window.partitionBy("d", F.pmod(order, F.lit(SAMPLE_PARTS))).orderBy(order)
    chosen = rows.withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= max(1, sample // SAMPLE_PARTS)).select("d", "embedding")

    def middles(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        x = _matrix(table.column("embedding").combine_chunks(), d)
        return pa.table({"d": pa.array([d], pa.int32()), "middle": pa.array([np.median(_bounded(x) @ planes(d, trees), axis=0).astype(np.float32).tobytes()], pa.binary())})

    found = chosen.groupBy("d").applyInArrow(middles, "d int, middle binary").toArrow()
    return Forest({d: np.frombuffer(m, np.float32) for d, m in zip(found.column("d").to_pylist(), found.column("middle").to_pylist())}, trees)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 64, share: float = 0.012, least: int = 2000, sample: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row of ``queries`` its ``k`` nearest found in ``vectors(vec_id, embedding)``.

    Euclidean distance in double precision on the original vectors, nearest first, ties to the smaller vec_id. A query's
    candidates are rows of other vec_ids and of its dimension. Rows with a null id, or a vector that is null, empty, zero or
    holds null or non-finite components, take no part; of an empty table, or one of such rows alone, nothing is found. A
    repeated vec_id is a candidate each time; a query that is repeated with an equal vector is asked once, with another
    vector it is asked again. Other columns are ignored.

    Rows are indexed in blocks of at most 32,768 and 16 MB. Queries are served against all of them in blocks of 32 MB of
    vectors, which are what is broadcast; ``share`` of a block's rows for each tree, at least ``least``, are looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def taking_part(df: DataFrame) -> DataFrame:
        df = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("d", F.size("embedding"))

    rows = taking_part(vectors)
    forest = spark.sparkContext.broadcast(fitted(rows, trees, sample))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(d: int, parts: list) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*parts))
            strings = forest.value.strings(x)
            places = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
            keys = np.take_along_axis(strings, places, axis=1)
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, keys, places))], ["d", "n", "ids", "vectors", "keys", "places"])

        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            for d, own in _by_dimension(batch):
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))
                at = 0
                while at < len(own):
                    cut = own.slice(at, most - sizes.get(d, 0))
                    held.setdefault(d, []).append((cut.column("vec_id").to_numpy(), _matrix(cut.column("embedding"), d)))
                    sizes[d] = sizes.get(d, 0) + len(cut)
                    at += len(cut)
                    if sizes[d] == most:
                        yield block(d, held.pop(d))
                        sizes[d] = 0
        for d, parts in held.items():
            yield block(d, parts)

    index = saved(rows.mapInArrow(build, INDEX))
    asked = taking_part(queries).groupBy("vec_id", "embedding", "d").agg(F.xxhash64("vec_id", "embedding").alias("ask"))
    total = asked.agg(F.sum(F.lit(8).cast("long") * F.col("d"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_BYTES))
    asked = saved(asked.withColumn("block", F.pmod("ask", F.lit(blocks)).cast("int")), "block")
    found = None
    for b in range(blocks):
        own: dict[int, tuple] = {}
        for batch in asked.where(F.col("block") == b).toArrow().combine_chunks().to_batches():
            for d, part in _by_dimension(batch):
                own.setdefault(d, []).append((part.column("vec_id").to_numpy(), part.column("ask").to_numpy(), _matrix(part.column("embedding"), d)))
        held = spark.sparkContext.broadcast({d: tuple(np.concatenate(c) for c in zip(*parts)) for d, parts in own.items()})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    d, n = row["d"], row["n"]
                    if d not in held.value:
                        continue
                    q_ids, asks, q = held.value[d]
                    ids, x = np.frombuffer(row["ids"], q_ids.dtype), np.frombuffer(row["vectors"]).reshape(n, d)
                    keys, places = (np.frombuffer(row[c], t).reshape(trees, n) for c, t in (("keys", np.uint32), ("places", np.int32)))
                    for at in range(0, len(q), 1024):
                        low, high = candidates(keys, forest.value.strings(q[at : at + 1024]), max(least, int(share * trees * n)))
                        near = [_nearest(ids, x, places, low[:, i], high[:, i], q_ids[at + i], q[at + i], k) for i in range(low.shape[1])]
                        took = [len(v) for v, _ in near]
                        columns = [np.repeat(q_ids[at : at + 1024], took), np.repeat(asks[at : at + 1024], took), *(np.concatenate(c) for c in zip(*near))]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "ask", "vec_id", "score"])

        out = index.mapInArrow(run, f"query_id {kind}, ask long, vec_id {kind}, score double")
        if blocks > 1:
            out = saved(out)
            held.unpersist()
        found = out if found is None else found.unionByName(out)
    if blocks > 1:
        discard(index, asked)
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
