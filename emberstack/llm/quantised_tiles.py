"""Links between vectors of one label, by int8 tile products with error bounds.

Equal vectors are one class, counted before anything is compared. The classes of a label are cut into tiles; every two tiles of a
label meet as int8 codes, eight times smaller than the vectors. A code differs from its unit vector by a known length, so a product of
codes bounds the cosine from both sides. Of a pair of tiles only the vectors that may have a link are met again in full; there a
pair whose bounds settle it is settled, and any other is computed in double precision.

A pair of tiles gives each vector's number of links and a spanning forest of its links, both linear in the tiles; the pairs
themselves are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.llm.components import connected_components
from emberstack.llm.prefix_forest import _by_dimension as by_dimension
from emberstack.llm.prefix_forest import _matrix as matrix
from emberstack.llm.prefix_forest import usable
from emberstack.llm.scratch import saved

SLACK = 1e-9  # beyond what rounding in double precision can add to a bound
EXACT = 1040  # so many products of two int8 numbers add up exactly in float32


class Codes:
    """Unit vectors as int8 numbers times a scale, and how far each is from its code."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray):
        self.codes, self.scale, self.error = codes, scale, error

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        scale = np.abs(unit).max(axis=1, initial=0) / 127
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        return cls(codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) + SLACK)

    def bounds(self, rows: slice, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of ``rows`` with all of ``other`` as the codes say them, and by how much they can be wrong."""
        total = np.zeros((len(self.codes[rows]), len(other.codes)))
        for at in range(0, self.codes.shape[1], EXACT):
            total += self.codes[rows, at : at + EXACT].astype(np.float32) @ other.codes[:, at : at + EXACT].astype(np.float32).T
        total *= self.scale[rows, None]
        total *= other.scale
        return total, self.error[rows, None] * (1 + other.error) + other.error + SLACK


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(n: int, other: int) -> Iterator[slice]:
    """Rows of a product whose arrays stay below some 16 MB."""
    step = max(1, (1 << 21) // max(1, other))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def possible(a: Codes, b: Codes | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of both sides (of one, where b is None: pairs within a) may have a link."""
    other = b or a
    left, right = np.zeros(len(a.codes), bool), np.zeros(len(other.codes), bool)
    for rows in _blocks(len(a.codes), len(other.codes)):
        cosine, error = a.bounds(rows, other)
        may = cosine + error >= threshold
        if b is None:
            may[np.arange(may.shape[0]), np.arange(rows.start, rows.stop)] = False
        left[rows] |= may.any(axis=1)
        right |= may.any(axis=0)
    return left, right


def links(x: np.ndarray, y: np.ndarray | None, n_x: np.ndarray, n_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: how many rows each of x, and of y, is linked with (a vector stands for ``n`` rows), and links (i, j) that
    connect whatever is linked. Where y is None the pairs within x are meant, and each is counted at both ends."""
    a = Codes.of(x)
    b = a if y is None else Codes.of(y)
    own = x if y is None else y
    shift = 0 if y is None else len(x)
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(own), np.int64)
    parent = np.arange(len(x) + (0 if y is None else len(y)))
    forest: list[tuple[int, int]] = []

    def roots(at: np.ndarray) -> np.ndarray:
        while True:
            up = parent[at]
            if (up == at).all():
                return at
            at = up

    for rows in _blocks(len(x), len(own)):
        cosine, error = a.bounds(rows, b)
        linked = cosine - error >= threshold
        unsure = ~linked & (cosine + error >= threshold)
        i, j = np.nonzero(unsure)
        for at in range(0, len(i), 1 << 15):
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            linked[p, q] = np.einsum("ij,ij->i", x[rows.start + p], own[q]) >= threshold
        if y is None:
            linked[np.arange(linked.shape[0]), np.arange(rows.start, rows.stop)] = False
        count_x[rows] += linked @ n_y
        count_y += n_x[rows] @ linked
        for row in np.flatnonzero(linked.any(axis=1)):
            others = np.flatnonzero(linked[row])
            top, first = np.unique(roots(others + shift), return_index=True)
            mine = int(roots(np.array([rows.start + row]))[0])
            for root, j in zip(top.tolist(), others[first].tolist()):
                if root != mine:
                    parent[root] = mine
                    forest.append((rows.start + int(row), j))
            parent[others + shift] = mine
    return count_x, count_y, np.array(forest, np.int64).reshape(-1, 2)


def _tiles(classes: DataFrame, tile_rows: int, tile_bytes: int) -> DataFrame:
    """``(label, d, tile, nodes, codes, scales, errors)``, saved. A tile is named by its first node."""
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, Codes]] = []
        key, room = None, 0

        def tile() -> pa.RecordBatch:
            nodes = np.concatenate([n for n, _ in held])
            codes, scales, errors = (np.concatenate([getattr(c, f) for _, c in held]) for f in ("codes", "scale", "error"))
            blobs = [pa.array([a.tobytes()], pa.binary()) for a in (nodes, codes, scales, errors)]
            return pa.RecordBatch.from_arrays([key[0], pa.array([key[1]], pa.int32()), pa.array([int(nodes[0])], pa.int64()), *blobs], ["label", "d", "tile", "nodes", "codes", "scales", "errors"])

        for batch in batches:
            for d, own in by_dimension(batch):
                labels = own.column("label")
                coded = labels.dictionary_encode().indices.to_numpy()
                edges = [0, *(np.flatnonzero(coded[1:] != coded[:-1]) + 1).tolist(), len(own)]
                for low, high in zip(edges, edges[1:]):
                    while low < high:
                        if held and (not key[0].equals(labels.slice(low, 1)) or key[1] != d or not room):
                            yield tile()
                            held = []
                        if not held:
                            key, room = (labels.slice(low, 1), d), max(1, min(tile_rows, tile_bytes // (8 * d)))
                        part = own.slice(low, min(room, high - low))
                        held.append((part.column("node").to_numpy(), Codes.of(unit(matrix(part.column("embedding"), d)))))
                        room -= len(part)
                        low += len(part)
        if held:
            yield tile()

    rows = classes.select("label", F.size("embedding").alias("d"), "node", "embedding")
    rows = rows.repartitionByRange(max(1, -(-classes.count() // tile_rows)), "label", "d", "node").sortWithinPartitions("label", "d", "node")
    return saved(rows.mapInArrow(run, f"label {kind}, d int, tile long, nodes binary, codes binary, scales binary, errors binary"))


def _candidates(tiles: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, node, side)``: the vectors of every two tiles that may have a link across them (within one, where a = b)."""
    names = tiles.select("label", "d", F.col("tile").alias("a"))
    other = tiles.select(F.col("label").alias("o_label"), F.col("d").alias("o_d"), F.col("tile").alias("b"))
    cells = saved(names.join(other, (F.col("label") == F.col("o_label")) & (F.col("d") == F.col("o_d")) & (F.col("a") <= F.col("b"))).select("a", "b"))
    sides = cells.select(F.col("a").alias("tile"), "a", "b").unionByName(cells.where("a < b").select(F.col("b").alias("tile"), "a", "b"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile")
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        both = []
        for r in table.to_pylist():
            nodes = np.frombuffer(r["nodes"], np.int64)
            both.append((nodes, Codes(np.frombuffer(r["codes"], np.int8).reshape(len(nodes), -1), np.frombuffer(r["scales"]), np.frombuffer(r["errors"]))))
        marks = possible(both[0][1], both[1][1] if a != b else None, threshold)
        found = [(nodes[mark], side) for side, ((nodes, _), mark) in enumerate(zip(both, marks))]
        nodes = np.concatenate([n for n, _ in found])
        columns = [np.full(len(nodes), a), np.full(len(nodes), b), nodes, np.concatenate([np.full(len(n), s, np.int32) for n, s in found])]
        return pa.table([pa.array(c) for c in columns], ["a", "b", "node", "side"])

    blobs = tiles.select("tile", "nodes", "codes", "scales", "errors")
    return saved(sides.join(blobs, "tile").groupBy("a", "b").applyInArrow(meet, "a long, b long, node long, side int"))


def _links(candidates: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``(node, other, n)``, saved: rows that a node is linked with in a pair of tiles (other null), and links of spanning forests."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        nodes, n, side = (table.column(c).to_numpy() for c in ("node", "n", "side"))
        x = table.column("embedding").combine_chunks()
        x = unit(matrix(x, len(x[0])))
        cut = int(np.searchsorted(side, 1))
        if table.column("a")[0] == table.column("b")[0]:
            count, _, forest = links(x, None, n, n, threshold)
        else:
            left, right, forest = links(x[:cut], x[cut:], n[:cut], n[cut:], threshold)
            count, forest = np.concatenate([left, right]), forest + np.array([0, cut])
        some = count > 0
        none = np.zeros(len(forest), np.int64)
        return pa.table({
            "node": pa.array(np.concatenate([nodes[some], nodes[forest[:, 0]]])),
            "other": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(nodes[forest[:, 1]])]),
            "n": pa.array(np.concatenate([count[some], none])),
        })

    full = candidates.join(classes.select("node", "n", "embedding"), "node").select("a", "b", "side", "node", "n", "embedding")
    return saved(full.groupBy("a", "b").applyInArrow(meet, "node long, other long, n long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 8192, tile_bytes: int = 1 << 23) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors(vec_id, label, embedding)``.

    Rows of equal, not null labels link if the cosine of their vectors, in double precision, is at least ``threshold``, which is
    positive; ``n_links`` counts the other rows linked directly, equal ones too. ``component_id`` is the least vec_id reachable by
    links and ``kept`` says whether it is the row's own. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows of null label, link with nothing, nor do vectors of different length. Rows that repeat a vec_id
    are rows of their own. A null vec_id is nobody's component unless there is no other. Other columns are ignored; an empty
    table gives one.

    Tiles hold at most ``tile_rows`` vectors whose doubles fill at most ``tile_bytes``; a task holds two. Every two tiles of a label
    meet, so the work grows with the square of the number of different vectors of a label, as the comparison that is asked for does.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be within (0, 1]")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = rows.withColumn("h", F.when(fit, F.xxhash64("label", "embedding")))
    classes = rows.where(F.col("h").isNotNull()).groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()))
    tiles = _tiles(classes, tile_rows, tile_bytes)
    found = _links(_candidates(tiles, threshold), classes, threshold)
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("far")).withColumnRenamed("node", "c_node")
    reach = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = saved(reach.join(classes.select(F.col("node").alias("id"), F.col("id").alias("vec")), "id"))
    least = named.groupBy("component").agg(F.min("vec").alias("least")).withColumnRenamed("component", "l_component")
    named = named.join(least, F.col("component") == F.col("l_component")).select(F.col("id").alias("r_node"), "least")
    told = classes.join(counts, F.col("node") == F.col("c_node"), "left").join(named, F.col("node") == F.col("r_node"), "left")
    told = saved(told.select(F.col("h").alias("t_h"), F.col("label").alias("t_label"), F.col("embedding").alias("t_embedding"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce(F.when(F.col("r_node").isNotNull(), F.col("least")), F.col("id")).alias("component_id")))
    same = (F.col("h") == F.col("t_h")) & (F.col("label") == F.col("t_label")) & (F.col("embedding") == F.col("t_embedding"))
    out = rows.join(told, same, "left")
    component = F.when(F.col("t_h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
