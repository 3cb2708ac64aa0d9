"""N-gram Jaccard self-join by the pigeonhole principle over a partitioned universe.

A document is the set of its word shingles. If two sets have similarity s/100 or more, their symmetric difference is at
most H, which their sizes bound. Sets fall into bands by size; for a band, shingles are hashed into segments of the
universe. Of m segments at least m - H agree in full, and of segments that are each allowed one difference at least
m - H/2 agree up to one. A signature is the hash of a set's subset in a segment, or, with one difference allowed,
also of that subset less any one shingle. Which kind a band gets, and how many segments, is chosen by cost: signatures
written against the accidental matches that small subsets bring. A few spare segments make up for empty subsets, which get
no signature; the few sets with more of them than that get one for the empty subset as well, so nothing is lost.

Tables that grow with the corpus are merge-joined at every size, never broadcast.

Documents that share a signature are compared exactly, in blocks of bounded size. First the blocks of documents with the same
least partner, which settles most groups of near copies; then, for buckets whose members are not yet in one component,
every two blocks that meet in such a bucket. A block's links leave it as a spanning forest, never as all pairs. Blocks are
bounded by shingles and by documents. A signature that very many sets share is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberstack.llm.components import connected_components
from emberstack.llm.hashing import Words, mix, slices
from emberstack.llm.scratch import saved, with_row_names

#: Spare segments: half as many as others, this many at most, and one for each of so many others.
SPARE, SPARE_EACH = 4, 8
#: Accidental matches count as this many signatures each.
MATCH_COST = 8.0
#: Shingles and documents in a block of documents that are compared with each other; numbers in a slice of their matrix.
BLOCK, BLOCK_DOCS = 150_000, 2048
CELLS = 1 << 23
#: Signatures that may be frequent are found by counting hash slots over one document in so many, which decides nothing but
#: how their rows are spread over tasks.
COUNTED_EACH, SLOTS = 16, 1 << 20
PARTS = 64
NEED = 1024


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ordered by text and hash, and the texts' bounds in them.

    Shingles are ``k`` consecutive words, A-Z lower-cased; a text of fewer words is one shingle; one without words has none.
    """
    w = Words(texts, lower=True)
    whole = w.whole(k)
    docs, hashes = w.doc[: len(whole)][whole], w.grams(k)[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, w.span(w.first[short], w.counts[short])])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    if len(docs):
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        docs, hashes = docs[new], hashes[new]
    return hashes, np.searchsorted(docs, np.arange(w.n_docs + 1))


def apart(total: int, percent: int) -> int:
    """Most elements in the symmetric difference of linked sets whose sizes add up to ``total``."""
    return total * (100 - percent) // (100 + percent)


class Bands:
    """Size bands, and for each the kind and number of segments. A set is indexed in every band that may hold the larger set
    of a pair with it: its own and, as the smaller one, the next."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        self.kind: list[tuple[int, bool, int]] = []

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            lo = self.low[-1]
            hi = max(lo, lo * 100 // self.percent)
            self.kind.append(self._allocate(hi, apart(2 * hi, self.percent)))
            self.low.append(hi + 1)

    def _allocate(self, size: int, most: int) -> tuple[int, bool, int]:
        """(segments, one difference allowed, segments that surely agree) for a band of sets up to ``size``."""
        choices = []
        for loose in (False, True):
            units = most // 2 + 1 if loose else most + 1
            m = units + min(SPARE, units // 2) + units // SPARE_EACH
            subset = size / m
            cost = m + loose * size + MATCH_COST * m * 2.0 ** -(subset - loose)
            choices.append((cost, loose, m, m - units + 1))
        _, loose, m, sure = min(choices)
        return m, loose, sure

    def farthest(self, band: int, size: int) -> int:
        """Most elements in the symmetric difference of a set of ``size`` and a linked one, the larger of the two in ``band``."""
        return apart(size + min(self.low[band + 1] - 1, size * 100 // self.percent), self.percent)

    def of(self, size: int) -> list[tuple[int, int, bool, int]]:
        self._grow(size * 100 // self.percent + 1)
        own = int(np.searchsorted(self.low, size, side="right")) - 1
        out = [(own, *self.kind[own])]
        nxt = own + 1
        while nxt < len(self.kind) and self.low[nxt] * self.percent <= 100 * size:
            out.append((nxt, *self.kind[nxt]))
            nxt += 1
        return out


def signatures_of(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set, given as distinct 64-bit hashes, and for each NEED * band + how many of that band's
    signatures any partner in it shares at least."""
    out, tags = [], []
    for band, m, loose, sure in bands.of(len(tokens)):
        spread = mix(tokens + np.uint64(0x51ED2701 + 2 * band))
        segment = (spread % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        count = np.bincount(segment, minlength=m)
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(spread[order], out=total[1:])
        ends = np.cumsum(count)
        sums = total[ends] - total[ends - count]
        tag = mix((np.arange(m) + (band << 32)).astype(np.uint64))
        weak = int((count <= loose).sum())
        have = count > 0 if weak < sure else np.ones(m, bool)
        found = [(sums ^ tag)[have]]
        if loose:
            less = sums[segment] - spread
            keep = (count[segment] > 1) | (weak >= sure)
            found.append((less ^ tag[segment])[keep])
        out.append(mix(np.unique(np.concatenate(found))))
        need = m - bands.farthest(band, len(tokens)) - weak
        tags.append(np.full(len(out[-1]), NEED * band + (min(NEED - 1, need) if weak < sure and not loose else 1), np.int32))
    return np.concatenate(out), np.concatenate(tags)


def _sizes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2) of every row; h1 and h2 identify the set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingle_sets(batch.column("text"), k)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (hashes, mix(hashes + np.uint64(7)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums)], ["doc_id", "n_shingles", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, h1 long, h2 long")


def _frequent_slots(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """Hash slots of signatures that are far more frequent than others, at most SLOTS numbers."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(COUNTED_EACH)) == 0)
    counts = saved(_signatures(part, k, percent).groupBy(F.pmod("sig", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count("*").alias("n")))
    usual = counts.agg((64 + 8 * F.coalesce(F.sum("n"), F.lit(0)) / SLOTS).alias("usual"))
    return counts.join(F.broadcast(usual)).where("n > usual").select("slot").toArrow().column("slot").to_numpy()  # usual is one row


def _buckets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(sig, tag, node, pivot)`` for each signature that two sets share, pivot the least node that has it.

    A signature's rows meet in a window; those of frequent signatures in PARTS windows each, whose ends are then aggregated
    and joined back, which Spark splits."""
    slots = docs.sparkSession.sparkContext.broadcast(_frequent_slots(docs, k, percent))
    part = Window.partitionBy("sig", "part")
    rows = _signatures(docs, k, percent, slots).withColumns({"low": F.min("node").over(part), "top": F.max("node").over(part)})
    rows = saved(rows.where("low < top or part > 0"))
    few = rows.where("part = 0").select("sig", "tag", "node", F.col("low").alias("pivot"))
    many = rows.where("part > 0")
    ends = many.groupBy(F.col("sig").alias("e_sig")).agg(F.min("low").alias("pivot"), F.max("top").alias("e_top")).where("pivot < e_top")
    return few.unionByName(many.join(ends, F.col("sig") == F.col("e_sig")).select("sig", "tag", "node", "pivot"))


def _signatures(docs: DataFrame, k: int, percent: int, frequent: Broadcast | None = None) -> DataFrame:
    """(sig, tag, node, part) of the documents, each set once for a task: copies are combined before the shuffle. ``part`` is 0, for
    signatures in the ``frequent`` slots one of PARTS numbers by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        spread = np.zeros(SLOTS, bool)
        if frequent is not None:
            spread[frequent.value] = True
        for batch in slices(batches):
            hashes, at = shingle_sets(batch.column("text"), k)
            ids = batch.column("doc_id").to_numpy()
            sigs, tags, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for i in range(len(ids)):
                own = hashes[at[i] : at[i + 1]]
                if not len(own):
                    continue
                key = (len(own), int(own.sum(dtype=np.uint64)), int(own[0]))
                if key in seen:
                    continue
                seen.add(key)
                sig, tag = signatures_of(own, bands)
                sigs.append(sig)
                tags.append(tag)
                nodes.append(np.full(len(sigs[-1]), ids[i], np.int64))
            sig, node = np.concatenate(sigs).view(np.int64), np.concatenate(nodes)
            part = np.where(spread[sig % SLOTS], 1 + (mix(node.view(np.uint64)) % np.uint64(PARTS)).astype(np.int8), 0).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate(tags)), pa.array(node), pa.array(part)], ["sig", "tag", "node", "part"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "sig long, tag int, node long, part byte")


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, as (row, root)."""
    out, left = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root] = False
        reach = [root]
        while reach:
            near = np.flatnonzero(links[reach].any(axis=0) & left)
            left[near] = False
            out += [(int(x), root) for x in near]
            reach = near.tolist()
    return out


def links_of(texts: pa.Array, k: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between some texts, from the exact intersections of all their sets."""
    hashes, at = shingle_sets(texts, k)
    size = np.diff(at)
    docs = np.repeat(np.arange(len(size)), size)
    order = np.argsort(hashes, kind="stable")
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    token = np.cumsum(new) - 1
    count = np.bincount(token)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[token]
    docs, column = docs[keep], column[token[keep]]
    n, total = len(size), int(shared.sum())
    width = max(64, min(8192, CELLS // max(n, 1)))
    edges = np.searchsorted(column, np.arange(0, total + width, width))
    common = np.zeros((n, n), np.float32)
    for c, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = np.zeros((n, width), np.float32)
        part[docs[lo:hi], column[lo:hi] - c * width] = 1
        common += part @ part.T
    linked = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        rows = common[at : at + 256].astype(np.int64)
        linked[at : at + 256] = (rows * (100 + percent) >= (size[at : at + 256, None] + size[None, :]) * percent) & (rows > 0)
    return _forest(linked)


def _block_links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``rows(task, node, text)`` to links ``(a, b)``: all texts of a task are compared with each other."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts, nodes = table.column("text").combine_chunks(), table.column("node").to_numpy()
        found = [(nodes[x], nodes[y]) for x, y in links_of(texts, k, percent) if nodes[x] != nodes[y]]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.select("task", "node", "text").groupBy("task").applyInArrow(run, "a long, b long")


def _sketches(rows: DataFrame, k: int) -> DataFrame:
    """``rows(node, text)`` to ``(node, n, sketch)``: for each of a power of two of segments, about half as many as shingles, the
    sum of its shingles modulo 256. Segments that differ bound the symmetric difference from below, and adding the halves of a
    sketch gives the one of half as many segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingle_sets(batch.column("text"), k)
            out = []
            for a, b in zip(at, at[1:]):
                m = 1 << min(14, max(6, int(b - a).bit_length() - 1))
                own = mix(hashes[a:b] + np.uint64(3))
                out.append((np.bincount((own % np.uint64(m)).astype(np.int64), weights=(own >> np.uint64(56)).astype(np.float64), minlength=m).astype(np.int64) & 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(at)), pa.array(out, pa.binary())], ["node", "n", "sketch"])

    return rows.select("node", "text").mapInArrow(run, "node long, n long, sketch binary")


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """``rows(task, node, component, home, n, sketch)`` to the ``(task, node)`` that may have a link across homes and components."""

    def run(table: pa.Table) -> pa.Table:
        n, home, group = (table.column(c).to_numpy() for c in ("n", "home", "component"))
        raw = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
        width = np.array([len(x) for x in raw])
        may = np.zeros(len(n), bool)
        for m in np.unique(width):
            own = np.flatnonzero(width >= m)
            folded = np.stack([raw[i].reshape(-1, m).sum(axis=0, dtype=np.uint8) for i in own])
            for row, i in zip(folded[width[own] == m], own[width[own] == m]):
                low, high = np.minimum(n[own], n[i]), np.maximum(n[own], n[i])
                common = -(-percent * (low + high) // (100 + percent))
                ok = (common <= low) & (home[own] != home[i]) & (group[own] != group[i])
                ok[ok] = (folded[ok] != row).sum(axis=1) <= (low + high - 2 * common)[ok]
                if ok.any():
                    may[i] = True
                    may[own[ok]] = True
        return table.select(["task", "node"]).filter(pa.array(may))

    kind = rows.schema["task"].dataType.simpleString()
    return rows.select("task", "node", "component", "home", "n", "sketch").groupBy("task").applyInArrow(run, f"task {kind}, node long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs(doc_id, text)``, LONG ids.

    Rows are linked when ``100 * intersection >= percent * union`` of their shingle sets. ``component_id`` is the least doc_id
    reachable by links, the row's own included. Texts that are null, empty or without words have an empty set and no link.
    Rows that repeat a doc_id are one document as far as ids go: what one links to, so do the others. A null doc_id
    can't be named: such a row gets the component of its exact copies, else null, and links nothing. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sizes = saved(_sizes(docs, k))
    members = _buckets(docs, k, percent)
    # Groups by the least member of any bucket, dealt into blocks of bounded text; each block is compared with itself and the
    # group's least member.
    group = members.groupBy("node").agg(F.min("pivot").alias("g"))
    size = sizes.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("s_node")).agg(F.sum("n_shingles").alias("n"))
    group = saved(group.join(size, F.col("node") == F.col("s_node")).select("node", "g", "n"))
    blocks = group.groupBy("g").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks")).withColumnRenamed("g", "b_g")
    group = group.join(blocks, F.col("g") == F.col("b_g")).select("node", "g", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    group = saved(group)
    needed = group.select("node")
    texts = saved(docs.withColumn("node", F.col("doc_id").cast("long")).join(needed.hint("merge"), "node", "left_semi").select("node", "text"))
    leaders = group.select("g", "blocks").distinct().select(F.col("g").alias("node"), "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = group.select("node", "g", "block").unionByName(leaders).distinct()
    rows = own.select("node", F.struct("g", "block").alias("task")).join(texts.hint("merge"), "node")
    links = _block_links(rows, k, percent)
    copies = sizes.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    copies = saved(sizes.where("n_shingles > 0").join(copies, ["n_shingles", "h1", "h2"]).select("doc_id", "rep", "n_shingles", "h1", "h2").where("rep is not null"))
    same = copies.where("doc_id <> rep").select(F.col("doc_id").cast("long").alias("a"), F.col("rep").cast("long").alias("b")).distinct()
    known = saved(links.unionByName(same).distinct())
    groups = connected_components(known)
    # Buckets whose members are in more than one component: the blocks of such members that meet often enough for a link.
    info = group.join(groups.hint("merge"), F.col("node") == F.col("id"), "left")
    info = saved(info.select(F.col("node").alias("i_node"), F.struct("g", "block").alias("home"), F.coalesce("component", "node").alias("component")))
    placed = members.select("sig", "tag", "node").join(info.hint("merge"), F.col("node") == F.col("i_node"))
    several = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(F.col("sig").alias("m_sig"))
    mixed = members.select("sig", "tag", "node").join(saved(several).hint("merge"), F.col("sig") == F.col("m_sig"), "left_semi")
    mixed = saved(mixed.join(info.hint("merge"), F.col("node") == F.col("i_node")).select("sig", "tag", "node", "component", "home"))
    need = mixed.groupBy("home", F.expr(f"tag div {NEED}").alias("band")).agg(F.min(F.col("tag") % NEED).alias("need"))
    homes = saved(mixed.select("sig", F.expr(f"tag div {NEED}").alias("band"), "home").distinct().join(need, ["home", "band"]))
    pairs = homes.join(homes.select(F.col("sig").alias("o_sig"), F.col("home").alias("other"), F.col("need").alias("o_need")), (F.col("sig") == F.col("o_sig")) & (F.col("home") < F.col("other")))
    pairs = pairs.groupBy("home", "other", "band").agg(F.count("*").alias("shared"), F.max(F.greatest("need", "o_need")).alias("least")).where("shared >= least")
    tasks = saved(pairs.select(F.struct("home", "other").alias("task"), "home", "other").distinct())
    loose = mixed.select("node", "component", F.col("home").alias("n_home")).distinct()
    ends = tasks.select("task", "home").unionByName(tasks.select("task", F.col("other").alias("home")))
    sketches = saved(_sketches(texts.join(loose.select("node").distinct(), "node", "left_semi"), k))
    rows = ends.join(loose, F.col("home") == F.col("n_home")).select("task", "node", "component", F.xxhash64("home").alias("home")).join(sketches, "node")
    near = saved(_near(rows, percent))
    more = saved(_block_links(near.join(texts, "node"), k, percent).distinct())
    groups = connected_components(known.unionByName(more)) if more.head(1) else groups
    named = sizes.withColumn("own", F.col("doc_id").cast("long")).join(groups, F.col("own") == F.col("id"), "left")
    named = named.select("doc_id", "n_shingles", "h1", "h2", F.coalesce("component", "own").alias("component_id"))
    lost = copies.where("doc_id is null").select("n_shingles", "h1", "h2", F.col("rep").cast("long").alias("rep")).distinct()
    lost = lost.join(groups, F.col("rep") == F.col("id"), "left").select(F.col("n_shingles").alias("c_n"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), F.coalesce("component", "rep").alias("c_component"))
    unnamed = named.where("doc_id is null").join(lost, (F.col("n_shingles") == F.col("c_n")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2")), "left").select("doc_id", "n_shingles", F.col("c_component").alias("component_id"))
    return named.where("doc_id is not null").select("doc_id", "n_shingles", "component_id").unionByName(unnamed)


ODD = 1 << 62  # rows that a doc_id can't name have numbers from here on


def _odd_rows(rows: DataFrame) -> DataFrame:
    """``(o_file, o_row, o_id, o_node)``, saved: the rows whose doc_id is null, not theirs alone or no number below ODD, each with a number
    of its own. Only ids are read."""
    own = rows.select(F.col("__file").alias("o_file"), F.col("__row").alias("o_row"), F.col("doc_id").alias("o_id"))
    repeated = own.where("o_id is not null").groupBy(F.col("o_id").alias("r_id")).agg(F.count("*").alias("n")).where("n > 1").select("r_id")
    odd = own.where(F.col("o_id").isNull() | (F.col("o_id") >= ODD))
    odd = odd.unionByName(own.where(F.col("o_id") < ODD).join(repeated, F.col("o_id") == F.col("r_id"), "left_semi"))
    return saved(odd.withColumn("o_node", F.lit(ODD) + F.monotonically_increasing_id()))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: of linked rows the one of least doc_id, null ids last.

    A row is named by its doc_id if no other row has it, else by a number of its own: rows that repeat an id stay or go by their
    own texts, and of exact copies one stays whatever its id. Of equal rows the one first numbered stays. Rows without words stay.
    """
    rows = with_row_names(docs)
    odd = _odd_rows(rows)
    if not odd.head(1):  # every row is named by its id, so no row needs its place
        keep = near_duplicates(docs, k, percent).where("doc_id = component_id").select(F.col("doc_id").alias("__keep"))
        return docs.join(keep, F.col("doc_id") == F.col("__keep"), "left_semi")
    names = odd.select(F.col("o_file").alias("__o_file"), F.col("o_row").alias("__o_row"), F.col("o_node").alias("__o_node"))
    rows = rows.join(names, (F.col("__file") == F.col("__o_file")) & (F.col("__row") == F.col("__o_row")), "left")
    rows = saved(rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("__o_node", "doc_id").alias("__node")))
    found = near_duplicates(rows.select(F.col("__node").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("n_node"), "component_id")
    found = found.join(odd.select("o_id", "o_node"), F.col("n_node") == F.col("o_node"), "left")
    name = F.when(F.col("o_node").isNull(), F.col("n_node")).otherwise(F.col("o_id")).alias("id")
    keep = found.groupBy("component_id").agg(F.min(F.struct((F.col("o_node").isNotNull() & F.col("o_id").isNull()).alias("none"), name, "n_node")).alias("least"))
    keep = keep.select(F.col("least.n_node").alias("__keep"))
    return rows.join(keep, F.col("__node") == F.col("__keep"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
