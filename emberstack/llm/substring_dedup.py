"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``words`` consecutive words of one document. Every word covered by a window whose word sequence also starts
anywhere else is removed. Equal windows have equal least grams (a gram is ``gram`` words), so only the least gram of
each window is fingerprinted: about one position in a dozen. The index keeps those fingerprints in runs, immutable
tables sorted by hash. A batch is counted into a run, which is merge-joined with the historical runs to find what
repeats, and appended; when there are too many runs they are compacted into one. Windows around a repeated fingerprint
are then verified: their own hashes, 96 bits over all their words, are counted exactly.

Every step that may meet a passage shared by very many documents is a partial aggregation or a semi-join, which Spark
splits; no group is gathered in one task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberstack.llm.hashing import Words, slices
from emberstack.llm.scratch import new_folder, remove, saved

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


class _Windows:
    """Least grams of the windows of a batch of texts."""

    def __init__(self, texts: pa.Array, words: int, gram: int):
        self.w = w = Words(texts)
        self.reach = reach = words - gram + 1  # grams in a window
        self.n = max(0, len(w.hashes) - words + 1)
        self.whole = w.whole(words) if self.n else np.zeros(0, bool)
        self.grams = w.grams(gram) if self.n else np.zeros(0, np.uint64)
        self.least = _slide(self.grams, reach, np.minimum)[: self.n] if self.n else self.grams

    def selected(self) -> np.ndarray:
        """Positions of grams that are the least of a whole window."""
        if not self.n:
            return np.zeros(0, np.int64)
        low = np.where(self.whole, self.least, np.uint64(0))
        pad = np.zeros(self.reach - 1, np.uint64)
        best = _slide(np.concatenate([pad, low, pad]), self.reach, np.maximum)
        return np.flatnonzero((best[: len(self.grams)] == self.grams) & (best[: len(self.grams)] > 0))

    def around(self, positions: np.ndarray) -> np.ndarray:
        """Starts of whole windows whose least gram is at one of ``positions`` (word numbers of the batch)."""
        if not self.n or not len(positions):
            return np.zeros(0, np.int64)
        marked = np.full(len(self.grams), NONE)
        marked[positions] = self.grams[positions]
        return np.flatnonzero(self.whole & (_slide(marked, self.reach, np.minimum)[: self.n] == self.least))


class FingerprintIndex:
    """Sorted immutable runs ``(h, n)``: fingerprints and how often each was seen.

    A run is a folder below ``location``, bucketed and sorted by hash, so that merge joins of runs and their compaction need no
    shuffle. It holds counts, pre-aggregated before they were shuffled, so a hash that is everywhere is one row. Its name
    says which batches it holds, so a later session finds the runs again, and a run whose batches a compacted one holds too
    is not read. Beside the runs of an index that is kept lie, by batch, the documents' fingerprints and texts, against
    which repeats are verified.
    """

    def __init__(self, spark: SparkSession, location: str, most_runs: int = 1):
        self.spark, self.location, self.most_runs = spark, location.rstrip("/"), most_runs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, int, int]] = []  # first batch, last batch, buckets
        for first, last, buckets in sorted(self._found(), key=lambda r: (r[0], -r[1])):
            if not self.runs or last > self.runs[-1][1]:
                self.runs.append((first, last, buckets))

    def _found(self) -> list[tuple[int, int, int]]:
        """The runs below ``location`` that were written to their end."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.location)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        names = [f.getPath().getName() for f in files.listStatus(top)]
        whole = [n for n in names if n.startswith("run-") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.location}/{n}/_SUCCESS"))]
        return [tuple(int(x) for x in n.split("-")[1:]) for n in whole]

    @property
    def batches(self) -> int:
        """How many batches the index holds."""
        return self.runs[-1][1] + 1 if self.runs else 0

    def _path(self, run: tuple[int, int, int], state: str = "run") -> str:
        return f"{self.location}/{state}-{run[0]}-{run[1]}-{run[2]}"

    def _write(self, counted: DataFrame, run: tuple[int, int, int], state: str = "run") -> None:
        name = f"run_{uuid.uuid4().hex}"
        counted.write.mode("overwrite").bucketBy(self.buckets, "h").sortBy("h").option("path", self._path(run, state)).saveAsTable(name, format="parquet")
        self.spark.sql(f"DROP TABLE {name}")  # its files stay

    @contextmanager
    def _tables(self, runs: list[tuple[int, int, int]], state: str = "run") -> Iterator[list[DataFrame]]:
        """The runs as tables that Spark knows to be bucketed, until what reads them is done."""
        names = []
        for run in runs:
            names.append(f"run_{uuid.uuid4().hex}")
            self.spark.sql(f"CREATE TABLE {names[-1]} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {run[2]} BUCKETS LOCATION '{self._path(run, state)}'")
        try:
            yield [self.spark.table(n) for n in names]
        finally:
            for n in names:
                self.spark.sql(f"DROP TABLE {n}")

    def seek(self, batch: DataFrame) -> DataFrame:
        """Count ``batch(h)`` into a run that is not yet of the index; gives the hashes ``(h)``, saved, of the batch that repeat in
        it or in history."""
        if len(self.runs) > self.most_runs:
            self.compact()
        run = (self.batches, self.batches, self.buckets)
        self._write(batch.groupBy("h").agg(F.count("*").alias("n")), run, "pending")
        with self._tables([run], "pending") as (own,), self._tables(self.runs) as history:
            repeated = own.where("n > 1").select("h")
            for old in history:
                repeated = repeated.unionByName(own.select("h").join(old.select("h").hint("merge"), "h"))
            return saved(repeated.distinct())  # so that Spark can split joins where a hash is frequent

    def commit(self) -> None:
        """The run that was counted last becomes one of the index."""
        run = (self.batches, self.batches, self.buckets)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(run, "pending"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(path, self.spark._jvm.org.apache.hadoop.fs.Path(self._path(run)))
        self.runs.append(run)

    def compact(self) -> None:
        """Merge all runs into one, adding counts, and remove those it was made of."""
        old = self.runs
        if len(old) < 2:
            return
        with self._tables(old) as (whole, *others):
            for run in others:
                other = run.select(F.col("h").alias("o_h"), F.col("n").alias("o_n"))
                whole = whole.join(other.hint("merge"), F.col("h") == F.col("o_h"), "full").select(F.coalesce("h", "o_h").alias("h"), (F.coalesce("n", F.lit(0)) + F.coalesce("o_n", F.lit(0))).alias("n"))
            self.runs = [(old[0][0], old[-1][1], self.buckets)]
            self._write(whole, self.runs[0])
        for run in old:
            remove(self.spark, self._path(run))

    def kept(self, what: str) -> DataFrame | None:
        """What lies beside the runs of earlier batches."""
        paths = [f"{self.location}/{what}-{b}" for b in range(self.batches)]
        return self.spark.read.parquet(*paths) if paths else None

    def keep(self, what: str, rows: DataFrame) -> None:
        """Lay ``rows`` beside the run of the batch that comes next."""
        rows.write.mode("overwrite").parquet(f"{self.location}/{what}-{self.batches}")


def fingerprints(rows: DataFrame, words: int, gram: int) -> DataFrame:
    """``rows(rk, text)`` to ``(h, rk, pos)``: the fingerprints of each text and the numbers of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            win = _Windows(batch.column("text"), words, gram)
            at = win.selected()
            doc = win.w.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(win.grams[at].view(np.int64)), batch.column("rk").take(pa.array(doc)), pa.array((at - win.w.first[doc]).astype(np.int32))], ["h", "rk", "pos"])

    return rows.select("rk", "text").mapInArrow(run, "h long, rk long, pos int")


def _kept(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _positions(lists: pa.Array, first: np.ndarray) -> np.ndarray:
    """Word numbers in the batch from a column of lists of word numbers in each document."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    return flat + np.repeat(first[: len(sizes)], sizes)


def _window_hashes(rows: DataFrame, words: int, gram: int) -> DataFrame:
    """``rows(id, text, marks)`` to ``(h, c, id, start)``: 96 bits of hash of every window around a mark, and its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            win = _Windows(batch.column("text"), words, gram)
            w = win.w
            at = win.around(_positions(batch.column("marks"), w.first))
            doc = w.doc[at]
            check = (w.grams(words, check=True)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w.grams(words)[at].view(np.int64)), pa.array(check), batch.column("id").take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32))], ["h", "c", "id", "start"])

    return rows.select("id", "text", "marks").mapInArrow(run, "h long, c int, id long, start int")


def remove_repeats(docs: DataFrame, words: int = 35, gram: int = 12, batches: int = 3, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])``, one row for each row of ``docs(doc_id, text)``.

    Null texts have no words; texts of fewer than ``words`` words keep all. Rows that repeat a doc_id, null ids too, are
    documents of their own, so two equal rows of ``words`` words or more lose all. Other columns are ignored. The corpus
    is ingested in ``batches`` batches by hash, and judged against all of it; the index is removed then. ``kept`` is the
    remaining text.
    """
    rows = _keyed(docs)
    found = saved(fingerprints(rows, words, gram))
    index = FingerprintIndex(docs.sparkSession, new_folder(docs.sparkSession))
    again = None
    for k in range(batches):
        more = index.seek(found.where(F.pmod(F.xxhash64("rk"), F.lit(batches)) == k).select("h"))
        index.commit()
        again = more if again is None else again.unionByName(more)
    remove(docs.sparkSession, index.location)
    return _judged(rows, found, again, words, gram, with_text)


def add_batch(docs: DataFrame, location: str, words: int = 35, gram: int = 12, with_text: bool = False, most_runs: int = 4) -> DataFrame:
    """As :func:`remove_repeats`, of a batch against itself and all batches that were added at ``location`` before it.

    ``location`` is a folder that the cluster shares and that outlives the session; batches of one index have the same ``words``
    and ``gram``. Earlier batches are not judged again. An empty batch is one too. The batch is of the index once the result is
    saved, so a failure leaves the index as it was.
    """
    spark = docs.sparkSession
    index = FingerprintIndex(spark, location, most_runs)
    rows = _keyed(docs)
    index.keep("fingerprints", fingerprints(rows, words, gram))
    index.keep("texts", rows.select("rk", "text").where("text is not null"))
    found = spark.read.parquet(f"{index.location}/fingerprints-{index.batches}")
    old_found, old_texts = index.kept("fingerprints"), index.kept("texts")
    again = index.seek(found.select("h"))
    past = None
    if old_found is not None:
        # The texts of history that hold a fingerprint of the batch, each once.
        marks = old_found.join(again, "h", "left_semi").groupBy("rk").agg(F.collect_set("pos").alias("marks")).withColumnRenamed("rk", "m_rk")
        past = old_texts.join(marks, F.col("rk") == F.col("m_rk")).select(F.lit(-1).cast("long").alias("id"), "text", "marks")
    out = saved(_judged(rows, found, again, words, gram, with_text, past))
    index.commit()
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("rk", F.xxhash64("doc_id", "text"))


def _judged(rows: DataFrame, found: DataFrame, again: DataFrame, words: int, gram: int, with_text: bool, past: DataFrame | None = None) -> DataFrame:
    """The result for ``rows(doc_id, text, rk)`` with fingerprints ``found``, of which those in ``again(h)`` repeat; windows of the
    texts in ``past`` count too."""
    none = F.array().cast("array<int>")
    # An equal key of two texts only adds windows to verify. Equal rows have one list of marks, no longer than their text.
    again = saved(again.distinct())  # so that Spark can split the join where a hash is frequent
    marks = found.join(again, "h", "left_semi").groupBy("rk").agg(F.collect_set("pos").alias("marks"))
    # Of equal texts one speaks for all: its windows count twice, and all of the texts lose every word that a window covers.
    texts = rows.select("rk", F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2"))
    equal = texts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rk").alias("lead")).where("n > 1 and h2 is not null")
    equal = texts.join(equal, ["h1", "h2"]).groupBy("rk").agg(F.max("h2").alias("e_h2"), F.max(F.col("rk") == F.col("lead")).alias("leads"))
    known = marks.join(equal, "rk", "full").withColumnRenamed("rk", "m_rk")
    marked = rows.join(known, F.col("rk") == F.col("m_rk"), "left")
    copy = F.coalesce(F.col("e_h2") == F.crc32(F.col("text").cast("binary")), F.lit(False))
    state = F.when(copy, F.when(F.col("leads"), "lead").otherwise("copy")).when(F.col("marks").isNotNull(), "open").otherwise("clean")
    marked = marked.withColumn("state", state).select("doc_id", "rk", "text", F.when(F.col("state").isin("open", "lead"), F.col("marks")).alias("marks"), "state")
    marked = marked.withColumn("marks", F.coalesce("marks", none))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def settle(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spoken = set()  # of equal rows in a task one is enough to speak for all
        for batch in slices(batches_):
            n, removed, sha, kept, left = [], [], [], [], []
            for text, state_, rk in zip(*(batch.column(c).to_pylist() for c in ("text", "state", "rk"))):
                own = (text or "").encode().split()
                gone = len(own) if state_ in ("lead", "copy") and len(own) >= words else 0
                done = state_ != "open"
                n.append(len(own))
                removed.append(gone)
                sha.append(_kept([] if gone else own) if done else None)
                kept.append(b" ".join([] if gone else own).decode() if done and with_text else None)
                left.append(text if state_ == "open" or state_ == "lead" and rk not in spoken else None)
                if state_ == "lead":
                    spoken.add(rk)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(left, pa.string()), batch.column("marks")], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "text", "marks"])

    judged = marked.mapInArrow(settle, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string, text string, marks array<int>")
    judged = saved(judged.withColumn("id", F.monotonically_increasing_id()))
    open_docs = judged.where("kept_sha256 is null")
    once = _window_hashes(open_docs, words, gram).groupBy("h", "c").agg(F.count("*").alias("n"))
    twice = _window_hashes(judged.where("kept_sha256 is not null and text is not null"), words, gram).groupBy("h", "c").agg((2 * F.count("*")).alias("n"))
    counted = once.unionByName(twice)
    if past is not None:
        counted = counted.unionByName(_window_hashes(past, words, gram).groupBy("h", "c").agg(F.count("*").alias("n")))
    shared = counted.groupBy("h", "c").agg(F.sum("n").alias("n")).where("n > 1").select("h", "c")
    shared = saved(shared)
    cover = _window_hashes(open_docs, words, gram).join(shared, ["h", "c"], "left_semi").groupBy("id").agg(F.collect_list("start").alias("cover"))
    open_docs = open_docs.select("id", "doc_id", "n_words", "text").join(cover.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left").select("doc_id", "n_words", "text", F.coalesce("cover", none).alias("cover"))

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches_):
            removed, sha, kept = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("cover")):
                own = text.encode().split()
                step = np.zeros(len(own) + 1, np.int64)
                begin = starts.values.to_numpy() if len(starts) else np.zeros(0, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + words, -1)
                left = [x for x, c in zip(own, np.cumsum(step).tolist()) if not c]
                removed.append(len(own) - len(left))
                sha.append(_kept(left))
                kept.append(b" ".join(left).decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = open_docs.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    rest = judged.where("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    out = rest.unionByName(done)
    return out if with_text else out.drop("kept")
