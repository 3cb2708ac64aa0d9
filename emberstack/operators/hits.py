"""Hit counts of entities over frames and samples, by sample source.

``frames(sample_id, source_id, depth, module, symbol, file, func_line, instr_line, is_leaf)``, depth 1 outermost. A recursive
function counts once for each frame. Every aggregate has partial sums before its shuffle. Where frames stand for several samples
each, ``weight`` names the column that says for how many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberstack.functions.scalars import percent


def sums(weight: str | None = None) -> list:
    if weight is None:
        return [F.count("*").alias("total"), F.sum(F.col("is_leaf").cast("long")).alias("self")]
    return [F.sum(weight).alias("total"), F.sum(F.when(F.col("is_leaf"), F.col(weight)).otherwise(0)).alias("self")]


def with_leaf(frames: DataFrame) -> DataFrame:
    """Marks the last frame of each sample."""
    return frames.withColumn("is_leaf", F.lead("depth").over(Window.partitionBy("sample_id").orderBy("depth")).isNull())


def function_hits(frames: DataFrame, weight: str | None = None) -> DataFrame:
    return frames.groupBy("source_id", "module", "symbol").agg(*sums(weight))


def module_hits(frames: DataFrame, weight: str | None = None) -> DataFrame:
    return frames.groupBy("source_id", "module").agg(*sums(weight))


def file_hits(frames: DataFrame, weight: str | None = None) -> DataFrame:
    """Frames without a file count for none."""
    return frames.where("file is not null and file <> ''").groupBy("source_id", "file").agg(*sums(weight))


def line_hits(frames: DataFrame, weight: str | None = None) -> DataFrame:
    return frames.where("file is not null and file <> ''").groupBy("source_id", "module", "symbol", "instr_line").agg(*sums(weight))


def function_attribution(frames: DataFrame) -> DataFrame:
    """File and line of a function as first seen, in the order of source, time, sample and depth."""
    first = F.min_by(F.struct("file", "func_line"), F.struct("source_id", "ts", "sample_id", "depth"))
    return frames.where("file is not null and file <> ''").groupBy("module", "symbol").agg(first.alias("f")).select("module", "symbol", "f.file", "f.func_line")


def root_hits(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """A total for each stack sample, a self hit for each empty stack."""
    depth = frames.groupBy("sample_id").agg(F.count("*").alias("n"))
    return samples.join(depth, "sample_id", "left").groupBy("source_id").agg(F.count("*").alias("total"), F.sum(F.col("n").isNull().cast("long")).alias("self"))


def caller_edges(frames: DataFrame) -> DataFrame:
    """Hits of adjacent frames, the root before the outermost; self is always 0."""
    order = Window.partitionBy("sample_id").orderBy("depth")
    name = F.concat_ws("!", "module", "symbol")
    edges = frames.select("source_id", F.coalesce(F.lag(name).over(order), F.lit("[root]")).alias("caller"), name.alias("callee"))
    return edges.groupBy("source_id", "caller", "callee").agg(F.count("*").alias("total"), F.lit(0).cast("long").alias("self"))


def function_edges(frames: DataFrame) -> DataFrame:
    """``(source_id, caller, callee, total)`` with functions as structs of module and symbol, so names may hold any characters; the
    root is a null caller."""
    order = Window.partitionBy("sample_id").orderBy("depth")
    function = F.struct("module", "symbol")
    edges = frames.select("source_id", F.lag(function).over(order).alias("caller"), function.alias("callee"))
    return edges.groupBy("source_id", "caller", "callee").agg(F.count("*").alias("total"))


def lone_hits(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hits of samples with a frame but no stack: each counts in full for its frame, and for no edge or tree node."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count("*").alias("self"))


def by_source(found: DataFrame, key: list[str], sources: int) -> DataFrame:
    """Hits ``(*key, source_id, total, self)`` as one row for each key, with a place for every source from 0 in ``hits``, zero where
    a source has none."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("self"))
    own = lambda c, s: F.coalesce(F.sum(F.when(F.col("source_id") == s, F.col(c))), F.lit(0).cast("long"))
    places = [F.struct(own("total", s).alias("total"), own("self", s).alias("self")) for s in range(sources)]
    return found.groupBy(*key).agg((F.array(*places) if places else F.array(zero)).alias("hits"))


def session_totals(samples: DataFrame) -> DataFrame:
    return samples.agg(F.countDistinct("process_id").alias("processes"), F.countDistinct("thread_id").alias("threads"), F.count("*").alias("samples"), (F.max("ts") - F.min("ts")).alias("runtime"))


def hottest(frames: DataFrame, samples: DataFrame, count: int, weight: str | None = None) -> DataFrame:
    """The ``count`` functions of any process with the most self hits, with shares of all ``samples``."""
    found = frames.groupBy("process_id", "module", "symbol").agg(*sums(weight))
    top = found.orderBy(F.desc("self"), F.desc("total"), "module", "symbol", "process_id").limit(count)
    top = top.join(F.broadcast(samples.agg(F.count("*").alias("whole"))))  # one row
    return top.select("process_id", "module", "symbol", "total", "self", *[percent(F.col(c), F.col("whole")).alias(f"{c}_percent") for c in ("self", "total")])


def sample_totals(samples: DataFrame) -> DataFrame:
    return samples.groupBy("source_id").agg(F.count("*").alias("total"))


def source_statistics(samples: DataFrame, ticks_per_second: int = 1_000_000) -> DataFrame:
    """Samples, first and last time and rate a second, 0 for no span."""
    span = F.max("ts") - F.min("ts")
    return samples.groupBy("source_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.when(span > 0, F.count("*") * F.lit(float(ticks_per_second)) / span).otherwise(0.0).alias("rate"))


def process_sample_info(samples: DataFrame) -> DataFrame:
    """Counts by process and source, and by thread within them (a null thread is the process's sum)."""
    return samples.rollup("process_id", "source_id", "thread_id").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 2").select("process_id", "source_id", F.when(F.col("g") == 0, F.col("thread_id")).alias("thread_id"), "n")
