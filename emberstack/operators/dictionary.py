"""A dictionary of stacks: equal stacks are stored once, and what is asked of samples is asked of weighted stacks.

:class:`SlicedHits` keeps function hits by slices of time beside it, so that a filter reads no frame of what lies whole within it.

Samples name their stack; ``frames(stack_id, depth, module, symbol, ...)`` holds the frames of each stack once. A filter counts
the narrow samples into weights ``(stack_id, source_id, process_id, n, first)``, and only the stacks that are left meet their
frames, so no question reads a frame for each sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberstack.operators import filters, hits
from emberstack.operators.temporal import numbered
from emberstack.tables import saved


def hashed(*columns: str) -> Column:
    """An even number of 63 bits; odd ones are left for rows whose hash is also another's."""
    return F.shiftleft(F.xxhash64(*columns), 1)


def interned(samples: DataFrame, stack: list[str], number: str = "stack_id") -> tuple[DataFrame, DataFrame]:
    """``samples`` with ``stack_id`` (or ``number``) in place of the columns ``stack``, and the dictionary ``(stack_id, *stack)``, saved.

    Stacks are the same if all their columns are equal, nulls too; samples whose first column is null have a null stack_id and
    no entry. A stack is numbered by its hash, so its samples know it without meeting the dictionary; only stacks that share a
    hash with others are told apart by the columns themselves, so no two share a number. A stack of very many samples is one row
    before it is shuffled.
    """
    keyed = samples.withColumn("__hash", F.when(F.col(stack[0]).isNotNull(), hashed(*stack)))
    distinct = saved(keyed.where("__hash is not null").groupBy("__hash", *stack).agg(F.count("*").alias("__n")).select("__hash", *stack))
    alike = saved(distinct.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("__hash").alias("__of")))
    rest, kept = [c for c in samples.columns if c not in stack], F.col("__hash").alias(number)
    if alike.isEmpty():
        return keyed.select(*rest, kept), distinct.select(kept, *stack)
    again = distinct.join(alike, F.col("__hash") == F.col("__of"), "left_semi")
    other = saved(again.select((2 * F.monotonically_increasing_id() + 1).alias("__number"), F.col("__hash").alias("__of"), *[F.col(c).alias(f"__of_{c}") for c in stack]))
    same = F.col("__hash") == F.col("__of")
    for c in stack:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    number_of = F.coalesce("__number", "__hash").alias(number)
    return keyed.join(other, same, "left").select(*rest, number_of), distinct.join(other, same, "left").select(number_of, *stack)


def numbered_functions(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``frames`` with ``function``, a number, in place of module and symbol, and ``(function, module, symbol)``: names are not shuffled
    with frames."""
    own = frames.withColumn("__name", F.struct("module", "symbol")).drop("module", "symbol")
    coded, functions = interned(own, ["__name"], "function")
    return coded, functions.select("function", "__name.*")


def weights(samples: DataFrame) -> DataFrame:
    """``(stack_id, source_id, process_id, n, first)`` of samples; ``first`` is the time and number of the earliest."""
    return samples.groupBy("stack_id", "source_id", "process_id").agg(F.count("*").alias("n"), F.min(F.struct("ts", "sample_id")).alias("first"))


def weighted(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """The frames of the stacks that have a weight, once for each source and process of it, with ``n``, and ``ts`` and ``sample_id`` of
    the earliest sample."""
    own = weights.select(F.col("stack_id").alias("__stack"), "source_id", "process_id", "n", "first.ts", "first.sample_id")
    return frames.join(own, F.col("stack_id") == F.col("__stack")).drop("__stack")


def function_hits(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """``(source_id, module, symbol, total, self)`` as :func:`emberstack.operators.hits.function_hits` gives them of :func:`weighted` frames."""
    return _named_hits(*numbered_functions(frames.select("stack_id", "is_leaf", "module", "symbol")), weights)


def _named_hits(coded: DataFrame, functions: DataFrame, weights: DataFrame) -> DataFrame:
    own = weights.groupBy(F.col("stack_id").alias("__stack"), "source_id").agg(F.sum("n").alias("n"))
    met = coded.join(own, F.col("stack_id") == F.col("__stack"))
    found = met.groupBy("source_id", F.col("function").alias("__of")).agg(*hits.sums("n"))
    return found.join(functions, F.col("__of") == F.col("function")).select("source_id", "module", "symbol", "total", "self")


def edges(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """``(source_id, caller, callee, total)`` of function structs, the root a null caller: adjacent frames of each stack once, times
    the stack's weights. They are added up by function numbers straight away, so a task holds different edges, not those of
    every stack."""
    coded, functions = numbered_functions(frames.where("depth is not null").select("stack_id", "depth", "module", "symbol"))
    lone = coded.select("stack_id", F.lag("function").over(Window.partitionBy("stack_id").orderBy("depth")).alias("from"), F.col("function").alias("to"))
    own = weights.groupBy(F.col("stack_id").alias("__stack"), "source_id").agg(F.sum("n").alias("n"))
    met = lone.join(own, F.col("stack_id") == F.col("__stack")).groupBy("source_id", "from", "to").agg(F.sum("n").alias("total"))
    names = lambda key, name: functions.select(F.col("function").alias(key), F.struct("module", "symbol").alias(name))
    met = met.join(names("__to", "callee"), F.col("to") == F.col("__to")).join(names("__from", "caller"), F.col("from") == F.col("__from"), "left")
    return met.select("source_id", "caller", "callee", "total")


class SlicedHits:
    """Function hits of ``samples`` over a dictionary of ``frames``, summed by slice of time, process, thread and source.

    Slices are ``width`` ticks of ``ts`` wide; the sums are written once, by slice. A time filter adds the sums of the slices that lie
    whole within it; only of the two slices that it cuts are the samples read, and the frames of their stacks. Processes
    and threads are columns of the sums, so leaving some out costs no frames at all.
    """

    def __init__(self, samples: DataFrame, frames: DataFrame, width: int):
        self.samples, self.width = samples, width
        keys = ["slice", "process_id", "thread_id", "source_id"]
        self.coded, self.functions = numbered_functions(frames.select("stack_id", "is_leaf", "module", "symbol"))
        counted = samples.withColumn("slice", self._slice(F.col("ts"))).groupBy("stack_id", *keys).agg(F.count("*").alias("n")).withColumnRenamed("stack_id", "__stack")
        met = self.coded.join(counted, F.col("stack_id") == F.col("__stack"))
        sums = met.groupBy(*keys, F.col("function").alias("__of")).agg(*hits.sums("n")).join(self.functions, F.col("__of") == F.col("function")).drop("__of", "function")
        self.sums = saved(sums.repartitionByRange("slice").sortWithinPartitions("slice"))

    def _slice(self, ts: Column) -> Column:
        return F.floor(ts / F.lit(self.width))

    def function_hits(self, f: filters.SampleFilter) -> DataFrame:
        """``(source_id, module, symbol, total, self)`` of the samples that pass ``f``, as :func:`emberstack.operators.hits.function_hits` gives them."""
        sums, edges = self.sums, []
        if f.min_time is not None:
            cut = f.min_time // self.width
            whole = cut * self.width == f.min_time
            sums = sums.where(F.col("slice") >= cut + (not whole))
            edges += [] if whole else [cut]
        if f.max_time is not None:
            cut = f.max_time // self.width
            whole = (cut + 1) * self.width - 1 == f.max_time
            sums = sums.where(F.col("slice") <= cut - (not whole))
            edges += [] if whole else [cut]
        sums = filters.filtered(sums, filters.SampleFilter(excluded_processes=f.excluded_processes, excluded_threads=f.excluded_threads))
        found = sums.groupBy("source_id", "module", "symbol").agg(F.sum("total").alias("total"), F.sum("self").alias("self"))
        if not edges:
            return found
        at_edge = F.lit(False)
        for cut in dict.fromkeys(edges):
            at_edge = at_edge | F.col("ts").between(cut * self.width, (cut + 1) * self.width - 1)
        own = _named_hits(self.coded, self.functions, weights(filters.filtered(self.samples.where(at_edge), f)))
        both = found.unionByName(own)
        return both.groupBy("source_id", "module", "symbol").agg(F.sum("total").alias("total"), F.sum("self").alias("self"))


class SortedPages:
    """Rows kept in several orders, so that a page is read by its places: a range of numbers in a table sorted by them, not a sort.

    ``orders`` are lists of columns by name; a descending page is read from the other end.
    """

    def __init__(self, rows: DataFrame, orders: dict[str, list[str]]):
        self.columns, self.tables, self.rows = rows.columns, {}, 0
        rows = saved(rows)
        for name, order in orders.items():
            placed = numbered(rows, [*order, *[c for c in rows.columns if c not in order]], "__place")
            self.tables[name] = saved(placed.sortWithinPartitions("__place"))
        self.rows = rows.count()

    def page(self, order: str, size: int, index: int, descending: bool = False) -> DataFrame:
        """The rows of page ``index``, from 0, of ``size`` rows, in order."""
        first, last = index * size, min(self.rows, (index + 1) * size) - 1
        low, high = (self.rows - 1 - last, self.rows - 1 - first) if descending else (first, last)
        place = F.col("__place")
        return self.tables[order].where(place.between(low, high)).orderBy(place.desc() if descending else place).select(*self.columns)
