"""A recording and the questions a profile viewer asks of it, each answered by a DataFrame.

A filter makes another recording, so there is nothing to invalidate. Shares are of the whole filtered recording.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberstack.functions import scalars
from emberstack.operators import calltree, dictionary, filters, hits, paging, switches
from emberstack.tables import saved

SORTS = {"name": ["symbol", "module"], "total": ["total", "symbol", "module"], "self": ["self", "symbol", "module"]}


@dataclass(frozen=True)
class Recording:
    """``samples(sample_id, source_id, ts, process_id, thread_id, stack_id)``, ``frames(stack_id, depth, module, symbol, file, func_line,
    instr_line, is_leaf)``, once for each distinct stack (see :mod:`emberstack.operators.dictionary`; a frame of null depth is
    of no stack), ``processes(process_id, pid, name, ...)``, ``threads(thread_id, process_id, ...)``. Samples without a stack_id are
    stacks of their own: ``frames(sample_id, ...)`` then.

    Times of a filter count from the session's start, which is ``origin`` in the samples' clock; negative ones are 0. Where a
    source knows them: ``source_names(source_id, name, has_stacks)``, and one row each of ``session(command_line, date, runtime_ns)`` and
    ``system(hostname, platform, architecture, cpu_name, n_processors)``."""

    samples: DataFrame
    frames: DataFrame
    processes: DataFrame
    threads: DataFrame
    filter: filters.SampleFilter = field(default_factory=filters.SampleFilter)
    ticks_per_second: int = 1_000_000
    origin: int = 0
    source_names: DataFrame | None = None
    session: DataFrame | None = None
    system: DataFrame | None = None

    def __post_init__(self) -> None:
        if "stack_id" not in self.samples.columns:
            object.__setattr__(self, "samples", self.samples.withColumn("stack_id", F.col("sample_id")))
            object.__setattr__(self, "frames", self.frames.withColumnRenamed("sample_id", "stack_id"))

    @property
    def stack_frames(self) -> DataFrame:
        """Frames by sample, unfiltered: a row for each frame of each sample. No question here needs them so."""
        own = self.samples.select("sample_id", F.col("stack_id").alias("__stack"))
        return self.frames.join(own, F.col("stack_id") == F.col("__stack")).select("sample_id", *[c for c in self.frames.columns if c != "stack_id"])

    def filtered(self, f: filters.SampleFilter) -> Recording:
        return replace(self, filter=f)

    def _samples(self, source: int | None = None, process: int | None = None) -> DataFrame:
        low, high = (None if t is None else max(0, t) + self.origin for t in (self.filter.min_time, self.filter.max_time))
        rows = filters.filtered(self.samples, replace(self.filter, min_time=low, max_time=high))
        rows = rows if source is None else rows.where(F.col("source_id") == source)
        return rows if process is None else rows.where(F.col("process_id") == process)

    def _weights(self, source: int | None = None, process: int | None = None) -> DataFrame:
        return dictionary.weights(self._samples(source, process))

    def _weighted(self, source: int | None = None, process: int | None = None) -> DataFrame:
        return dictionary.weighted(self.frames, self._weights(source, process))

    def _without_frames(self, source: int, process: int) -> DataFrame:
        """``(self)``: how many samples have no stack."""
        known = self.frames.select(F.col("stack_id").alias("__stack")).distinct()
        rows = self._weights(source, process).join(known, F.col("stack_id") == F.col("__stack"), "left_anti")
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("self"))

    def sample_sources(self) -> DataFrame:
        """Without the filter: it says what was recorded."""
        found = hits.source_statistics(self.samples, self.ticks_per_second)
        if self.source_names is None:
            return found
        none = F.lit(0).cast("long")
        found = self.source_names.join(found.withColumnRenamed("source_id", "__source"), F.col("source_id") == F.col("__source"), "left").drop("__source")
        return found.withColumns({"n": F.coalesce("n", none), "rate": F.coalesce("rate", F.lit(0.0))})

    def system_info(self) -> DataFrame:
        """One row, or none where the source says nothing of its system."""
        if self.system is not None:
            return self.system
        return self.samples.sparkSession.createDataFrame([], "hostname string, platform string, architecture string, cpu_name string, n_processors int")

    def session_info(self) -> DataFrame:
        """One row; with ``command_line``, ``date`` and ``runtime_ns`` where the source knows them."""
        found = hits.session_totals(self.samples)
        return found if self.session is None else found.join(F.broadcast(self.session))  # one row each

    def process_list(self) -> DataFrame:
        """Processes with their threads; with ``context_switches`` and ``pmc`` where threads have them."""
        kids = self.threads.groupBy(F.col("process_id").alias("__process")).agg(F.array_sort(F.collect_list(F.struct("thread_id", *[c for c in self.threads.columns if c not in ("thread_id", "process_id")]))).alias("threads"))
        out = self.processes.join(kids, F.col("process_id") == F.col("__process"), "left").drop("__process")
        if not {"context_switches", "pmc"} <= set(self.threads.columns):
            return out
        sums = switches.per_process(self.threads.withColumnRenamed("process_id", "process_key"))
        return out.join(sums, F.col("process_id") == F.col("process_key"), "left").drop("process_key")

    def process_sizes(self) -> DataFrame:
        """``(process_id, n_modules, n_functions, n_files)``: how many different ones the samples of a process met. Stacks are told apart
        before their frames are read."""
        own = self._samples().select("process_id", F.col("stack_id").alias("__stack")).distinct()
        met = self.frames.join(own, F.col("stack_id") == F.col("__stack")).select("process_id", "module", "symbol", F.nullif("file", F.lit("")).alias("file")).distinct()
        return met.groupBy("process_id").agg(F.count_distinct("module").alias("n_modules"), F.count_distinct(F.struct("module", "symbol")).alias("n_functions"), F.count_distinct("file").alias("n_files"))

    def _with_samples(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with ``samples``, an array of (source_id, source, n) for every source of the recording, zero where there are none."""
        counted = self._samples().groupBy(key, "source_id").agg(F.count("*").alias("n"))
        counted = counted.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("source_id", "n"))).alias("__n"))
        known = self.sample_sources()
        named = F.col("name") if "name" in known.columns else F.lit(None).cast("string")
        known = known.agg(F.array_sort(F.collect_list(F.struct("source_id", named.alias("source")))).alias("__sources"))  # one row, of a handful
        found = rows.join(counted, F.col(key) == F.col("__key"), "left").join(F.broadcast(known))
        number = lambda x: F.coalesce(F.try_element_at("__n", x["source_id"]), F.lit(0).cast("long"))
        samples = F.transform("__sources", lambda x: F.struct(x["source_id"].alias("source_id"), x["source"].alias("source"), number(x).alias("n")))
        return found.select(*rows.columns, samples.alias("samples"))

    def process_report(self) -> DataFrame:
        """:meth:`process_list` with the samples of each process and thread by source, and the sizes of what they met."""
        none = F.lit(0).cast("long")
        threads = self._with_samples(self.threads, "thread_id")
        rows = self._with_samples(replace(self, threads=threads).process_list(), "process_id")
        sizes = self.process_sizes().withColumnRenamed("process_id", "__process")
        rows = rows.join(sizes, F.col("process_id") == F.col("__process"), "left").drop("__process")
        return rows.withColumns({c: F.coalesce(c, none) for c in ("n_modules", "n_functions", "n_files")})

    def hottest_functions(self, count: int, source: int) -> DataFrame:
        """By self hits over all processes, with shares of the source's samples."""
        return hits.hottest(self._weighted(source), self._samples(source), count, "n")

    def functions_page(self, process: int, source: int, sort_by: str, size: int, index: int, descending: bool = False) -> DataFrame:
        if sort_by not in SORTS:
            raise ValueError(f"sort by one of {', '.join(SORTS)}")
        return paging.page(hits.function_hits(self._weighted(source, process), "n").drop("source_id"), SORTS[sort_by], size, index, descending)

    def process_sample_info(self, process: int) -> DataFrame:
        """Counts of a process by source, and by thread; those by thread are there for an excluded process too."""
        own = replace(self, filter=replace(self.filter, excluded_processes=()))._samples(process=process)
        rows = hits.process_sample_info(own)
        return rows.where("thread_id is not null") if process in self.filter.excluded_processes else rows

    def call_tree(self, source: int, process: int) -> DataFrame:
        return calltree.nodes(self.frames.where("depth is not null"), weights=self._weights(source, process))

    def hot_path(self, source: int, process: int) -> DataFrame:
        return calltree.hot_path(saved(self.call_tree(source, process)), self._without_frames(source, process))

    def hot_tree(self, source: int, process: int) -> DataFrame:
        """What a viewer shows at first: the children of every node on the hot path, with shares of all samples of the source."""
        shown = calltree.hot_tree(saved(self.call_tree(source, process)), self._without_frames(source, process))
        whole = self._samples(source).agg(F.count("*").alias("whole"))  # one row
        return shown.join(F.broadcast(whole)).select(*shown.columns, *[scalars.percent(F.col(c), F.col("whole")).alias(f"{c}_percent") for c in ("self", "total")])

    def expand(self, source: int, process: int, of: str | int = calltree.ROOT) -> DataFrame:
        """The children of a node, by its key (or path)."""
        return calltree.children(self.call_tree(source, process), of)

    def callers_and_callees(self, module: str, symbol: str, source: int, process: int, most: int) -> DataFrame:
        """``(side, module, symbol, edge_total, source_id, total, self)``: the callers and callees of a function that most hits of
        ``source`` pass through, and "[others]"; ``edge_total`` is what passes between, ``total`` and ``self`` are the function's own
        hits by source, summed over the others. Of the root, which is no function, the own hits are those of the edge."""
        weights = self._weights(process=process)
        return paging.neighbours(dictionary.edges(self.frames, weights), hits.function_hits(dictionary.weighted(self.frames, weights), "n"), module, symbol, source, most)

    def _neighbours(self, module: str, symbol: str, source: int, process: int, most: int, near: str, own: str) -> DataFrame:
        """Functions are told apart by module and symbol; they are joined for people to read only."""
        found = dictionary.edges(self.frames, self._weights(source, process))
        found = found.where((F.col(f"{own}.module") == module) & (F.col(f"{own}.symbol") == symbol))
        rank, most = Window.orderBy(F.desc("total"), near), max(1, most)  # the neighbours of one function
        ranked = found.withColumns({"__rn": F.row_number().over(rank), "__n": F.count("*").over(Window.partitionBy())})
        kept = (F.col("__n") <= most) | (F.col("__rn") < most)
        ranked = ranked.select(F.when(kept, F.col(near)).alias("other"), kept.alias("kept"), "total")
        summed = ranked.groupBy("other", "kept").agg(F.sum("total").alias("total"))
        shown = F.when(~F.col("kept"), "[others]").when(F.col("other").isNull(), "[root]").otherwise(F.concat_ws("!", "other.module", "other.symbol"))
        return summed.select(F.lit(f"{module}!{symbol}").alias(own), shown.alias(near), "total")

    def callers(self, module: str, symbol: str, source: int, process: int, most: int) -> DataFrame:
        return self._neighbours(module, symbol, source, process, most, "caller", "callee")

    def callees(self, module: str, symbol: str, source: int, process: int, most: int) -> DataFrame:
        return self._neighbours(module, symbol, source, process, most, "callee", "caller")

    def line_info(self, module: str, symbol: str, process: int) -> DataFrame:
        """Line hits by source, with the function's file and first line; no row for a function without a file."""
        own = self._weighted(process=process).where((F.col("module") == module) & (F.col("symbol") == symbol))
        named = hits.function_attribution(own).select(F.col("file").alias("function_file"), F.col("func_line").alias("function_line"))  # one row or none
        return hits.line_hits(own, "n").join(F.broadcast(named))

    def _sampled_frames(self) -> DataFrame:
        own = self._samples().withColumnRenamed("stack_id", "__stack")
        return self.frames.join(own, F.col("stack_id") == F.col("__stack")).drop("__stack", "stack_id")

    def system_views(self, prefix: str = "") -> None:
        """Registers the filtered tables as views for SQL."""
        for name, df in (("samples", self._samples().drop("stack_id")), ("frames", self._sampled_frames()), ("processes", self.processes), ("threads", self.threads)):
            df.createOrReplaceTempView(f"{prefix}{name}")
