"""Processes and threads rebuilt from start and end events, and which of them a profile is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberstack.operators.graph import reachable
from emberstack.operators.temporal import asof


def intervals(events: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``(key, start_ts, end_ts, *payload)`` from ``events(seq, ts, kind, key, *payload)`` of kinds start and end.

    A start with the payload of the start before it is the same entry. An end closes the latest entry started before it, the
    last such end counts; an end that no start precedes is ignored. Entries without an end have null.
    """
    order = Window.partitionBy(key).orderBy("ts", "seq")
    value = F.struct(*payload)
    starts = events.where("kind = 'start'").withColumn("__before", F.lag(value).over(order))
    starts = starts.where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(value)).drop("__before")
    both = starts.unionByName(events.where("kind = 'end'"))
    entry = F.sum((F.col("kind") == "start").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("__entry", entry).where("__entry > 0")
    first = [F.max(F.when(F.col("kind") == "start", F.col(c))).alias(c) for c in payload]
    return both.groupBy(key, "__entry").agg(F.max(F.when(F.col("kind") == "start", F.col("ts"))).alias("start_ts"), F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("end_ts"), *first).drop("__entry")


def closed_by_next(entries: DataFrame, key: str) -> DataFrame:
    """Entries without an end get the next one's start, as for logs that record no end."""
    return entries.withColumn("end_ts", F.coalesce("end_ts", F.lead("start_ts").over(Window.partitionBy(key).orderBy("start_ts"))))


def with_process(threads: DataFrame, processes: DataFrame) -> DataFrame:
    """``threads(pid, start_ts, ...)`` with ``process_start``, the start of the process of their pid alive when they started."""
    entries = processes.select("pid", "start_ts", F.col("start_ts").alias("process_start"))
    return asof(threads, entries, "pid", "start_ts", "start_ts", "process_start", [], False, "process_start")


def key_of(rank: Column, base: int) -> Column:
    """Numbers of processes start at ``2**32`` and those of threads at ``2**33``."""
    return F.lit(base) + rank - 1


def sampled_processes(threads: DataFrame, samples: DataFrame) -> DataFrame:
    """``(pid, process_start)`` of threads whose life overlaps the time from their tid's first to its last sample."""
    spans = samples.groupBy(F.col("tid").alias("__tid")).agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    alive = (F.col("tid") == F.col("__tid")) & (F.col("start_ts") <= F.col("__last")) & (F.col("end_ts").isNull() | (F.col("end_ts") >= F.col("__first")))
    return threads.join(spans, alive).select("pid", "process_start").distinct()


def targets(processes: DataFrame, marked: DataFrame, sampled: DataFrame, left_out: tuple[str, ...] = ("conhost.exe",)) -> DataFrame:
    """The processes a profile is about, ``(pid, start_ts)``: the marked ones and all their descendants but those of the left-out
    names; without any mark, the sampled ones.

    ``processes(pid, start_ts, ppid, name)``, ``marked(pid, ts)``, ``sampled(pid, start_ts)``. A parent is the process of the
    ppid alive when the child started, which is unique.
    """
    entries = processes.select("pid", "start_ts", F.col("start_ts").alias("found"))
    roots = asof(marked, entries, "pid", "ts", "start_ts", "found", [], False, "at").where("at is not null").select("pid", F.col("at").alias("start_ts"))
    children = processes.where(~F.coalesce(F.col("name"), F.lit("")).isin(*left_out) & (F.col("pid") != F.col("ppid"))).select("pid", F.col("start_ts").alias("child_start"), "ppid")
    parents = entries.withColumnRenamed("pid", "ppid")
    links = asof(children, parents, "ppid", "child_start", "start_ts", "found", [], True, "parent_start").where("parent_start is not null")
    node = lambda pid, start: F.struct(F.col(pid).alias("pid"), F.col(start).alias("start_ts"))
    closed = reachable(links.select(node("pid", "child_start").alias("child"), node("ppid", "parent_start").alias("parent")), roots.select(node("pid", "start_ts").alias("node"))).select("node.pid", "node.start_ts")
    none = marked.agg(F.count("*").alias("__marks")).where("__marks = 0")
    return closed.unionByName(sampled.select("pid", "start_ts").join(F.broadcast(none)).drop("__marks").distinct())  # one row or none
