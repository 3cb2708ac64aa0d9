"""Context switches and hardware counters credited to threads.

A tid's events between two of its start or end events are a segment. A segment is credited to the thread that the event closing it
is about; the last one, which nothing closes, to the thread alive at both its first and its last switch, if it is one thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberstack.operators.temporal import asof


def per_thread(switches: DataFrame, thread_events: DataFrame, threads: DataFrame) -> DataFrame:
    """``(thread_key, context_switches, pmc)`` for every thread with a switch.

    ``switches(seq, ts, old_tid, new_tid, pmc)``, ``thread_events(seq, ts, tid)``, ``threads(thread_key, tid, start_ts)``. A counter
    grows by its value at an exit less that at the enter before it, or by the value itself where it is smaller; tid 0 is no thread
    and has no counters. ``pmc`` has a place for each counter (a handful) that was seen.
    """
    none = F.lit(None).cast("array<bigint>")
    out = switches.select(F.col("old_tid").alias("tid"), "seq", "ts", F.lit("exit").alias("what"), "pmc")
    into = switches.select(F.col("new_tid").alias("tid"), "seq", "ts", F.lit("into").alias("what"), "pmc")
    marks = thread_events.select("tid", "seq", "ts", F.lit("mark").alias("what"), none.alias("pmc"))
    life = Window.partitionBy("tid").orderBy("seq", "what")
    is_mark = (F.col("what") == "mark").cast("long")
    rows = out.unionByName(into).unionByName(marks)
    rows = rows.withColumn("segment", F.sum(is_mark).over(life.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - is_mark)
    kinds = {k: F.when(F.col("what") == k, F.col("ts")) for k in ("exit", "into", "mark")}
    segments = rows.groupBy("tid", "segment").agg(
        F.count(kinds["exit"]).alias("exits"), F.count(F.coalesce(kinds["exit"], kinds["into"])).alias("n"),
        F.min(kinds["mark"]).alias("mark_ts"), F.min(F.coalesce(kinds["exit"], kinds["into"])).alias("a"), F.max(F.coalesce(kinds["exit"], kinds["into"])).alias("b"),
    ).where("n > 0")
    segments = segments.select("tid", "segment", "exits", F.coalesce("mark_ts", "a").alias("a"), F.coalesce("mark_ts", "b").alias("b"))
    entries = threads.select("tid", "start_ts", "thread_key")
    at = asof(asof(segments, entries, "tid", "a", "start_ts", "thread_key", [], False, "__a"), entries, "tid", "b", "start_ts", "thread_key", [], False, "__b")
    owned = at.where("__a = __b").select("tid", "segment", "exits", F.col("__a").alias("thread_key"))
    steps = rows.where("what <> 'mark' and tid <> 0").select("tid", "segment", "seq", "what", F.posexplode("pmc").alias("counter", "value"))
    before = Window.partitionBy("tid", "segment", "counter").orderBy("seq", "what")
    ran = (F.col("what") == "exit") & (F.lag("what").over(before) == "into")
    start = F.lag("value").over(before)
    steps = steps.withColumn("delta", F.when(ran, F.when(start > F.col("value"), F.col("value")).otherwise(F.col("value") - start)).otherwise(0))
    sums = steps.groupBy("tid", "segment", "counter").agg(F.sum("delta").alias("total"))
    counted = owned.join(sums, ["tid", "segment"]).groupBy("thread_key", "counter").agg(F.sum("total").alias("total"))
    return owned.groupBy("thread_key").agg(F.sum("exits").alias("context_switches")).join(in_order(counted, "thread_key"), "thread_key", "left")


def in_order(counted: DataFrame, key: str) -> DataFrame:
    """``(key, counter, total)`` to ``(key, pmc)``; a key has few counters."""
    found = F.array_sort(F.collect_list(F.struct("counter", "total")))
    return counted.groupBy(key).agg(F.transform(found, lambda x: x["total"]).alias("pmc"))


def per_process(threads: DataFrame) -> DataFrame:
    """``threads(process_key, context_switches, pmc)`` summed by process, counters place by place."""
    totals = threads.groupBy("process_key").agg(F.sum("context_switches").alias("context_switches"))
    counted = threads.select("process_key", F.posexplode("pmc").alias("counter", "value")).groupBy("process_key", "counter").agg(F.sum("value").alias("total"))
    return totals.join(in_order(counted, "process_key"), "process_key", "left")
