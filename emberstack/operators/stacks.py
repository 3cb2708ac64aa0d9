"""Stacks brought together with the samples they belong to.

``samples(sample_id, source_id, tid, ts, seq)``; addresses of a stack are leaf first. Everything is joined by thread and time,
so no side is broadcast and nothing depends on the order in which a file is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberstack.functions.scalars import is_kernel_address
from emberstack.operators.temporal import following


def _sampled(samples: DataFrame, events: DataFrame) -> DataFrame:
    """``events(seq, event_ts, tid, ...)`` with the last sample before them of each source at their thread and time."""
    s = samples.select("sample_id", "source_id", F.col("tid").alias("__tid"), F.col("ts").alias("__ts"), F.col("seq").alias("__seq"))
    met = events.join(s, (F.col("tid") == F.col("__tid")) & (F.col("event_ts") == F.col("__ts")) & (F.col("__seq") < F.col("seq")))
    last = F.row_number().over(Window.partitionBy("tid", "event_ts", "seq", "source_id").orderBy(F.desc("__seq"), F.desc("sample_id")))
    return met.withColumn("__rank", last).where("__rank = 1").drop("__rank", "__tid", "__ts", "__seq", "source_id")


def direct(samples: DataFrame, stacks: DataFrame, pointer_size: int = 8) -> DataFrame:
    """``(sample_id, is_kernel, stack_ts, ips)`` from ``stacks(seq, ts, event_ts, tid, ips)``.

    A stack is a kernel one if its outermost address is. The last stack of a sample and kind stays. Stacks of no sample and empty
    ones are left out.
    """
    found = _sampled(samples, stacks.where(F.size("ips") > 0)).withColumn("is_kernel", is_kernel_address(F.element_at("ips", -1), pointer_size))
    last = F.max_by(F.struct("ts", "ips"), "seq")
    return found.groupBy("sample_id", "is_kernel").agg(last.alias("s")).select("sample_id", "is_kernel", F.col("s.ts").alias("stack_ts"), F.col("s.ips").alias("ips"))


def keyed(samples: DataFrame, keys: DataFrame, bodies: DataFrame) -> DataFrame:
    """As :func:`direct`, for ``keys(seq, ts, event_ts, tid, key, is_kernel)`` whose addresses come later in
    ``bodies(seq, key, ips)``: the first body of the key after the reference is meant, as keys are used again."""
    wanted = _sampled(samples, keys).select("sample_id", "is_kernel", F.col("ts").alias("stack_ts"), "key", "seq")
    found = following(wanted, bodies, "key", "seq", "ips").where("ips is not null")
    last = F.max_by(F.struct("stack_ts", "ips"), "seq")
    return found.groupBy("sample_id", "is_kernel").agg(last.alias("s")).select("sample_id", "is_kernel", "s.stack_ts", "s.ips")


def attached(samples: DataFrame, *found: DataFrame) -> DataFrame:
    """``samples`` with ``user_ips`` and ``kernel_ips``, null where there is none, and the times ``user_ts`` and ``kernel_ts`` of their
    stacks; of several the latest."""
    if not found:
        none, never = F.lit(None).cast("array<bigint>"), F.lit(None).cast("long")
        return samples.withColumns({"user_ips": none, "kernel_ips": none, "user_ts": never, "kernel_ts": never})
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    slots = every.groupBy(F.col("sample_id").alias("__id")).agg(*[F.max_by(F.when(F.col("is_kernel") == kernel, F.col("ips")), F.when(F.col("is_kernel") == kernel, F.col("stack_ts"))).alias(name) for name, kernel in (("user_ips", False), ("kernel_ips", True))], *[F.max(F.when(F.col("is_kernel") == kernel, F.col("stack_ts"))).alias(name) for name, kernel in (("user_ts", False), ("kernel_ts", True))])
    return samples.join(slots, F.col("sample_id") == F.col("__id"), "left").drop("__id")


def of_source(timer: DataFrame, counted: DataFrame, source_id: int) -> DataFrame:
    """Samples of a source. Where counter samples of a thread use the timer's number 0, they hide its timer samples."""
    own = counted.where(F.col("source_id") == source_id)
    if source_id != 0:
        return own
    hidden = own.select(F.col("tid").alias("__tid")).distinct()
    return own.unionByName(timer.join(hidden, F.col("tid") == F.col("__tid"), "left_anti"))


def distinct_stacks(stacks: DataFrame) -> DataFrame:
    """``(ips, n, first_sample)`` of ``stacks(sample_id, ips)``: one row for equal addresses in equal order."""
    return stacks.groupBy("ips").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_sample"))


def addresses(samples: DataFrame) -> DataFrame:
    """``(sample_id, depth, ip, is_leaf)`` of attached samples, depth 1 outermost, kernel frames after user frames."""
    none = F.array().cast("array<bigint>")
    ips = F.concat(F.reverse(F.coalesce("user_ips", none)), F.reverse(F.coalesce("kernel_ips", none)))
    rows = samples.select("sample_id", ips.alias("ips"))
    rows = rows.select("sample_id", F.size("ips").alias("n"), F.posexplode("ips").alias("at", "ip"))
    return rows.select("sample_id", (F.col("at") + 1).cast("long").alias("depth"), "ip", (F.col("at") + 1 == F.col("n")).alias("is_leaf"))


def with_debug_info(images: DataFrame, infos: DataFrame) -> DataFrame:
    """``images(pid, ts, base, ...)`` with ``debug_file`` and ``signature`` of ``infos(seq, pid, ts, base, debug_file, signature)``: equal
    process, time and base; of several the latest."""
    last = infos.groupBy("pid", "ts", "base").agg(F.max_by(F.struct("debug_file", "signature"), "seq").alias("i"))
    last = last.select(F.col("pid").alias("__pid"), F.col("ts").alias("__ts"), F.col("base").alias("__base"), "i.debug_file", "i.signature")
    same = (F.col("pid") == F.col("__pid")) & (F.col("ts") == F.col("__ts")) & (F.col("base") == F.col("__base"))
    return images.join(last, same, "left").drop("__pid", "__ts", "__base")
