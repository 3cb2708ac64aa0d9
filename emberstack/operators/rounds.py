"""Order and counts of records that a recorder wrote in rounds.

A recorder empties one buffer after another, so records are in order within a buffer but not in the file. When all buffers have been
emptied it writes a mark, and promises that no later record is older than the newest of the round before the mark's. So records
may be given out in order round by round, without a sort of the whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberstack.operators import temporal


def in_rounds(records: DataFrame, marks: DataFrame) -> DataFrame:
    """``records(path, seq, ...)`` with ``round``, the number of ``marks(path, seq)`` of their file before them. A mark given twice counts
    once. No other column of marks is used."""
    of = marks.select("path", F.col("seq").alias("__mark")).distinct()
    of = temporal.numbered(of, ["path", "__mark"], "__n")
    first = of.groupBy(F.col("path").alias("__path")).agg(F.min("__n").alias("__first"))
    of = of.join(first, F.col("path") == F.col("__path")).select("path", "__mark", (F.col("__n") - F.col("__first") + 1).alias("__round"))
    found = temporal.asof(records, of, "path", "seq", "__mark", "__round", [], True, "round")
    return found.withColumn("round", F.coalesce("round", F.lit(0).cast("long")))


def ordered(records: DataFrame, marks: DataFrame) -> DataFrame:
    """``records(path, seq, ts, ...)`` in the order in which their rounds let them go, with ``round``, ``slot``, the mark that lets a record go,
    and ``late``.

    Mark r lets go what is no newer than the newest record of the rounds before r; so a record goes with its own round or the next
    one. Where the recorder keeps its promise the order is that of time. A late record breaks it: a newer one has gone with an
    earlier mark. It still goes with its own round. Records of no time go at the beginning of their round. Ties go by place in
    the file.
    """
    placed = in_rounds(records, marks)
    newest = placed.groupBy(F.col("path").alias("__path"), F.col("round").alias("__round")).agg(F.max("ts").alias("__newest"))
    # A row for each round that has records: what is windowed is small beside the records.
    before = Window.partitionBy("__path").orderBy("__round")
    until = F.max("__newest").over(before.rowsBetween(Window.unboundedPreceding, -1))
    # What has gone before this round: nothing newer than the newest of all rounds but the one just before it.
    gone = F.max("__newest").over(before.rangeBetween(Window.unboundedPreceding, -2))
    bounds = newest.select("__path", "__round", until.alias("__until"), gone.alias("__gone"))
    out = placed.join(bounds, (F.col("path") == F.col("__path")) & (F.col("round") == F.col("__round")))
    own = F.col("ts").isNull() | (F.col("ts") <= F.col("__until"))
    slot = F.when(F.coalesce(own, F.lit(False)), F.col("round")).otherwise(F.col("round") + 1)
    late = F.coalesce(F.col("ts") < F.col("__gone"), F.lit(False))
    out = out.select(*placed.columns, slot.alias("slot"), late.alias("late"))
    return out.orderBy("path", "slot", F.col("ts").asc_nulls_first(), "seq")


def places(given: DataFrame) -> DataFrame:
    """What :func:`ordered` gives with ``place``, a record's number from 1 in its file's order; no task holds a file."""
    rows = temporal.numbered(given.withColumn("__timed", F.col("ts").isNotNull()), ["path", "slot", "__timed", "ts", "seq"], "__n")
    first = rows.groupBy(F.col("path").alias("__path")).agg(F.min("__n").alias("__first"))
    return rows.join(first, F.col("path") == F.col("__path")).select(*given.columns, (F.col("__n") - F.col("__first") + 1).alias("place"))


def counts(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """``(path, round, event_id, n, first_ts, last_ts)``: samples of each event between two marks. With every record that is no sample
    as marks these are the runs of samples that nothing interrupts."""
    rows = in_rounds(samples.select("path", "seq", "event_id", "ts"), marks)
    return rows.groupBy("path", "round", "event_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
