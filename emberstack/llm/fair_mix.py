"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source has a weight and a target: its share of the total budget by weight, stopped at ``cap`` times the
source's own size, the excess reshared among the others by weight until none is above its stop. The documents of
a source queue in a shuffled order, ``cap`` times over. A document's virtual finish time is the source's
cumulative size up to and including it, divided by the source's target. All queues are merged in the order of
that time and cut where the budget is spent.

Running sums are never taken over a whole source or the whole queue in one task: they are sums within a bucket of
the order plus the total of the buckets before it, and only bucket totals meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberstack.llm.scratch import saved

WORD = r"[^\x20\x09-\x0D]+"
SHUFFLE_BUCKETS = 4096  # by the first three hex digits of the shuffle key
TIME_BUCKETS = 4096  # of the virtual finish time up to 2.0; later times share buckets by their logarithm
CHUNK = 10_000  # of equal rows


def n_words(text: Column) -> Column:
    """Number of words of a text as LONG; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """``sizes(source, source_size)``, one row for a source, to ``(source, source_size, target)``.

    Weights repeat along the sources by code point, null last. A source is stopped when ``cap * size`` is at most its
    share of what the earlier stopped ones leave; in the order of ``cap * size / weight`` the stopped sources come first.
    A source without words has target 0. The table has a row for a source and meets in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    choices = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(choices, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    live = weighed.where("source_size > 0")
    stop = (F.col("source_size") * cap) / F.col("weight")
    order = Window.orderBy(stop, F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    full = live.withColumns(
        {
            "budget": F.sum("source_size").over(whole) * percent / F.lit(100.0),
            "all_weight": F.sum("weight").over(whole),
            "stopped": F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "past_weight": F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    level = (F.col("budget") - F.coalesce("stopped", F.lit(0))) / (F.col("all_weight") - F.coalesce("past_weight", F.lit(0)))
    full = full.withColumn("level", level).withColumn("free", stop > level)
    full = full.withColumn("level", F.min(F.when(F.col("free"), F.struct(stop, F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise((F.col("source_size") * cap).cast("double"))
    return full.select("source", "source_size", target.alias("target")).unionByName(weighed.where("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2, seed: str = "mix", key: Sequence[str] = ("doc_id",), keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(doc_id, source, size, source_size, target, taken, copies, *keep)``, one for each row of ``docs(doc_id, text, source)``.

    ``taken`` is ``size`` times the number of the document's ``cap`` places in the merged queue that end within the
    budget, ``copies`` that number. Documents are taken whole. Null or empty texts have size 0 and are taken 0 times;
    a null source is a source. Rows that repeat a doc_id are documents of their own; equal ones are interchangeable.
    The shuffled order is that of md5(seed, *key), so reruns agree. ``keep`` names columns of ``docs`` that tell rows apart
    or are wanted in the result. Other columns are ignored. An empty table gives an empty result.

    Rows equal in all that is kept of them are one row with a number until their places are dealt, so that a key which a third
    of all rows have is no group of a window.
    """
    also = [*key, *keep]
    own = list(dict.fromkeys(["doc_id", "source", *also]))
    # The texts are read once: what is kept of a document is a few columns.
    rows = saved(docs.select(*own, n_words(F.col("text")).alias("size")))
    targets = saved(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, cap))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    idle = rows.where("size = 0").join(t, F.col("source").eqNullSafe(F.col("t_source")))
    idle = idle.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"), *keep)

    live = rows.where("size > 0").groupBy(*own, "size").agg(F.count("*").alias("equal"))
    order = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key]))
    live = live.withColumn("order", order)
    # A bucket is a run of the shuffled order, so a source of any size is many buckets.
    live = live.withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int") % SHUFFLE_BUCKETS)
    sums = live.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("equal")).alias("bucket_size"))
    earlier = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.withColumn("before", earlier).join(t, F.col("source").eqNullSafe(F.col("t_source")))
    before = before.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before", "source_size", "target")
    shuffled = Window.partitionBy("source", "bucket").orderBy("order", *own, "size")
    within = F.coalesce(F.sum(F.col("size") * F.col("equal")).over(shuffled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = live.withColumn("within", within).join(before, (F.col("bucket") == F.col("b_bucket")) & F.col("source").eqNullSafe(F.col("b_source")))
    # One row for each of the equal ones, in two steps so that no array is long.
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("equal") - 1, F.lit(CHUNK)))))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("equal"), (F.col("chunk") + 1) * CHUNK))))
    placed = placed.select(*own, "size", "order", "source_size", "target", (F.col("before") + F.col("within") + F.col("nth") * F.col("size")).alias("cumulative"))

    queue = placed.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(cap)])))
    queue = queue.withColumn("finish", (F.col("cumulative") + F.col("turn") * F.col("source_size")) / F.col("target"))
    late = TIME_BUCKETS + F.floor(F.log2(F.col("finish") / 2) * (TIME_BUCKETS // 16))
    queue = queue.withColumn("slot", F.when(F.col("finish") > 2, late).otherwise(F.floor(F.col("finish") * (TIME_BUCKETS // 2))).cast("int"))
    spent = queue.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    spent = spent.select(F.col("slot").alias("s_slot"), F.coalesce(F.sum("slot_size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("slot_before"))
    budget = targets.agg((F.coalesce(F.sum("source_size"), F.lit(0)) * percent / F.lit(100.0)).alias("budget"))
    merged = F.sum("size").over(Window.partitionBy("slot").orderBy("finish", F.col("source").isNull(), "source", "order", "cumulative", "turn").rowsBetween(Window.unboundedPreceding, 0))
    queue = queue.withColumn("merged", merged).join(spent, F.col("slot") == F.col("s_slot")).join(F.broadcast(budget))  # one row
    took = F.col("slot_before") + F.col("merged") <= F.col("budget")
    out = queue.groupBy(*own, "size", "cumulative", "source_size", "target").agg(F.sum(took.cast("long")).alias("copies"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *keep).unionByName(idle)
