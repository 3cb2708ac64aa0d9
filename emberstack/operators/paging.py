"""Top-k, pages and the rest rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, by: list[str], size: int, index: int, descending: bool = False) -> DataFrame:
    """Page ``index`` of ``size`` rows in the order of ``by``; descending turns every key, names too. A top-k, not a sort of all."""
    order = [F.desc(c) if descending else F.asc(c) for c in by]
    return rows.orderBy(*order).offset(index * size).limit(size)


def top_with_others(rows: DataFrame, group: list[str], label: str, value: str, most: int) -> DataFrame:
    """For each group the ``most - 1`` rows of largest value (all, if there are at most ``most``) and "[others]" with the sum."""
    most = max(1, most)
    w = Window.partitionBy(*group)
    ranked = rows.withColumns({"__rn": F.row_number().over(w.orderBy(F.desc(value), label)), "__n": F.count("*").over(w)})
    shown = F.when((F.col("__n") <= most) | (F.col("__rn") < most), F.col(label)).otherwise("[others]")
    return ranked.groupBy(*group, shown.alias(label)).agg(F.sum(value).alias(value))


def _of_source(value: str, source: int):
    return F.sum(F.when(F.col("source_id") == source, F.col(value)).otherwise(0)).alias(value)


def page_by_source(hits: DataFrame, key: list[str], by: list[str], size: int, index: int, source: int, descending: bool = False) -> DataFrame:
    """``page`` over all keys of ``hits(*key, source_id, total, self)``, ordered by the hits of ``source``: those of every source."""
    ordered = hits.groupBy(*key).agg(_of_source("total", source), _of_source("self", source))
    return hits.join(F.broadcast(page(ordered, by, size, index, descending).select(*key)), key)  # at most a page


def top_with_others_by_source(rows: DataFrame, group: list[str], label: str, value: str, most: int, source: int) -> DataFrame:
    """``top_with_others`` over the rows of every source, ranked by the value of ``source``; sums by source."""
    most = max(1, most)
    w = Window.partitionBy(*group)
    ranked = rows.groupBy(*group, label).agg(_of_source(value, source)).withColumns({"__rn": F.row_number().over(w.orderBy(F.desc(value), label)), "__n": F.count("*").over(w)})
    shown = F.when((F.col("__n") <= most) | (F.col("__rn") < most), F.col(label)).otherwise("[others]")
    ranked = ranked.select(*group, label, shown.alias("__shown"))
    return rows.join(ranked, [*group, label]).groupBy(*group, F.col("__shown").alias(label), "source_id").agg(F.sum(value).alias(value))


def neighbours(edges: DataFrame, own: DataFrame, module: str, symbol: str, source: int, most: int) -> DataFrame:
    """Callers and callees of a function: see :meth:`emberstack.recording.Recording.callers_and_callees`.

    ``edges(source_id, caller, callee, total)`` of function structs, ``own(source_id, module, symbol, total, self)``. Kept are the
    ``most - 1`` of the largest edge total of ``source`` (all, if there are at most ``most``), ties to the lesser name.
    """
    most = max(1, most)
    is_it = lambda c: (F.col(f"{c}.module") == module) & (F.col(f"{c}.symbol") == symbol)
    near = edges.where(is_it("callee")).select(F.lit("caller").alias("side"), F.col("caller").alias("other"), "source_id", "total")
    near = near.unionByName(edges.where(is_it("caller")).select(F.lit("callee").alias("side"), F.col("callee").alias("other"), "source_id", "total"))
    every = near.groupBy("side", "other").agg(F.sum(F.when(F.col("source_id") == source, F.col("total")).otherwise(0)).alias("edge_total"))
    w = Window.partitionBy("side")
    every = every.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("edge_total"), "other")), "n": F.count("*").over(w)})
    kept = (F.col("n") <= most) | (F.col("rank") < most)
    named = every.select("side", "other", "edge_total", kept.alias("kept"))
    functions = own.select(F.struct("module", "symbol").alias("f"), F.col("source_id").alias("f_source"), F.col("total").alias("f_total"), "self")
    mine = named.where("other is not null").join(functions, F.col("other") == F.col("f")).select("side", "other", "edge_total", "kept", F.col("f_source").alias("source_id"), F.col("f_total").alias("total"), "self")
    root = named.where("other is null").join(near.where("other is null").select(F.col("side").alias("r_side"), "source_id", "total"), F.col("side") == F.col("r_side"))
    mine = mine.unionByName(root.select("side", "other", "edge_total", "kept", "source_id", "total", F.lit(0).cast("long").alias("self")))
    shown = F.when(~F.col("kept"), F.struct(F.lit(None).cast("string").alias("module"), F.lit("[others]").alias("symbol"))).otherwise(F.coalesce("other", F.struct(F.lit(None).cast("string").alias("module"), F.lit("[root]").alias("symbol"))))
    sums = named.select("side", shown.alias("f"), "edge_total").groupBy("side", "f").agg(F.sum("edge_total").alias("edge_total"))
    hits = mine.select(F.col("side").alias("h_side"), shown.alias("h_f"), "source_id", "total", "self").groupBy("h_side", "h_f", "source_id").agg(F.sum("total").alias("total"), F.sum("self").alias("self"))
    return sums.join(hits, (F.col("side") == F.col("h_side")) & F.col("f").eqNullSafe(F.col("h_f"))).select("side", "f.module", "f.symbol", "edge_total", "source_id", "total", "self")
