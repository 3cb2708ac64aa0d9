"""Histories, as-of lookups, intervals and module maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType, TimestampType

from emberstack.functions.scalars import unsigned, wrapping_difference, wrapping_sum
from emberstack.operators.graph import reachable
from emberstack.tables import saved


def neighbour(rows: DataFrame, key: str, order: list[str], value: Column, name: str, ahead: bool = False, slices: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that isn't null of the rows before each in its key's ``order``, or the first of those
    after it if ``ahead``.

    Time, the first of ``order`` (of a struct its first field), is cut into slices, so a key of very many rows is as many groups;
    what a slice's rows don't find in it comes from a table of a row for each key, with at most a value for each slice. A time that
    is no number is not cut.
    """
    kind = rows.schema[order[0]].dataType
    time = F.col(order[0])[kind.fieldNames()[0]] if isinstance(kind, StructType) else F.col(order[0])
    first = kind.fields[0].dataType if isinstance(kind, StructType) else kind
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = isinstance(first, (NumericType, TimestampType))
    held = rows.withColumns({"__value": value, "__t": time if cut else F.lit(0)})
    held = with_slice(held, time_bounds(rows.select(time.cast("double").alias("t")), n), n, "__t", "__slice") if cut else held.withColumn("__slice", F.lit(0))
    way = F.desc if ahead else F.asc
    here = F.last("__value", ignorenulls=True).over(Window.partitionBy(key, "__slice").orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1))
    found = held.withColumn("__here", here)
    if not cut:
        return found.withColumn(name, F.col("__here")).drop("__value", "__t", "__slice", "__here")
    edge = (F.min_by if ahead else F.max_by)("__value", F.struct(*order))
    ends = held.where("__value is not null").groupBy(F.col(key).alias("__key"), F.col("__slice").alias("of")).agg(edge.alias("value"))
    ends = ends.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("of", "value"))).alias("__ends"))
    found = found.join(ends, F.col(key).eqNullSafe(F.col("__key")), "left")
    others = F.filter("__ends", lambda x: (x["of"] > F.col("__slice")) if ahead else (x["of"] < F.col("__slice")))
    far = F.get(others, F.lit(0) if ahead else F.size(others) - 1)["value"]
    return found.select(*[F.col(c) for c in rows.columns], F.coalesce("__here", far).alias(name))


def history(events: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """Keeps the events whose payload differs from the one before of the same key."""
    before = F.col("__before.was")
    found = neighbour(events, key, order, F.struct(F.col(payload).alias("was")), "__before")
    return found.where(before.isNull() | (before != F.col(payload))).drop("__before")


def close_intervals(entries: DataFrame, key: str, start: str, end: str, tie: Sequence[str] = ()) -> DataFrame:
    """An entry without an end gets the next entry's start; those that start together are in the order of ``tie``."""
    found = neighbour(entries, key, [start, *tie], F.struct(F.col(start).alias("next")), "__next", ahead=True)
    return found.withColumn(end, F.coalesce(F.col(end), F.col("__next.next"))).drop("__next")


def merged_order(events: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``events`` with their place, from 1, among those of their key in the order of time: what a merge of logs in order gives,
    without sorting all keys together."""
    return events.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of ``order``, as no single task sorts them: ranges of the order are sorted each by
    itself and written once, and a number is a row's place in its range after the sizes of the ranges before, which are a table
    of a row for each range. Equal rows are numbered in any order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The high bits are the number of the partition, the low 33 a row's place in it.
    held = saved(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    found = held.join(F.broadcast(before), part == F.col("__part"))  # a row for each partition
    return found.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(name))


def dense_ids(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """``(*key, name)``: a number from 0 for each distinct key, in the order in which keys first appear. Keys are aggregated before
    they are numbered, and numbered by all tasks."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first"))
    return numbered(first, ["__first", *key], name).select(*key, name)


def time_bounds(times: DataFrame, n: int) -> DataFrame:
    """One row of ``__bounds``: quantiles of ``times(t)`` that cut them into ``n`` slices of about as many rows each."""
    return times.select(F.col("t").cast("double").alias("t")).agg(F.percentile_approx("t", [i / n for i in range(1, n)], 50 * n).alias("__bounds"))


def with_slice(rows: DataFrame, bounds: DataFrame, n: int, time: str, name: str) -> DataFrame:
    """``rows`` with the number of the slice that their ``time`` lies in, of the ``n`` between ``bounds``; equal times are of one slice, null
    is of the first. The bounds are one row of ``n - 1`` numbers; a time is looked up by halving them."""

    def place(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN CAST(`{time}` AS DOUBLE) < __bounds[{middle}] THEN {place(low, middle)} ELSE {place(middle + 1, high)} END"

    if n < 2:
        return rows.withColumn(name, F.lit(0))
    found = F.expr(f"CASE WHEN `{time}` IS NULL THEN 0 ELSE {place(0, n - 1)} END")
    return rows.join(F.broadcast(bounds)).withColumn(name, found).drop("__bounds")


def asof(probes: DataFrame, entries: DataFrame, key: str, ts: str, start: str, payload: str, tie: list[str], strict: bool, name: str, slices: int | None = None) -> DataFrame:
    """``probes`` with the payload of the latest entry of their key that starts at or before ``ts``; without one null, or the
    first entry if not ``strict``. An entry of null payload is none.

    Time is cut into ``slices`` (as many as shuffle partitions) at quantiles of probes and entries together, so a key of very
    many rows is as many groups, whatever its entries' times. Both sides are sorted together by key, slice and time; a probe
    whose slice has no entry before it takes the last one of the key's slices before, from a table of a row for each key, which
    holds at most an entry for each slice. Nothing is multiplied.
    """
    n = slices or int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = saved(entries.select(F.col(key), F.lit(0).alias("__probe"), F.col(start).alias("__t"), F.col(payload).alias("__payload"), *[F.col(c).alias(f"__tie_{c}") for c in tie]))  # read three times
    bounds = time_bounds(probes.select(F.col(ts).cast("double").alias("t")).unionByName(e.select(F.col("__t").cast("double").alias("t"))), n)
    p = probes.withColumns({"__probe": F.lit(1), "__t": F.col(ts), "__payload": F.lit(None).cast(entries.schema[payload].dataType), **{f"__tie_{c}": F.lit(None).cast(entries.schema[c].dataType) for c in tie}})
    order = Window.partitionBy(key, "__slice").orderBy("__t", "__probe", *[f"__tie_{c}" for c in tie])
    here = F.last("__payload", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = with_slice(p.unionByName(e, allowMissingColumns=True), bounds, n, "__t", "__slice")
    found = both.withColumn("__here", here).where("__probe = 1")
    by = F.struct("__t", *[f"__tie_{c}" for c in tie])
    ends = with_slice(e.where("__payload is not null"), bounds, n, "__t", "of").groupBy(F.col(key).alias("__key"), "of").agg(F.max_by("__payload", by).alias("last"), F.min_by("__payload", by).alias("first"))
    ends = ends.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("of", "last", "first"))).alias("__ends"))
    found = found.join(ends, F.col(key) == F.col("__key"), "left")
    before = F.filter("__ends", lambda x: x["of"] < F.col("__slice"))
    value = F.coalesce("__here", F.get(before, F.size(before) - 1)["last"])
    if not strict:
        value = F.coalesce(value, F.get("__ends", F.lit(0))["first"])
    return found.select(*[F.col(c) for c in probes.columns if c != name], value.alias(name))


def overlapping(left: DataFrame, right: DataFrame, key: str, a: str, b: str, c: str, d: str) -> DataFrame:
    """Rows of both with an equal key whose closed intervals [a, b] and [c, d] meet; null ends are open."""
    r = right.withColumnRenamed(key, "__key")
    top = F.lit(2**63 - 1)
    return left.join(r, (F.col(key) == F.col("__key")) & (F.col(a) <= F.coalesce(F.col(d), top)) & (F.col(c) <= F.coalesce(F.col(b), top))).drop("__key")


def level_of(size: Column) -> Column:
    """The level of a range of unsigned ``size``: a multiple of 4, so that the range lies in at most two of the level's buckets of
    2**level (in at most 17 of the highest level's)."""
    return F.least(F.lit(60), F.greatest(F.lit(8), 4 * F.length(F.hex(wrapping_sum(size, F.lit(-1).cast("long"))))))


def leveled(ranges: DataFrame, begin: str, size: Column) -> DataFrame:
    """``ranges`` with ``level`` and, a row for each, the ``bucket`` of that level that it touches. Sizes are unsigned; empty ranges go."""
    level, first = F.col("level"), F.col(begin)
    cut = ranges.withColumn("__size", size).where("__size <> 0").withColumn("level", level_of(F.col("__size")))
    shift = lambda x: F.call_function("shiftrightunsigned", x, level)
    low, high = shift(first), shift(wrapping_sum(wrapping_sum(first, F.col("__size")), F.lit(-1).cast("long")))
    # A range may go on past the highest address, as one of signed addresses does at 0.
    number = lambda x: F.lit(x).cast("long")
    wide = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.concat(F.sequence(low, number(15)), F.sequence(number(0), high)))
    touched = F.when(level < 60, F.array_distinct(F.array(low, high))).otherwise(wide)
    return cut.withColumn("bucket", F.explode(touched)).drop("__size")


def probed(addresses: DataFrame, ranges: DataFrame, address: str) -> DataFrame:
    """``addresses`` once for each level that ``ranges(level)`` has, at most 14, with the ``bucket`` of that level they lie in."""
    levels = ranges.agg(F.collect_set("level").alias("__levels"))  # one row
    some = F.when(F.size("__levels") > 0, F.col("__levels")).otherwise(F.array(F.lit(8)))
    each = addresses.join(F.broadcast(levels)).withColumn("__level", F.explode(some)).drop("__levels")
    return each.withColumn("__bucket", F.call_function("shiftrightunsigned", F.col(address), F.col("__level")))


def module_at(addresses: DataFrame, modules: DataFrame, key: list[str], shift: int | None = None) -> DataFrame:
    """For each of ``addresses(*key, ip, t)`` the module of ``modules(module_id, base, size, load_ts)`` that holds it, the newest
    loaded at or before t; unsigned addresses and sizes. Those of ``key`` that modules have too must be equal. Mappings of any
    size are joined by the two buckets of their level that hold them. (``shift`` is no longer of use.)"""
    same = [c for c in key if c in modules.columns]
    spans = leveled(modules, "base", F.col("size"))
    spans = spans.select(*[F.col(c).alias(f"m_{c}") for c in same], "module_id", "base", "size", "load_ts", "level", "bucket")
    held = (F.col("__level") == F.col("level")) & (F.col("__bucket") == F.col("bucket")) & (F.col("load_ts") <= F.col("t"))
    for c in same:
        held = (F.col(c) == F.col(f"m_{c}")) & held
    # Of the difference to the base, as unsigned number: wraps as the address does.
    held = held & (unsigned(wrapping_difference(F.col("ip"), F.col("base"))) < unsigned(F.col("size")))
    # An address that no mapping holds is met by none at any level, and stays with null.
    met = probed(addresses.select(*key, "ip", "t").distinct(), spans, "ip").join(spans, held, "left")
    return met.groupBy(*key, "ip", "t").agg(F.max_by("module_id", F.struct("load_ts", "module_id")).alias("module_id"))


def following(keys: DataFrame, bodies: DataFrame, key: str, seq: str, body: str) -> DataFrame:
    """For each of ``keys(key, seq, ...)`` the first body of its key with a greater sequence number, else null."""
    b = bodies.select(F.col(key), F.col(seq), F.col(body).alias("__body"))
    both = keys.withColumn("__is", F.lit(1)).unionByName(b.withColumn("__is", F.lit(0)), allowMissingColumns=True)
    return neighbour(both, key, [seq, "__is"], F.col("__body"), body, ahead=True).where("__is = 1").select(*keys.columns, body)


def descendants(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """``processes(pid, ppid)`` reachable from ``roots(pid)``, the roots too; cycles end, and no depth is too deep."""
    return reachable(processes.select(F.col("pid").alias("child"), F.col("ppid").alias("parent")), roots.select(F.col("pid").alias("node"))).select(F.col("node").alias("pid"))
