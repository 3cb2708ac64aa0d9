"""Names, files and lines of addresses by range joins; device paths by ordered prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberstack.functions.scalars import generic_symbol
from emberstack.operators.temporal import leveled, probed


def in_range(addresses: DataFrame, ranges: DataFrame, values: list[str], shift: int | None = None) -> DataFrame:
    """``addresses(module, rel, ...)`` with ``values`` of the range of its module, ``ranges(module, rel_begin, rel_end, *values)``, that
    holds ``rel``; of several the one that begins last, then the shorter. Ranges of any length are joined by the two buckets of
    their level that hold them, and only distinct addresses are looked up. (``shift`` is no longer of use.)"""
    cut = leveled(ranges.where("rel_end > rel_begin"), "rel_begin", F.col("rel_end") - F.col("rel_begin"))
    cut = cut.select(F.col("module").alias("r_module"), "level", "bucket", "rel_begin", "rel_end", F.struct(*values).alias("r_value"))
    asked = probed(addresses.select("module", "rel").distinct(), cut, "rel")
    held = (F.col("module") == F.col("r_module")) & (F.col("__level") == F.col("level")) & (F.col("__bucket") == F.col("bucket")) & (F.col("rel") >= F.col("rel_begin")) & (F.col("rel") < F.col("rel_end"))
    best = F.max_by("r_value", F.struct("rel_begin", -F.col("rel_end"), "r_value"))
    found = asked.join(cut, held).groupBy("module", "rel").agg(best.alias("v")).select(F.col("module").alias("r_module"), F.col("rel").alias("r_rel"), *[F.col(f"v.{c}").alias(c) for c in values])
    return addresses.join(found, (F.col("module") == F.col("r_module")) & (F.col("rel") == F.col("r_rel")), "left").drop("r_module", "r_rel")


def resolved(addresses: DataFrame, functions: DataFrame, lines: DataFrame) -> DataFrame:
    """``addresses(module, rel, ip, ...)`` with ``symbol``, ``file``, ``func_line`` and ``instr_line``.

    ``functions(module, rel_begin, rel_end, symbol, file, func_line)``, ``lines(module, rel_begin, rel_end, instr_line)``. An address
    outside every function has a generic name and no file.
    """
    named = in_range(in_range(addresses, functions, ["symbol", "file", "func_line"]), lines, ["instr_line"])
    return named.withColumn("symbol", F.coalesce("symbol", generic_symbol(F.col("module"), F.col("ip"))))


def volumes(partitions: DataFrame) -> DataFrame:
    """``partitions(disk, partition, drive)`` with ``volume``, the number of a partition counted over all disks in order. The table
    describes one machine, so one task orders it."""
    count = partitions.groupBy("disk").agg(F.max("partition").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("disk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = count.select(F.col("disk").alias("__disk"), before.alias("__before"))
    return partitions.join(first, F.col("disk") == F.col("__disk")).select("disk", "partition", "drive", (F.col("__before") + F.col("partition")).alias("volume"))


def local_path(path: Column, devices: dict[str, str], system_root: str | None = None) -> Column:
    r"""``path`` with its device replaced by a drive: the longest of ``devices`` that ends at a separator, then ``\SystemRoot``."""
    rules = sorted(devices.items(), key=lambda x: (-len(x[0]), x[0])) + ([("\\SystemRoot", system_root.rstrip("\\"))] if system_root else [])
    out = path
    for device, drive in reversed(rules):
        device = device.rstrip("\\")
        rest = F.substring(path, len(device) + 1, 1 << 30)
        out = F.when(path.startswith(device + "\\") | (path == device), F.concat(F.lit(drive), rest)).otherwise(out)
    return out


def source_names(ids: DataFrame, described: DataFrame) -> DataFrame:
    """``ids(event_id)`` with ``name`` from ``described(place, name, ids)``: the descriptor holding the id; a null id has the first
    descriptor's name; else ``unknown event N``, N the id."""
    each = described.select("name", "place", F.explode("ids").alias("__id")).groupBy("__id").agg(F.min_by("name", "place").alias("name"))
    first = described.agg(F.min_by("name", "place").alias("__first"))
    out = ids.join(each, F.col("event_id") == F.col("__id"), "left").join(F.broadcast(first))  # one row
    unknown = F.concat(F.lit("unknown event "), F.col("event_id").cast("string"))
    return out.select(*ids.columns, F.coalesce("name", F.when(F.col("event_id").isNull(), F.col("__first")), unknown).alias("name"))


def build_ids(modules: DataFrame, by_file: DataFrame) -> DataFrame:
    """``modules(filename, build_id, ...)`` with a missing build id filled from ``by_file(filename, build_id)``, the least of a name."""
    known = by_file.groupBy(F.col("filename").alias("__file")).agg(F.min("build_id").alias("__id"))
    return modules.join(known, F.col("filename") == F.col("__file"), "left").withColumn("build_id", F.coalesce("build_id", "__id")).drop("__file", "__id")
