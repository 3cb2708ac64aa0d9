"""Hardware-counter deltas and segments of a thread's life."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``delta``: the value less the one before of the key, or the value itself where it is the smaller; null for the first."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("delta", F.when(before.isNull(), None).when(before > F.col(value), F.col(value)).otherwise(F.col(value) - before))


def segments(rows: DataFrame, key: str, order: list[str], opens: str) -> DataFrame:
    """Adds ``segment``: how many rows of the key up to this one satisfy the condition ``opens``."""
    seen = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("segment", F.sum(F.expr(opens).cast("long")).over(seen))
