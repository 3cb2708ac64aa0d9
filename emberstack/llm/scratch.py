"""Tables that cut lineage, and names for the rows of stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.tables import discard, new_folder, remove, saved

__all__ = ["discard", "new_folder", "remove", "saved", "with_row_names"]


def with_row_names(df: DataFrame) -> DataFrame:
    """``df`` with LONG columns ``__file`` and ``__row`` that name each of its rows, the same whenever a plan over it runs again: the
    place of the row in its Parquet file. What is no plain scan of files is saved first."""
    try:
        named = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        df = saved(df)
        named = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    return named.select(*[F.col(f"`{c}`") for c in df.columns], F.xxhash64("__path").alias("__file"), "__row")
