"""Tables that cut lineage: written once in the folder the whole cluster shares, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local master (tests) gets one of this session's own;
    on a cluster no machine's folder will do, so it is an error."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that every executor can reach")
        found = tempfile.mkdtemp(prefix="emberstack-")
        spark.conf.set(SETTING, found)
    return found


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def saved_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As :func:`saved`, with the number of rows, counted while they are written."""
    seen = Observation()
    table = saved(df.observe(seen, F.count("*").alias("n")))
    return table, seen.get["n"]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`saved` that no plan will read again."""
    for table in tables:
        remove(table.sparkSession, table._scratch_path)
