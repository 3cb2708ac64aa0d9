"""The star-schema tables seen as a recording: orders are samples, their lines are stack frames.

sample: order (thread: customer, process: the customer's nation, source: rank of the priority); frame: line item by a total
order; module and symbol: the part's type and brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberstack.functions.scalars import unix_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, column: str):
    return unix_micros(F.col(column), df.schema[column].dataType.simpleString())


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, ts, thread_id, process_id, source_id)``; sources are ranked over the distinct priorities, not over rows."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sources = orders.select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("p"), (F.row_number().over(Window.orderBy("o_orderpriority")) - 1).cast("long").alias("source_id"))
    out = orders.join(sources, F.col("o_orderpriority") == F.col("p"))  # a row for each priority, which Spark broadcasts by its size
    out = out.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select(F.col("o_orderkey").alias("sample_id"), micros(orders, "o_orderdate").alias("ts"), F.col("o_custkey").alias("thread_id"), F.col("c_nationkey").cast("long").alias("process_id"), "source_id")


def lines(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """``(l_orderkey, l_partkey, l_linenumber, depth, is_leaf)`` of the line items of the samples ``of`` (all by default). Lines of an order
    that tie in number and part are equal frames, so whatever orders them further changes none, and is not shuffled."""
    line = table(spark, sf_dir, "lineitem")
    if of is not None:  # only their lines are sorted
        line = line.join(of.select(F.col("sample_id").alias("of")), F.col("l_orderkey") == F.col("of"), "left_semi")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return line.select("l_orderkey", "l_partkey", "l_linenumber").withColumns({"depth": F.row_number().over(order).cast("long"), "is_leaf": F.lead(F.lit(1)).over(order).isNull()})


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, module, symbol, file, func_line)``"""
    file = F.when(F.col("p_size") % 5 != 0, F.concat("p_type", F.lit("/"), "p_brand", F.lit(".cpp")))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("module"), F.col("p_brand").alias("symbol"), file.alias("file"), F.col("p_size").cast("long").alias("func_line"))


def frames(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Frames of the samples ``of`` (all by default) with their source, time, thread and process. Every line has a part, so the
    last line of an order is its leaf."""
    own = lines(spark, sf_dir, of).join(of if of is not None else samples(spark, sf_dir), F.col("l_orderkey") == F.col("sample_id"))
    placed = own.join(parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    instr_line = F.col("l_linenumber").cast("long").alias("instr_line")
    return placed.select("depth", "module", "symbol", "file", "func_line", instr_line, "sample_id", "ts", "thread_id", "process_id", "source_id", "is_leaf")
