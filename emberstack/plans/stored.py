"""Queries over what is kept beside a recording: the dictionary of stacks, hits by slices of time, functions in several orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.operators import calltree, dictionary, filters, hits
from emberstack.plans import profile as p
from emberstack.plans.queries import FROM, HITS, SQL, TO, WITH, query
from emberstack.recording import SORTS
from emberstack.tables import saved

NAMES = ("module", "symbol", "file", "func_line")
FRAME = ("depth", *NAMES, "instr_line", "is_leaf")


def _shared(spark, d) -> tuple[DataFrame, DataFrame]:
    """Samples with their stack's number, and the frames of each distinct stack. Stacks are of the numbers of parts' names, so no name
    is shuffled with lines; each is put together once."""
    parts, names = dictionary.interned(p.parts(spark, d).select("p_partkey", F.struct(*NAMES).alias("names")), ["names"], "code")
    lines = p.lines(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    frame = F.struct("depth", "code", F.col("l_linenumber").cast("long").alias("instr_line"), "is_leaf")
    stack = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(frame)).alias("stack"))
    samples, distinct = dictionary.interned(saved(p.samples(spark, d).join(stack, F.col("sample_id") == F.col("l_orderkey"), "left").drop("l_orderkey")), ["stack"])
    frames = distinct.select("stack_id", F.explode("stack").alias("f")).select("stack_id", "f.*")
    frames = frames.join(names.select(F.col("code").alias("of"), "names.*"), F.col("code") == F.col("of"))
    return saved(samples), saved(frames.select("stack_id", *FRAME))


@query(SQL["function_hits"])
def dictionary_function_hits(spark, d):
    samples, frames = _shared(spark, d)
    return dictionary.function_hits(frames, dictionary.weights(samples))


@query(SQL["call_tree_nodes_all_sources"])
def dictionary_call_tree(spark, d):
    samples, frames = _shared(spark, d)
    return calltree.nodes(frames, ("source_id",), dictionary.weights(samples)).select("path", "parent", "depth", "source_id", "total", "self")


@query(f"""{WITH}, e AS (SELECT source_id, lag(module) OVER w AS caller_module, lag(symbol) OVER w AS caller_symbol, module, symbol FROM frames WINDOW w AS (PARTITION BY sample_id ORDER BY depth))
SELECT source_id, caller_module, caller_symbol, module, symbol, count(*) AS total FROM e GROUP BY ALL""")
def dictionary_edges(spark, d):
    samples, frames = _shared(spark, d)
    found = dictionary.edges(frames, dictionary.weights(samples))
    return found.select("source_id", F.col("caller.module").alias("caller_module"), F.col("caller.symbol").alias("caller_symbol"), "callee.module", "callee.symbol", "total")


@query(f"""{WITH}, s AS (SELECT sample_id, string_agg(concat_ws('|', depth, module, symbol, coalesce(file, '-'), func_line, instr_line), '>' ORDER BY depth) AS stack, count(*) AS depth FROM frames GROUP BY sample_id)
SELECT depth, count(DISTINCT stack) AS stacks, count(*) AS samples FROM s GROUP BY depth""")
def dictionary_sizes(spark, d):
    """Distinct stacks by depth, and the samples that name them."""
    samples, frames = _shared(spark, d)
    sizes = frames.groupBy(F.col("stack_id").alias("of")).agg(F.count("*").alias("depth"))
    own = samples.groupBy("stack_id").agg(F.count("*").alias("n")).join(sizes, F.col("stack_id") == F.col("of"))
    return own.groupBy("depth").agg(F.count("*").alias("stacks"), F.sum("n").alias("samples"))


WEEK = 7 * 24 * 3600 * 1_000_000


@query(f"{WITH} SELECT source_id, module, symbol, {HITS} FROM frames WHERE ts BETWEEN {FROM + 5} AND {TO} AND process_id NOT IN (1, 5) GROUP BY ALL")
def sliced_filter(spark, d):
    """A filter of time and processes from sums by week; only its two edge weeks read samples."""
    samples, frames = _shared(spark, d)
    return dictionary.SlicedHits(samples, frames, 13 * WEEK).function_hits(filters.SampleFilter(FROM + 5, TO, (1, 5)))


@query(SQL["functions_page_total_desc"])
def stored_functions_page(spark, d):
    """A page read by its places in a table kept in the order of total hits."""
    own = p.frames(spark, d, p.samples(spark, d).where("source_id = 0"))
    return dictionary.SortedPages(hits.function_hits(own).drop("source_id"), {"total": SORTS["total"]}).page("total", 10, 2, True)
