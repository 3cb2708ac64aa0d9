"""Queries over events taken as what a recorder wrote: seven files, a signup finishes a round, and an event's value says how late it is
written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.operators import rounds
from emberstack.plans import profile as p
from emberstack.plans.queries import WITH, query
from emberstack.plans.stored import FRAME
from emberstack.recording import Recording
from emberstack.tables import saved

WRITTEN = """WITH e AS (SELECT CAST(user_id % 7 AS VARCHAR) AS path, event_id AS seq, event_type, epoch_us(ts) - CAST(floor(value * 400) AS BIGINT) * 1000000 AS ts FROM events),
r AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS round FROM e),
s AS (SELECT path, seq, event_type, ts, CAST(round AS BIGINT) AS round FROM r WHERE event_type <> 'signup')"""


def _written(spark, d) -> tuple[DataFrame, DataFrame]:
    events = p.table(spark, d, "events")
    late = F.floor(F.col("value") * 400).cast("long") * 1_000_000
    rows = events.select((F.col("user_id") % 7).cast("string").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("event_id"), (p.micros(events, "ts") - late).alias("ts"))
    return rows.where("event_id <> 'signup'"), rows.where("event_id = 'signup'")


@query(f"""{WRITTEN}, n AS (SELECT path, round, max(ts) AS newest FROM s GROUP BY ALL),
b AS (SELECT path, round, max(newest) OVER (PARTITION BY path ORDER BY round RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until,
  max(newest) OVER (PARTITION BY path ORDER BY round RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS gone FROM n),
o AS (SELECT s.path, seq, ts, s.round, CASE WHEN ts <= until THEN s.round ELSE s.round + 1 END AS slot, coalesce(ts < gone, false) AS late FROM s JOIN b ON s.path = b.path AND s.round = b.round)
SELECT path, seq, round, slot, late, row_number() OVER (PARTITION BY path ORDER BY slot, ts, seq) AS place FROM o""")
def round_order(spark, d):
    """Records with the mark that lets them go and their place in the order given out."""
    given = rounds.ordered(*_written(spark, d))
    return rounds.places(given).select("path", "seq", "round", "slot", "late", "place")


@query(f"{WRITTEN} SELECT path, round, event_type AS event_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL")
def round_counts(spark, d):
    return rounds.counts(*_written(spark, d))


@query(f"""{WITH}, c AS (SELECT process_id, count(*) AS n, count(*) FILTER (WHERE source_id = 0) AS first_source FROM samples GROUP BY ALL),
t AS (SELECT process_id, count(DISTINCT thread_id) AS n_threads FROM samples GROUP BY ALL),
z AS (SELECT process_id, count(DISTINCT module) AS n_modules, count(DISTINCT (module, symbol)) AS n_functions, count(DISTINCT nullif(file, '')) AS n_files FROM frames GROUP BY ALL)
SELECT c.process_id, n, first_source, n_threads, coalesce(n_modules, 0) AS n_modules, coalesce(n_functions, 0) AS n_functions, coalesce(n_files, 0) AS n_files
FROM c JOIN t ON c.process_id = t.process_id LEFT JOIN z ON c.process_id = z.process_id""")
def process_report(spark, d):
    """Samples, threads, and how many different modules, functions and files each process met."""
    samples = saved(p.samples(spark, d))
    processes = samples.select("process_id").distinct().withColumn("name", F.lit(None).cast("string"))
    threads = samples.groupBy("process_id", "thread_id").agg(F.min("ts").alias("start_ts"))
    # A thread is a customer of one nation, so of one process.
    frames = p.frames(spark, d).select("sample_id", *FRAME)
    found = Recording(samples, frames, processes, threads).process_report()
    first = F.filter("samples", lambda x: x["source_id"] == 0)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return found.select("process_id", total.alias("n"), F.coalesce(F.get(first, F.lit(0))["n"], F.lit(0).cast("long")).alias("first_source"), F.size("threads").cast("long").alias("n_threads"), "n_modules", "n_functions", "n_files")
