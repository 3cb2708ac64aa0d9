"""Profile queries over the star schema and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberstack.functions import scalars
from emberstack.operators import calltree, counters, filters, hits, lifetimes, paging, stacks, symbols, temporal
from emberstack.plans import profile as p
from emberstack.tables import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SAMPLES = """samples AS (
  SELECT o_orderkey AS sample_id, epoch_us(o_orderdate) AS ts, o_custkey AS thread_id, CAST(c_nationkey AS BIGINT) AS process_id,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS source_id
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
FRAMES = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS depth FROM lineitem),
frames AS (
  SELECT s.*, depth, p_type AS module, p_brand AS symbol, CASE WHEN p_size % 5 <> 0 THEN p_type || '/' || p_brand || '.cpp' END AS file,
    CAST(p_size AS BIGINT) AS func_line, CAST(l_linenumber AS BIGINT) AS instr_line,
    CASE WHEN depth = max(depth) OVER (PARTITION BY l_orderkey) THEN 1 ELSE 0 END AS is_leaf
  FROM numbered JOIN part ON l_partkey = p_partkey JOIN samples s ON l_orderkey = sample_id)"""
WITH = f"WITH RECURSIVE {SAMPLES},\n{FRAMES}"
HITS = "CAST(count(*) AS BIGINT) AS total, CAST(sum(is_leaf) AS BIGINT) AS self"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


@query(f"{WITH} SELECT source_id, module, symbol, {HITS} FROM frames GROUP BY ALL")
def function_hits(spark, d):
    return hits.function_hits(p.frames(spark, d))


@query(f"{WITH} SELECT source_id, module, {HITS} FROM frames GROUP BY ALL")
def module_hits(spark, d):
    return hits.module_hits(p.frames(spark, d))


@query(f"{WITH} SELECT source_id, file, {HITS} FROM frames WHERE file IS NOT NULL GROUP BY ALL")
def file_hits(spark, d):
    return hits.file_hits(p.frames(spark, d))


@query(f"{WITH} SELECT source_id, module, symbol, instr_line, {HITS} FROM frames WHERE file IS NOT NULL GROUP BY ALL")
def line_hits(spark, d):
    return hits.line_hits(p.frames(spark, d))


@query(f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY module, symbol ORDER BY source_id, ts, sample_id, depth) AS rn FROM frames WHERE file IS NOT NULL) SELECT module, symbol, file, func_line FROM r WHERE rn = 1")
def function_attribution(spark, d):
    return hits.function_attribution(p.frames(spark, d))


@query(f"{WITH} SELECT source_id, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN sample_id IN (SELECT l_orderkey FROM lineitem) THEN 0 ELSE 1 END) AS BIGINT) AS self FROM samples GROUP BY source_id")
def root_hits(spark, d):
    return hits.root_hits(p.samples(spark, d), p.frames(spark, d))


@query("SELECT event_type AS symbol, count(*) AS total, count(*) AS self FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def nostack_hits(spark, d):
    """Samples with a frame but no stack count in full for it, and for no edge or tree node."""
    lone = p.table(spark, d, "events").where("event_type is not null")
    return hits.lone_hits(lone.withColumnRenamed("event_type", "symbol"), ["symbol"])


EDGES = f"""{WITH}, edges AS (
  SELECT source_id, coalesce(lag(module || '!' || symbol) OVER (PARTITION BY sample_id ORDER BY depth), '[root]') AS caller, module || '!' || symbol AS callee FROM frames)"""


@query(f"{EDGES} SELECT source_id, caller, callee, count(*) AS total, CAST(0 AS BIGINT) AS self FROM edges GROUP BY source_id, caller, callee")
def caller_edges(spark, d):
    return hits.caller_edges(p.frames(spark, d))


@query(f"""{EDGES}, e AS (SELECT caller, callee, count(*) AS total FROM edges WHERE source_id = 0 GROUP BY caller, callee),
r AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY total DESC, callee) AS rn, count(*) OVER (PARTITION BY caller) AS n FROM e)
SELECT caller, CASE WHEN n <= 4 OR rn < 4 THEN callee ELSE '[others]' END AS callee, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY ALL""")
def callees_topk_others(spark, d):
    edges = hits.caller_edges(p.frames(spark, d, p.samples(spark, d).where("source_id = 0")))
    return paging.top_with_others(edges, ["caller"], "callee", "total", 4)


@query(f"""{EDGES}, e AS (SELECT caller, callee, count(*) AS total FROM edges WHERE source_id = 0 GROUP BY caller, callee),
r AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY total DESC, caller) AS rn, count(*) OVER (PARTITION BY callee) AS n FROM e)
SELECT callee, CASE WHEN n <= 4 OR rn < 4 THEN caller ELSE '[others]' END AS caller, CAST(sum(total) AS BIGINT) AS total FROM r GROUP BY ALL""")
def callers_topk_others(spark, d):
    edges = hits.caller_edges(p.frames(spark, d, p.samples(spark, d).where("source_id = 0")))
    return paging.top_with_others(edges, ["callee"], "caller", "total", 4)


def _others_all_sources(name: str, group: str, label: str) -> None:
    """Edges of every source; those of a group are ranked by their hits of source 0."""

    def run(spark, d):
        return paging.top_with_others_by_source(hits.caller_edges(p.frames(spark, d)), [group], label, "total", 4, 0)

    run.__name__ = f"{name}_topk_others_all_sources"
    query(f"""{EDGES}, e AS (SELECT caller, callee, source_id, count(*) AS total FROM edges GROUP BY caller, callee, source_id),
k AS (SELECT caller, callee, sum(CASE WHEN source_id = 0 THEN total ELSE 0 END) AS own FROM e GROUP BY caller, callee),
r AS (SELECT caller, callee, row_number() OVER (PARTITION BY {group} ORDER BY own DESC, {label}) AS rn, count(*) OVER (PARTITION BY {group}) AS n FROM k)
SELECT e.{group}, CASE WHEN n <= 4 OR rn < 4 THEN e.{label} ELSE '[others]' END AS {label}, source_id, CAST(sum(total) AS BIGINT) AS total
FROM e JOIN r ON e.caller = r.caller AND e.callee = r.callee GROUP BY ALL""")(run)


_others_all_sources("callees", "caller", "callee")
_others_all_sources("callers", "callee", "caller")


@query(f"""{WITH}, top AS (SELECT module, symbol FROM frames WHERE source_id = 0 GROUP BY module, symbol ORDER BY sum(is_leaf) DESC, count(*) DESC, module, symbol LIMIT 1)
SELECT source_id, instr_line, {HITS} FROM frames JOIN top USING (module, symbol) WHERE file IS NOT NULL GROUP BY source_id, instr_line""")
def hottest_function_lines(spark, d):
    """Line hits of the function with the most self hits of source 0."""
    frames = p.frames(spark, d)
    best = hits.function_hits(frames.where("source_id = 0")).orderBy(F.desc("self"), F.desc("total"), "module", "symbol").limit(1)
    return hits.line_hits(frames.join(F.broadcast(best.select("module", "symbol")), ["module", "symbol"])).select("source_id", "instr_line", "total", "self")  # one row


@query(f"""{WITH}, h AS (SELECT process_id, module, symbol, {HITS} FROM frames WHERE source_id = 0 GROUP BY ALL)
SELECT process_id, module, symbol, total, self, self * 100e0 / (SELECT count(*) FROM samples WHERE source_id = 0) AS self_percent,
  total * 100e0 / (SELECT count(*) FROM samples WHERE source_id = 0) AS total_percent
FROM h ORDER BY self DESC, total DESC, module, symbol, process_id LIMIT 20""")
def hottest_functions(spark, d):
    """The 20 functions of any process with the most self hits of source 0, as shares of all of its samples."""
    own = p.samples(spark, d).where("source_id = 0")
    return hits.hottest(p.frames(spark, d, own), own, 20)


def _pages(name: str, by: list[str], descending: bool) -> None:
    order = ", ".join(f"{c} DESC" if descending else c for c in by)

    def run(spark, d):
        own = p.frames(spark, d, p.samples(spark, d).where("source_id = 0"))
        return paging.page(hits.function_hits(own).drop("source_id"), by, 10, 2, descending)

    run.__name__ = f"functions_page_{name}_{'desc' if descending else 'asc'}"
    query(f"{WITH} SELECT module, symbol, {HITS} FROM frames WHERE source_id = 0 GROUP BY module, symbol ORDER BY {order} LIMIT 10 OFFSET 20")(run)


def _pages_all_sources(name: str, by: list[str], descending: bool) -> None:
    """Functions of every source; hits are ordered by those of source 0."""
    order = ", ".join(f"{c} DESC" if descending else c for c in by)

    def run(spark, d):
        return paging.page_by_source(hits.function_hits(p.frames(spark, d)), ["module", "symbol"], by, 10, 2, 0, descending)

    run.__name__ = f"functions_page_{name}_{'desc' if descending else 'asc'}_all_sources"
    query(f"""{WITH}, f AS (SELECT module, symbol, source_id, {HITS} FROM frames GROUP BY ALL),
o AS (SELECT module, symbol, sum(CASE WHEN source_id = 0 THEN total ELSE 0 END) AS total, sum(CASE WHEN source_id = 0 THEN self ELSE 0 END) AS self FROM f GROUP BY module, symbol ORDER BY {order} LIMIT 10 OFFSET 20)
SELECT f.module, f.symbol, f.source_id, f.total, f.self FROM f JOIN o ON f.module = o.module AND f.symbol = o.symbol""")(run)


for _name, _by in (("name", ["symbol", "module"]), ("total", ["total", "symbol", "module"]), ("self", ["self", "symbol", "module"])):
    for _down in (False, True):
        _pages(_name, _by, _down)
        _pages_all_sources(_name, _by, _down)

TREE = f"""{WITH}, paths AS (
  SELECT string_agg(module || '!' || symbol, '>') OVER (PARTITION BY sample_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path,
    coalesce(string_agg(module || '!' || symbol, '>') OVER (PARTITION BY sample_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent, depth, is_leaf
  FROM frames WHERE source_id = 0),
tree AS (SELECT path, parent, CAST(depth AS BIGINT) AS depth, {HITS} FROM paths GROUP BY path, parent, depth)"""


NODE = ["path", "parent", "depth", "total", "self"]


def _tree(spark, d) -> DataFrame:
    return calltree.nodes(p.frames(spark, d, p.samples(spark, d).where("source_id = 0")))


@query(f"{TREE} SELECT * FROM tree")
def call_tree_nodes(spark, d):
    return _tree(spark, d).select(*NODE)


@query(f"{TREE} SELECT * FROM tree WHERE parent = ''")
def call_tree_children(spark, d):
    return calltree.children(_tree(spark, d), calltree.ROOT).select(*NODE)


TREE_ALL = f"""{WITH}, paths AS (
  SELECT string_agg(module || '!' || symbol, '>') OVER (PARTITION BY sample_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path,
    coalesce(string_agg(module || '!' || symbol, '>') OVER (PARTITION BY sample_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent, depth, source_id, is_leaf
  FROM frames),
tree AS (SELECT path, parent, CAST(depth AS BIGINT) AS depth, source_id, {HITS} FROM paths GROUP BY path, parent, depth, source_id)"""


@query(f"{TREE_ALL} SELECT * FROM tree")
def call_tree_nodes_all_sources(spark, d):
    """The whole tree, a row for each node and source that hits it."""
    return calltree.nodes(p.frames(spark, d), ("source_id",)).select(*NODE, "source_id")


@query(f"{TREE_ALL} SELECT * FROM tree WHERE parent = ''")
def call_tree_children_all_sources(spark, d):
    return calltree.children(calltree.nodes(p.frames(spark, d), ("source_id",)), calltree.ROOT).select(*NODE, "source_id")


@query(f"""{TREE}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY total DESC, path) AS rn FROM tree) WHERE rn = 1),
root AS (SELECT CAST(0 AS BIGINT) AS self),
h AS (SELECT path, depth, total, t.self FROM top t, root r WHERE parent = '' AND total > r.self
  UNION ALL SELECT t.path, t.depth, t.total, t.self FROM h JOIN top t ON t.parent = h.path AND t.total > h.self)
SELECT path, depth, total, self FROM h""")
def hot_path(spark, d):
    """Of the samples that have frames, so the root has no hits of its own."""
    root = spark.range(1).select(F.lit(0).cast("long").alias("self"))
    return calltree.hot_path(saved(_tree(spark, d)), root)


@query(f"""{WITH} SELECT process_id, source_id, thread_id, count(*) AS n FROM samples GROUP BY process_id, source_id, thread_id
UNION ALL SELECT process_id, source_id, NULL, count(*) FROM samples GROUP BY process_id, source_id""")
def process_sample_info(spark, d):
    return hits.process_sample_info(p.samples(spark, d))


@query(f"{WITH} SELECT source_id, count(*) AS total FROM samples GROUP BY source_id")
def document_totals(spark, d):
    return hits.sample_totals(p.samples(spark, d))


@query(f"""{WITH} SELECT source_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
  CASE WHEN max(ts) > min(ts) THEN count(*) * 1000000e0 / (max(ts) - min(ts)) ELSE 0e0 END AS rate FROM samples GROUP BY source_id""")
def sample_source_stats(spark, d):
    return hits.source_statistics(p.samples(spark, d))


@query(f"{WITH} SELECT count(DISTINCT process_id) AS processes, count(DISTINCT thread_id) AS threads, count(*) AS samples, max(ts) - min(ts) AS runtime FROM samples")
def session_info(spark, d):
    return hits.session_totals(p.samples(spark, d))


FROM, TO = 725846400000000, 820454400000000  # 1993-01-01 and 1996-01-01 in microseconds


def _filtered(name: str, f: filters.SampleFilter, where: str) -> None:
    def run(spark, d):
        return hits.function_hits(p.frames(spark, d, filters.filtered(p.samples(spark, d), f)))

    run.__name__ = name
    query(f"{WITH} SELECT source_id, module, symbol, {HITS} FROM frames WHERE {where} GROUP BY ALL")(run)


_filtered("filter_time", filters.SampleFilter(FROM, TO), f"ts BETWEEN {FROM} AND {TO}")
_filtered("filter_time_empty", filters.SampleFilter(TO, FROM), "false")
_filtered("filter_exclude_process", filters.SampleFilter(excluded_processes=(1, 5)), "process_id NOT IN (1, 5)")
_filtered("filter_exclude_thread", filters.SampleFilter(excluded_threads=(7, 11, 13)), "thread_id NOT IN (7, 11, 13)")


@query("SELECT p_type AS module, count(*) AS n FROM part WHERE NOT regexp_full_match(p_type, '.*S.A.*') AND NOT regexp_full_match(p_type, 'PROMO.*') GROUP BY p_type")
def module_filter_excluded(spark, d):
    return p.table(spark, d, "part").where(filters.module_passes(F.col("p_type"), exclude=["**S?A*", "PROMO*"])).groupBy(F.col("p_type").alias("module")).agg(F.count("*").alias("n"))


@query("SELECT p_type AS module, count(*) AS n FROM part WHERE regexp_full_match(p_type, 'S.*') OR regexp_full_match(p_type, '.*M') GROUP BY p_type")
def module_filter_included(spark, d):
    return p.table(spark, d, "part").where(filters.module_passes(F.col("p_type"), include=["S*", "*M"])).groupBy(F.col("p_type").alias("module")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'first/' || substr(p_brand, 8) WHEN regexp_replace(p_brand, '#2(.)$', '-two-\\1') <> p_brand
  THEN regexp_replace(p_brand, '#2(.)$', '-two-\\1') WHEN starts_with(p_brand, 'Brand') THEN 'B' || substr(p_brand, 6) ELSE p_brand END AS path FROM part""")
def path_map(spark, d):
    rules = [("prefix", "Brand#1", "first/"), ("regex", "#2(.)$", "-two-$1"), ("prefix", "Brand", "B")]
    return p.table(spark, d, "part").select("p_partkey", filters.map_path(F.col("p_brand"), rules).alias("path"))


HISTORY = """WITH history AS (SELECT user_id, epoch_us(ts) AS start_ts, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type)"""


def _history(spark, d) -> DataFrame:
    e = p.table(spark, d, "events")
    e = e.select("user_id", p.micros(e, "ts").alias("start_ts"), "event_id", "event_type")
    return temporal.history(e, "user_id", ["start_ts", "event_id"], "event_type")


@query(f"{HISTORY} SELECT * FROM history")
def scd2_history(spark, d):
    return _history(spark, d)


@query(f"{HISTORY} SELECT user_id, event_id, start_ts, lead(start_ts) OVER (PARTITION BY user_id ORDER BY start_ts, event_id) AS end_ts FROM history")
def close_intervals(spark, d):
    open_ = _history(spark, d).withColumn("end_ts", F.lit(None).cast("long"))
    h = temporal.close_intervals(open_, "user_id", "start_ts", "end_ts", ["event_id"])
    return h.select("user_id", "event_id", "start_ts", "end_ts")


PROBES = "probes AS (SELECT event_id AS probe_id, user_id, epoch_us(ts) - 5000000 AS t FROM events)"


def _asof(name: str, strict: bool) -> None:
    first = "" if strict else ", (SELECT min_by(event_type, (h.start_ts, h.event_id)) FROM history h WHERE h.user_id = p.user_id)"

    def run(spark, d):
        e = p.table(spark, d, "events")
        probes = e.select(F.col("event_id").alias("probe_id"), "user_id", (p.micros(e, "ts") - 5000000).alias("t"))
        return temporal.asof(probes, _history(spark, d), "user_id", "t", "start_ts", "event_type", ["event_id"], strict, "found")

    run.__name__ = name
    query(f"""{HISTORY}, {PROBES}, h2 AS (SELECT user_id, start_ts, max_by(event_type, event_id) AS event_type FROM history GROUP BY user_id, start_ts)
SELECT p.probe_id, p.user_id, p.t, coalesce(a.event_type{first}) AS found FROM probes p ASOF LEFT JOIN h2 a ON p.user_id = a.user_id AND p.t >= a.start_ts""")(run)


_asof("asof_strict", True)
_asof("asof_nonstrict", False)


@query("""WITH i AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)) AS a, max(epoch_us(o_orderdate)) AS b FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey),
j AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)) AS c, max(epoch_us(o_orderdate)) AS d FROM orders WHERE o_orderpriority LIKE '2%' GROUP BY o_custkey)
SELECT i.k, a, b, c, d FROM i JOIN j ON i.k = j.k WHERE a <= d AND c <= b""")
def interval_overlap(spark, d):
    o = p.table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    spans = [o.where(F.col("o_orderpriority").startswith(n)).groupBy("k").agg(F.min(p.micros(o, "o_orderdate")).alias(x), F.max(p.micros(o, "o_orderdate")).alias(y)) for n, x, y in (("1", "a", "b"), ("2", "c", "d"))]
    return temporal.overlapping(spans[0], spans[1], "k", "a", "b", "c", "d")


@query("""WITH m AS (SELECT p_partkey AS module_id, p_partkey * 100 AS base, CAST(p_size AS BIGINT) * 10 AS size, p_partkey % 7 AS load_ts FROM part WHERE p_size > 0),
a AS (SELECT DISTINCT l_partkey * 100 + l_linenumber * 37 AS ip, CAST(l_linenumber AS BIGINT) AS t FROM lineitem),
h AS (SELECT ip, t, module_id, row_number() OVER (PARTITION BY ip, t ORDER BY load_ts DESC, module_id DESC) AS rn FROM a JOIN m ON ip >= base AND ip < base + size AND load_ts <= t)
SELECT a.ip, a.t, module_id FROM a LEFT JOIN h ON a.ip = h.ip AND a.t = h.t AND rn = 1""")
def module_range_asof(spark, d):
    part, line = p.table(spark, d, "part"), p.table(spark, d, "lineitem")
    modules = part.select(F.col("p_partkey").alias("module_id"), (F.col("p_partkey") * 100).alias("base"), (F.col("p_size").cast("long") * 10).alias("size"), (F.col("p_partkey") % 7).alias("load_ts"))
    addresses = line.select((F.col("l_partkey") * 100 + F.col("l_linenumber") * 37).alias("ip"), F.col("l_linenumber").cast("long").alias("t")).distinct()
    return temporal.module_at(addresses, modules, [], shift=8)


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand || '.so!' END || '0x' ||
  lpad(lower(to_hex(CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE -4096 - p_partkey END)), 16, '0') AS name FROM part""")
def symbol_generic_name(spark, d):
    part = p.table(spark, d, "part")
    address = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).otherwise(-4096 - F.col("p_partkey"))
    module = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("/usr/lib/"), "p_brand", F.lit(".so")))
    return part.select("p_partkey", scalars.generic_symbol(module, address).alias("name"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events")
def kway_merge_order(spark, d):
    """Each user's events in order of time; a global sort is needed only for output."""
    return _longs(temporal.merged_order(p.table(spark, d, "events"), "user_id", ["ts", "event_id"], "seq").select("event_id", "seq"), "seq")


@query(f"{WITH}, s AS (SELECT sample_id, string_agg(module || '!' || symbol, '>' ORDER BY depth) AS stack FROM frames GROUP BY sample_id) SELECT stack, count(*) AS n, min(sample_id) AS first_sample FROM s GROUP BY stack")
def stack_dedup(spark, d):
    whole = p.frames(spark, d).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", F.concat_ws("!", "module", "symbol").alias("f")))), lambda x: x["f"]).alias("ips"))
    return stacks.distinct_stacks(whole).select(F.array_join("ips", ">").alias("stack"), "n", "first_sample")


@query("""SELECT event_id, user_id, value FROM (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS body FROM events) AS e(event_id, ts, user_id, event_type, old, props, value)
WHERE event_type = 'view'""")
def keyed_stack_forward_asof(spark, d):
    e = p.table(spark, d, "events")
    return temporal.following(e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'purchase'"), "user_id", "event_id", "value").select("event_id", "user_id", "value")


@query("""WITH st AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS seq, max(l_partkey) AS ip FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT o_orderkey AS sample_id, o_custkey AS tid, epoch_us(o_orderdate) AS ts, o_orderkey * 10 AS seq FROM orders),
e AS (SELECT st.seq, st.ip, tid, ts FROM st JOIN s ON l_orderkey = sample_id),
m AS (SELECT e.seq, e.ip, max_by(s.sample_id, s.seq) AS sample_id FROM e JOIN s ON e.tid = s.tid AND e.ts = s.ts AND s.seq < e.seq GROUP BY e.seq, e.ip)
SELECT sample_id, ip % 2 = 1 AS is_kernel, max_by(ip, seq) AS ip FROM m GROUP BY sample_id, ip % 2 = 1""")
def stack_attach(spark, d):
    """Each line is a stack of its order's thread and time; stacks of odd parts begin in the kernel."""
    o, line = p.table(spark, d, "orders"), p.table(spark, d, "lineitem")
    samples = o.select(F.col("o_orderkey").alias("sample_id"), F.lit(0).alias("source_id"), F.col("o_custkey").alias("tid"), p.micros(o, "o_orderdate").alias("ts"), (F.col("o_orderkey") * 10).alias("seq"))
    each = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("ip")).join(samples, F.col("l_orderkey") == F.col("sample_id"))
    outer = F.when(F.col("ip") % 2 == 1, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long"))
    found = stacks.direct(samples, each.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "ts", F.col("ts").alias("event_ts"), "tid", F.array("ip", outer).alias("ips")))
    return found.select("sample_id", "is_kernel", F.element_at("ips", 1).alias("ip"))


LIFE = """ev AS (SELECT user_id, epoch_us(ts) AS ts, event_id AS seq, event_type FROM events WHERE event_type IS NOT NULL),
st AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, seq) AS b FROM ev WHERE event_type <> 'purchase'),
k AS (SELECT user_id, ts, seq, event_type, 1 AS is_start FROM st WHERE b IS NULL OR b <> event_type UNION ALL SELECT user_id, ts, seq, event_type, 0 FROM ev WHERE event_type = 'purchase'),
n AS (SELECT *, sum(is_start) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS entry FROM k),
life AS (SELECT user_id, max(CASE WHEN is_start = 1 THEN ts END) AS start_ts, max(CASE WHEN is_start = 0 THEN ts END) AS end_ts, max(CASE WHEN is_start = 1 THEN event_type END) AS event_type
  FROM n WHERE entry > 0 GROUP BY user_id, entry)"""


def _lives(spark, d) -> DataFrame:
    e = p.table(spark, d, "events").where("event_type is not null")
    kind = F.when(F.col("event_type") == "purchase", "end").otherwise("start")
    return lifetimes.intervals(e.select("user_id", p.micros(e, "ts").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), "event_type"), "user_id", ["event_type"])


@query(f"WITH {LIFE} SELECT * FROM life")
def process_intervals(spark, d):
    """Purchases end what the other events start."""
    return _lives(spark, d)


@query(f"WITH {LIFE} SELECT user_id, start_ts, coalesce(end_ts, lead(start_ts) OVER (PARTITION BY user_id ORDER BY start_ts)) AS end_ts FROM life")
def process_intervals_closed(spark, d):
    return lifetimes.closed_by_next(_lives(spark, d), "user_id").select("user_id", "start_ts", "end_ts")


@query("""WITH f AS (SELECT p_type AS module, p_partkey * 50 AS b, p_partkey * 50 + p_size * 7 AS e, p_name AS symbol FROM part WHERE p_size > 0),
a AS (SELECT DISTINCT p_type AS module, l_partkey * 50 + l_linenumber * 31 AS rel FROM lineitem JOIN part ON l_partkey = p_partkey),
h AS (SELECT a.module, rel, symbol, row_number() OVER (PARTITION BY a.module, rel ORDER BY b DESC, e, symbol DESC) AS rn FROM a JOIN f ON a.module = f.module AND rel >= b AND rel < e)
SELECT a.module, a.rel, coalesce(symbol, a.module || '!0x' || lpad(lower(to_hex(a.rel)), 16, '0')) AS symbol FROM a LEFT JOIN h ON a.module = h.module AND a.rel = h.rel AND rn = 1""")
def symbol_lookup(spark, d):
    part, line = p.table(spark, d, "part"), p.table(spark, d, "lineitem")
    begin = F.col("p_partkey") * 50
    functions = part.select(F.col("p_type").alias("module"), begin.alias("rel_begin"), (begin + F.col("p_size") * 7).alias("rel_end"), F.col("p_name").alias("symbol"))
    asked = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("module"), (F.col("l_partkey") * 50 + F.col("l_linenumber") * 31).alias("rel")).distinct()
    found = symbols.in_range(asked, functions, ["symbol"], shift=8)
    return found.select("module", "rel", F.coalesce("symbol", scalars.generic_symbol(F.col("module"), F.col("rel"))).alias("symbol"))


@query("""WITH t AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)) AS a, max(epoch_us(o_orderdate)) AS b FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey),
s AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)) AS a, max(epoch_us(o_orderdate)) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT DISTINCT t.k % 100 AS pid, t.a AS process_start FROM t JOIN s ON t.k = s.k WHERE t.a <= s.b AND t.b >= s.a""")
def sampled_processes(spark, d):
    o = p.table(spark, d, "orders")
    ts = p.micros(o, "o_orderdate")
    threads = o.where("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("tid")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    threads = threads.select("tid", (F.col("tid") % 100).alias("pid"), F.col("start_ts").alias("process_start"), "start_ts", "end_ts")
    return lifetimes.sampled_processes(threads, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("tid"), ts.alias("ts")))


@query("""SELECT event_id, CASE WHEN b IS NULL THEN NULL WHEN b > value THEN value ELSE value - b END AS delta FROM (
  SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)""")
def counter_deltas(spark, d):
    return counters.deltas(p.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "delta")


@query("""SELECT user_id, segment, count(*) AS n FROM (
  SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events)
GROUP BY user_id, segment""")
def counter_segments(spark, d):
    rows = counters.segments(p.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type = 'view'")
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE t(pid) AS (SELECT CAST(3 AS BIGINT) UNION SELECT c_custkey FROM t JOIN customer ON c_custkey // 2 = pid AND c_custkey <> pid) SELECT pid FROM t""")
def process_closure(spark, d):
    links = p.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.expr("c_custkey div 2").alias("ppid"))
    return temporal.descendants(links, spark.range(3, 4).select(F.col("id").alias("pid")))


@query("SELECT o_orderkey, greatest(o_orderkey * 7 - 500, 0) * 1000 // 3 AS ns FROM orders")
def ticks_to_ns(spark, d):
    return p.table(spark, d, "orders").select("o_orderkey", scalars.ticks_to_ns(F.col("o_orderkey") * 7, F.lit(500), 3_000_000).alias("ns"))
