"""More queries over the star schema: the operators of a viewer's detailed questions and of recorded events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberstack.functions import scalars
from emberstack.operators import calltree, hits, lifetimes, paging, stacks, switches, symbols, temporal
from emberstack.plans import profile as p
from emberstack.plans.queries import EDGES, HITS, TREE, WITH, query
from emberstack.recording import Recording
from emberstack.operators.filters import SampleFilter
from emberstack.tables import saved


@query(f"""{WITH}, f AS (SELECT module, symbol, source_id, {HITS} FROM frames GROUP BY ALL), s AS (SELECT DISTINCT source_id FROM samples), k AS (SELECT DISTINCT module, symbol FROM f)
SELECT k.module, k.symbol, s.source_id, coalesce(total, 0) AS total, coalesce(self, 0) AS self FROM k CROSS JOIN s LEFT JOIN f ON k.module = f.module AND k.symbol = f.symbol AND s.source_id = f.source_id""")
def hits_of_every_source(spark, d):
    """Function hits with a place for each of the five sources, zero where a source has none."""
    found = hits.by_source(hits.function_hits(p.frames(spark, d)), ["module", "symbol"], 5)
    each = found.select("module", "symbol", F.posexplode("hits").alias("source_id", "h"))
    return each.select("module", "symbol", F.col("source_id").cast("long").alias("source_id"), "h.total", "h.self")


NEIGHBOURS = f"""{WITH}, top AS (SELECT module, symbol FROM frames WHERE source_id = 0 GROUP BY module, symbol ORDER BY sum(is_leaf) DESC, count(*) DESC, module, symbol LIMIT 1),
f AS (SELECT module, symbol, source_id, {HITS} FROM frames GROUP BY ALL),
e AS (SELECT source_id, lag(module) OVER w AS cm, lag(symbol) OVER w AS cs, module, symbol FROM frames WINDOW w AS (PARTITION BY sample_id ORDER BY depth)),
near AS (
  SELECT 'caller' AS side, cm AS om, cs AS os, source_id, count(*) AS n FROM e JOIN top t ON e.module = t.module AND e.symbol = t.symbol GROUP BY ALL
  UNION ALL SELECT 'callee', e.module, e.symbol, source_id, count(*) FROM e JOIN top t ON cm = t.module AND cs = t.symbol GROUP BY ALL),
each AS (SELECT side, om, os, sum(CASE WHEN source_id = 0 THEN n ELSE 0 END) AS edge_total FROM near GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY edge_total DESC, om NULLS FIRST, os NULLS FIRST) AS rn, count(*) OVER (PARTITION BY side) AS c FROM each),
shown AS (SELECT side, om, os, edge_total, CASE WHEN c <= 4 OR rn < 4 THEN om END AS module, CASE WHEN NOT (c <= 4 OR rn < 4) THEN '[others]' WHEN om IS NULL THEN '[root]' ELSE os END AS symbol FROM ranked),
sums AS (SELECT side, module, symbol, CAST(sum(edge_total) AS BIGINT) AS edge_total FROM shown GROUP BY ALL),
own AS (SELECT side, s.module, s.symbol, f.source_id, total, self FROM shown s JOIN f ON s.om = f.module AND s.os = f.symbol
  UNION ALL SELECT s.side, s.module, s.symbol, near.source_id, near.n, 0 FROM shown s JOIN near ON s.side = near.side AND s.om IS NULL AND near.om IS NULL)
SELECT o.side, o.module, o.symbol, edge_total, source_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(self) AS BIGINT) AS self
FROM own o JOIN sums ON o.side = sums.side AND o.module IS NOT DISTINCT FROM sums.module AND o.symbol = sums.symbol GROUP BY ALL"""


@query(NEIGHBOURS)
def callers_and_callees(spark, d):
    """Of the function with the most self hits of source 0: edge totals of that source beside the neighbours' own hits."""
    frames = saved(p.frames(spark, d))
    best = hits.function_hits(frames.where("source_id = 0")).orderBy(F.desc("self"), F.desc("total"), "module", "symbol").first()  # one row
    return paging.neighbours(hits.function_edges(frames), hits.function_hits(frames), best["module"], best["symbol"], 0, 4)


@query(f"""{TREE}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY total DESC, path) AS rn FROM tree) WHERE rn = 1),
h AS (SELECT '' AS path, CAST(0 AS BIGINT) AS self UNION ALL SELECT t.path, t.self FROM h JOIN top t ON t.parent = h.path AND t.total > h.self)
SELECT t.path, t.depth, t.total, t.self, t.path IN (SELECT path FROM h) AS expanded FROM tree t JOIN h ON t.parent = h.path""")
def hot_tree(spark, d):
    """The hot path of source 0 with all siblings."""
    root = spark.range(1).select(F.lit(0).cast("long").alias("self"))
    tree = saved(calltree.nodes(p.frames(spark, d, p.samples(spark, d).where("source_id = 0"))))
    return calltree.hot_tree(tree, root).select("path", "depth", "total", "self", "expanded")


@query(f"""{WITH}, f AS (SELECT * FROM frames WHERE process_id = 3 AND file IS NOT NULL AND module = (SELECT min(p_type) FROM part)),
a AS (SELECT symbol, min_by(file, (source_id, ts, sample_id, depth)) AS function_file, min_by(func_line, (source_id, ts, sample_id, depth)) AS function_line FROM f GROUP BY symbol)
SELECT source_id, symbol, instr_line, function_file, function_line, CAST(count(*) AS BIGINT) AS total, CAST(sum(is_leaf) AS BIGINT) AS self FROM f JOIN a USING (symbol) GROUP BY ALL""")
def line_info(spark, d):
    """Line hits of the functions of one module in process 3, with file and first line."""
    module = p.table(spark, d, "part").agg(F.min("p_type").alias("m"))  # one row
    frames = p.frames(spark, d, p.samples(spark, d).where("process_id = 3"))
    own = frames.join(F.broadcast(module), F.col("module") == F.col("m")).drop("m")
    named = hits.function_attribution(own).select(F.col("module").alias("a_module"), F.col("symbol").alias("a_symbol"), F.col("file").alias("function_file"), F.col("func_line").alias("function_line"))
    found = hits.line_hits(own).join(named, (F.col("module") == F.col("a_module")) & (F.col("symbol") == F.col("a_symbol")))
    return found.select("source_id", "symbol", "instr_line", "function_file", "function_line", "total", "self")


@query(f"{WITH}, b AS (SELECT min(ts) AS a FROM samples) SELECT source_id, count(*) AS n FROM samples, b WHERE ts BETWEEN a AND a + 100000000000000 GROUP BY source_id")
def filter_relative_time(spark, d):
    """A filter's times count from the session's start; negative ones are the start."""
    s = p.samples(spark, d)
    r = Recording(s, s, s, s, origin=s.agg(F.min("ts").alias("a")).first()["a"]).filtered(SampleFilter(-7, 100_000_000_000_000))
    return hits.sample_totals(r._samples()).withColumnRenamed("total", "n")


@query("""WITH c AS (SELECT o_custkey % 7 AS source, o_custkey AS tid, o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%'),
t AS (SELECT o_custkey AS tid, o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '2%')
SELECT id AS sample_id FROM c WHERE source = 0 UNION ALL SELECT id FROM t WHERE tid NOT IN (SELECT tid FROM c WHERE source = 0)""")
def counter_precedence(spark, d):
    """Counter samples of source 0 hide a thread's timer samples."""
    o = p.table(spark, d, "orders")
    timer = o.where("o_orderpriority like '2%'").select(F.col("o_orderkey").alias("sample_id"), F.lit(0).cast("long").alias("source_id"), F.col("o_custkey").alias("tid"))
    counted = o.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 7).alias("source_id"), F.col("o_custkey").alias("tid"))
    return stacks.of_source(timer, counted, 0).select("sample_id")


PATHS = r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '\Device\HarddiskVolume1\' WHEN 1 THEN '\Device\HarddiskVolume12\' WHEN 2 THEN '\SystemRoot\' WHEN 3 THEN '\Device\Mup\share\' ELSE 'C:\' END || p_brand AS path FROM part)
SELECT p_partkey, CASE WHEN starts_with(path, '\Device\Mup\share\') THEN 'S:' || substr(path, 18) WHEN starts_with(path, '\Device\HarddiskVolume12\') THEN 'E:' || substr(path, 25)
  WHEN starts_with(path, '\Device\HarddiskVolume1\') THEN 'D:' || substr(path, 24) WHEN starts_with(path, '\SystemRoot\') THEN 'C:\Windows' || substr(path, 12) ELSE path END AS path FROM x"""


@query(PATHS)
def device_paths(spark, d):
    part = p.table(spark, d, "part")
    n = F.col("p_partkey") % 5
    device = F.when(n == 0, "\\Device\\HarddiskVolume1\\").when(n == 1, "\\Device\\HarddiskVolume12\\").when(n == 2, "\\SystemRoot\\").when(n == 3, "\\Device\\Mup\\share\\").otherwise("C:\\")
    devices = {"\\Device\\HarddiskVolume1": "D:", "\\Device\\HarddiskVolume12": "E:", "\\Device\\Mup\\share": "S:"}
    return part.select("p_partkey", symbols.local_path(F.concat(device, "p_brand"), devices, "C:\\Windows\\").alias("path"))


@query("""WITH m AS (SELECT p_partkey, p_type AS filename, CASE WHEN p_size % 3 <> 0 THEN p_name END AS build_id FROM part), f AS (SELECT p_type AS filename, min(p_brand) AS b FROM part WHERE p_size % 2 = 0 GROUP BY p_type)
SELECT p_partkey, m.filename, coalesce(build_id, b) AS build_id FROM m LEFT JOIN f ON m.filename = f.filename""")
def build_ids(spark, d):
    part = p.table(spark, d, "part")
    modules = part.select("p_partkey", F.col("p_type").alias("filename"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("build_id"))
    return symbols.build_ids(modules, part.where("p_size % 2 = 0").select(F.col("p_type").alias("filename"), F.col("p_brand").alias("build_id")))


@query("""WITH n AS (SELECT n_nationkey * 3 + i AS id, n_name, n_nationkey FROM nation, range(2) r(i)), first AS (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1),
x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 80 END AS event_id FROM supplier)
SELECT s_suppkey, event_id, coalesce(n_name, CASE WHEN event_id IS NULL THEN (SELECT n_name FROM first) END, 'unknown event ' || event_id) AS name FROM x LEFT JOIN n ON event_id = id""")
def event_source_names(spark, d):
    """Descriptors hold two ids each; a null id has the first one's name."""
    nation = p.table(spark, d, "nation")
    key = F.col("n_nationkey").cast("long")
    described = nation.select(key.alias("place"), F.col("n_name").alias("name"), F.array(key * 3, key * 3 + 1).alias("ids"))
    ids = p.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 != 0, F.col("s_suppkey") % 80).alias("event_id"))
    return symbols.source_names(ids, described)


@query("""WITH x AS (SELECT CAST(n_regionkey AS BIGINT) AS disk, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS partition, n_name AS drive FROM nation),
c AS (SELECT disk, max(partition) AS n FROM x GROUP BY disk), b AS (SELECT disk, coalesce(sum(n) OVER (ORDER BY disk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT x.disk, partition, drive, CAST(before + partition AS BIGINT) AS volume FROM x JOIN b ON x.disk = b.disk""")
def volume_numbers(spark, d):
    """Regions are disks, their nations partitions."""
    nation = temporal.merged_order(p.table(spark, d, "nation"), "n_regionkey", ["n_nationkey"], "partition")
    return symbols.volumes(nation.select(F.col("n_regionkey").cast("long").alias("disk"), F.col("partition").cast("long").alias("partition"), F.col("n_name").alias("drive")))


@query("""WITH s AS (SELECT o_orderkey AS sample_id, o_custkey AS tid, epoch_us(o_orderdate) AS ts, o_orderkey * 10 AS seq FROM orders),
k AS (SELECT s.tid, s.ts, s.seq + 1 AS seq, sample_id % 50 AS key, sample_id % 2 = 0 AS is_kernel FROM s WHERE sample_id % 3 = 0),
b AS (SELECT o_orderkey * 10 + 5 AS seq, o_orderkey % 50 AS key, o_orderkey AS ip FROM orders WHERE o_orderkey % 4 = 0),
m AS (SELECT k.seq, k.key, k.is_kernel, k.ts, max_by(s.sample_id, s.seq) AS sample_id FROM k JOIN s ON k.tid = s.tid AND k.ts = s.ts AND s.seq < k.seq GROUP BY ALL),
j AS (SELECT m.*, b.seq AS b_seq, b.ip, row_number() OVER (PARTITION BY m.seq ORDER BY b.seq) AS rn FROM m JOIN b ON m.key = b.key AND b.seq > m.seq)
SELECT sample_id, is_kernel, max_by(ts, seq) AS stack_ts, max_by(ip, seq) AS ip FROM j WHERE rn = 1 GROUP BY sample_id, is_kernel""")
def keyed_stacks(spark, d):
    """A third of the orders refer to a stack by a key that is used again; the next body of the key is meant."""
    o = p.table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("sample_id"), F.lit(0).cast("long").alias("source_id"), F.col("o_custkey").alias("tid"), p.micros(o, "o_orderdate").alias("ts"), (F.col("o_orderkey") * 10).alias("seq"))
    keys = s.where("sample_id % 3 = 0").select((F.col("seq") + 1).alias("seq"), "ts", F.col("ts").alias("event_ts"), "tid", (F.col("sample_id") % 50).alias("key"), (F.col("sample_id") % 2 == 0).alias("is_kernel"))
    bodies = o.where("o_orderkey % 4 = 0").select((F.col("o_orderkey") * 10 + 5).alias("seq"), (F.col("o_orderkey") % 50).alias("key"), F.array("o_orderkey").alias("ips"))
    return stacks.keyed(s, keys, bodies).select("sample_id", "is_kernel", "stack_ts", F.element_at("ips", 1).alias("ip"))


@query("""WITH p AS (SELECT user_id AS pid, epoch_us(ts) AS start_ts FROM events WHERE event_type = 'view'), t AS (SELECT event_id AS tid, user_id AS pid, epoch_us(ts) AS start_ts FROM events WHERE event_type <> 'view')
SELECT tid, t.pid, t.start_ts, coalesce(max(CASE WHEN p.start_ts <= t.start_ts THEN p.start_ts END), min(p.start_ts)) AS process_start FROM t LEFT JOIN p ON t.pid = p.pid GROUP BY ALL""")
def threads_of_processes(spark, d):
    """Each thread's process is the one of its pid alive when the thread started."""
    e = p.table(spark, d, "events")
    start = p.micros(e, "ts").alias("start_ts")
    threads = e.where("event_type <> 'view'").select(F.col("event_id").alias("tid"), F.col("user_id").alias("pid"), start)
    return lifetimes.with_process(threads, e.where("event_type = 'view'").select(F.col("user_id").alias("pid"), start))


@query("""WITH e AS (SELECT event_id AS seq, epoch_us(ts) AS ts, user_id % 40 AS old_tid, (user_id + event_id) % 40 AS new_tid FROM events WHERE event_type <> 'purchase'),
m AS (SELECT event_id AS seq, epoch_us(ts) AS ts, user_id % 40 AS tid FROM events WHERE event_type = 'purchase'),
th AS (SELECT DISTINCT tid, tid + 1000 AS thread_key FROM m),
r AS (SELECT old_tid AS tid, seq, 'exit' AS what FROM e UNION ALL SELECT new_tid, seq, 'into' FROM e UNION ALL SELECT tid, seq, 'mark' FROM m),
g AS (SELECT *, sum(CASE WHEN what = 'mark' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY seq, what ROWS UNBOUNDED PRECEDING) - CASE WHEN what = 'mark' THEN 1 ELSE 0 END AS segment FROM r),
s AS (SELECT tid, segment, count(*) FILTER (what = 'exit') AS exits, count(*) FILTER (what <> 'mark') AS n FROM g GROUP BY tid, segment)
SELECT thread_key, CAST(sum(exits) AS BIGINT) AS context_switches FROM s JOIN th ON s.tid = th.tid WHERE n > 0 GROUP BY thread_key""")
def context_switches(spark, d):
    """Switches of 40 thread numbers, segments closed by purchases; each number is one thread."""
    e = p.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("seq"), p.micros(e, "ts").alias("ts"), (F.col("user_id") % 40).alias("old_tid"), ((F.col("user_id") + F.col("event_id")) % 40).alias("new_tid"), "event_type")
    marks = rows.where("event_type = 'purchase'").select("seq", "ts", F.col("old_tid").alias("tid"))
    threads = marks.groupBy("tid").agg(F.min("ts").alias("start_ts")).select((F.col("tid") + 1000).alias("thread_key"), "tid", "start_ts")
    switched = rows.where("event_type <> 'purchase'").withColumn("pmc", F.array().cast("array<bigint>"))
    return switches.per_thread(switched, marks, threads).select("thread_key", "context_switches")


@query("""SELECT c_nationkey AS process_key, CAST(sum(c_custkey % 10) AS BIGINT) AS context_switches, CAST(sum(c_custkey) AS BIGINT) AS first_counter, CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 END) AS BIGINT) AS second_counter
FROM customer GROUP BY c_nationkey""")
def process_statistics(spark, d):
    """Customers are threads of their nation, a third of them with two counters."""
    c = p.table(spark, d, "customer")
    key = F.col("c_custkey")
    threads = c.select(F.col("c_nationkey").alias("process_key"), (key % 10).alias("context_switches"), F.when(key % 3 == 0, F.array(key, key * 2)).otherwise(F.array(key)).alias("pmc"))
    return switches.per_process(threads).select("process_key", "context_switches", F.get("pmc", F.lit(0)).alias("first_counter"), F.get("pmc", F.lit(1)).alias("second_counter"))


@query(f"{EDGES}, f AS (SELECT module, symbol, min((source_id, sample_id, depth)) AS first FROM frames GROUP BY module, symbol) SELECT module, symbol, CAST(row_number() OVER (ORDER BY first, module, symbol) - 1 AS BIGINT) AS id FROM f")
def function_numbers(spark, d):
    """Functions numbered as they are first seen."""
    return temporal.dense_ids(p.frames(spark, d), ["module", "symbol"], ["source_id", "sample_id", "depth"], "id")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS pid, c_custkey % 7 AS start_ts, c_custkey // 3 AS ppid, CASE WHEN c_custkey % 11 = 0 THEN 'conhost.exe' ELSE 'x' END AS name FROM customer),
t(pid) AS (SELECT pid FROM c WHERE pid IN (2, 5) UNION SELECT c.pid FROM t JOIN c ON c.ppid = t.pid JOIN c q ON q.pid = c.ppid AND q.start_ts <= c.start_ts WHERE c.name <> 'conhost.exe' AND c.pid <> c.ppid)
SELECT c.pid, c.start_ts FROM t JOIN c ON t.pid = c.pid""")
def profile_targets(spark, d):
    """Two marked processes and their descendants; a child starts while its parent lives."""
    key = F.col("c_custkey")
    processes = p.table(spark, d, "customer").select(key.alias("pid"), (key % 7).alias("start_ts"), F.expr("c_custkey div 3").alias("ppid"), F.when(key % 11 == 0, "conhost.exe").otherwise("x").alias("name"))
    marked = processes.where("pid in (2, 5)").select("pid", F.col("start_ts").alias("ts"))
    return lifetimes.targets(saved(processes), marked, processes.limit(0).select("pid", "start_ts"))


def _scalar(name: str, table: str, key: str, column, sql: str) -> None:
    def run(spark, d):
        return p.table(spark, d, table).select(key, column().alias("value"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS value FROM {table}")(run)


_K, _S = (lambda: F.col("p_partkey")), (lambda: F.col("p_size"))
_scalar("ns_to_ticks", "orders", "o_orderkey", lambda: scalars.ns_to_ticks(F.col("o_orderkey") * 7919, 3_000_000), "o_orderkey * 7919 * 3 // 1000")
_scalar("relative_time", "orders", "o_orderkey", lambda: scalars.relative_ns(F.col("o_orderkey"), F.lit(700)), "greatest(o_orderkey - 700, 0)")
_scalar("nt_time", "part", "p_partkey", lambda: scalars.unix_micros(scalars.nt_timestamp(_K() * 12345678901 + 116444736000000000), "timestamp"), "p_partkey * 12345678901 // 10")
_scalar("session_date", "part", "p_partkey", lambda: scalars.session_date(F.timestamp_seconds(_K() * 100000)), "strftime(make_timestamp(p_partkey * 100000000000), '%Y-%m-%dT%H:%M') || '+0000'")
_scalar("architecture_name", "part", "p_partkey", lambda: scalars.architecture(_S()), "CASE p_size WHEN 0 THEN 'x86' WHEN 1 THEN 'MIPS' WHEN 2 THEN 'Alpha' WHEN 3 THEN 'PowerPC' WHEN 5 THEN 'ARM' WHEN 6 THEN 'ia64' WHEN 9 THEN 'x64' WHEN 12 THEN 'ARM64' ELSE '[unknown]' END")
_scalar("equals_ascii", "part", "p_partkey", lambda: scalars.equals_ascii(F.col("p_type"), F.initcap("p_type")), "lower(p_type) = lower(p_type)")
_scalar("trimmed", "part", "p_partkey", lambda: scalars.trimmed(F.concat(F.lit(" \t"), "p_brand", F.lit("\n x \r"))), "p_brand || chr(10) || ' x'")
_scalar("guid_text", "part", "p_partkey", lambda: scalars.guid_text(F.unhex(F.md5(_K().cast("string").cast("binary")))),
        """regexp_replace(md5(CAST(p_partkey AS VARCHAR)), '^(..)(..)(..)(..)(..)(..)(..)(..)(....)(.*)$', '\\4\\3\\2\\1-\\6\\5-\\8\\7-\\9-') || substr(md5(CAST(p_partkey AS VARCHAR)), 21)""")
_scalar("build_id_text", "part", "p_partkey", lambda: scalars.hex_text(F.unhex(F.sha1(F.col("p_name").cast("binary")))), "sha1(p_name)")
_scalar("root_label", "part", "p_partkey", lambda: scalars.root_label(F.col("p_name"), _K()), "p_name || ' (PID: ' || p_partkey || ')'")
_scalar("utf16_text", "part", "p_partkey", lambda: scalars.utf16_text(F.encode("p_name", "UTF-16LE")), "p_name")
_scalar("is_recorder", "part", "p_partkey", lambda: scalars.is_recorder(F.when(_S() % 2 == 0, "XPerf.exe").otherwise("VSDiagnostics.exe"), F.when(_S() % 3 == 0, " start 1").when(_S() % 3 == 1, "x -on y")),
        "CASE WHEN p_size % 2 = 0 THEN p_size % 3 = 1 ELSE p_size % 3 = 0 END")


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IS NOT NULL AND event_type <> 'view' AND user_id = 7 GROUP BY event_type")
def event_counts(spark, d):
    """Counts of one process's events but those of a kind that is left out."""
    from emberstack.sources import open as opener

    e = p.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("pid"))
    return opener.counts(e.where("kind is not null"), without=["view"], pid=7)
