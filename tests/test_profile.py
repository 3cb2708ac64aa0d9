"""Known inputs and results of the profile operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberstack.functions import scalars
from emberstack.operators import calltree, counters, filters, hits, paging, temporal

A, B, C = ("func_a", "mod_a.so", "a.cpp", 10), ("func_b", "mod_b.dll", "b.h", 100), ("func_c", "mod_a.so", "a.cpp", 50)


@pytest.fixture(scope="module")
def stacks(spark):
    rows = []
    for sample, stack in ((1, [(A, 15), (B, 100)]), (2, [(A, 15), (C, 60), (B, 110)])):
        for depth, ((symbol, module, file, line), instr) in enumerate(stack, 1):
            rows.append((sample, 1, sample * 10, depth, module, symbol, file, line, instr))
    frames = spark.createDataFrame(rows, "sample_id long, source_id long, ts long, depth long, module string, symbol string, file string, func_line long, instr_line long")
    samples = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 1, 30)], "sample_id long, source_id long, ts long")
    return samples, hits.with_leaf(frames).cache()


def _of(df, *names):
    return {tuple(r[n] for n in names): (r["total"], r["self"]) for r in df.collect()}


def test_hits(stacks):
    samples, frames = stacks
    assert _of(hits.function_hits(frames), "symbol") == {("func_a",): (2, 0), ("func_b",): (2, 2), ("func_c",): (1, 0)}
    assert _of(hits.module_hits(frames), "module") == {("mod_a.so",): (3, 0), ("mod_b.dll",): (2, 2)}
    assert _of(hits.file_hits(frames), "file") == {("a.cpp",): (3, 0), ("b.h",): (2, 2)}
    assert _of(hits.line_hits(frames), "symbol", "instr_line") == {("func_a", 15): (2, 0), ("func_b", 100): (1, 1), ("func_b", 110): (1, 1), ("func_c", 60): (1, 0)}
    assert _of(hits.root_hits(samples, frames), "source_id") == {(1,): (3, 1)}
    edges = {(k[0].split("!")[-1], k[1].split("!")[-1]): v for k, v in _of(hits.caller_edges(frames), "caller", "callee").items()}
    assert edges == {("[root]", "func_a"): (2, 0), ("func_a", "func_b"): (1, 0), ("func_a", "func_c"): (1, 0), ("func_c", "func_b"): (1, 0)}
    first = {r.symbol: (r.file, r.func_line) for r in hits.function_attribution(frames).collect()}
    assert first == {"func_a": ("a.cpp", 10), "func_b": ("b.h", 100), "func_c": ("a.cpp", 50)}


def test_call_tree(spark, stacks):
    tree = calltree.nodes(stacks[1]).cache()
    a, b, c = "mod_a.so!func_a", "mod_b.dll!func_b", "mod_a.so!func_c"
    assert _of(tree, "path") == {(a,): (2, 0), (f"{a}>{b}",): (1, 1), (f"{a}>{c}",): (1, 0), (f"{a}>{c}>{b}",): (1, 1)}
    assert calltree.children(tree, a).count() == 2
    hot = calltree.hot_path(tree, spark.range(1).select(F.lit(1).cast("long").alias("self"))).orderBy("depth")
    assert [r.path for r in hot.collect()] == [a, f"{a}>{c}", f"{a}>{c}>{b}"]
    parents = tree.groupBy("parent").agg(F.sum("total").alias("kids"))
    assert tree.join(parents.withColumnRenamed("parent", "path"), "path").where("total <> self + kids").count() == 0


def test_all_sources(spark, stacks):
    """Hits by source of functions and paths that source 0 never sees."""
    frames = stacks[1].withColumn("source_id", F.col("sample_id") - 1)
    a, b, c = "mod_a.so!func_a", "mod_b.dll!func_b", "mod_a.so!func_c"
    tree = calltree.nodes(frames, ("source_id",))
    assert _of(tree, "path", "source_id") == {(a, 0): (1, 0), (a, 1): (1, 0), (f"{a}>{b}", 0): (1, 1), (f"{a}>{c}", 1): (1, 0), (f"{a}>{c}>{b}", 1): (1, 1)}
    page = paging.page_by_source(hits.function_hits(frames), ["module", "symbol"], ["total", "symbol"], 2, 0, 0)
    assert _of(page, "symbol", "source_id") == {("func_c", 1): (1, 0), ("func_a", 0): (1, 0), ("func_a", 1): (1, 0)}
    rows = [("g", x, s, v) for x, s, v in (("a", 1, 9), ("b", 0, 2), ("b", 1, 1), ("c", 0, 3), ("d", 2, 4))]
    top = paging.top_with_others_by_source(spark.createDataFrame(rows, "k string, name string, source_id long, v long"), ["k"], "name", "v", 3, 0)
    assert {(r.name, r.source_id, r.v) for r in top.collect()} == {("c", 0, 3), ("b", 0, 2), ("b", 1, 1), ("[others]", 1, 9), ("[others]", 2, 4)}


def test_every_listed_operator_has_all_sources():
    from emberstack.plans.queries import QUERIES, SQL

    names = ["call_tree_nodes", "call_tree_children", "callees_topk_others", "callers_topk_others", *(x for x in QUERIES if x.startswith("functions_page_") and not x.endswith("_all_sources"))]
    assert len(names) == 10 and all(f"{x}_all_sources" in QUERIES and "WHERE source_id = 0" not in SQL[f"{x}_all_sources"] for x in names)


def test_history_and_asof(spark):
    events = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (1, 11, "b"), (2, 5, "c")], "id long, ts long, name string")
    kept = {(r.id, r.ts, r.name) for r in temporal.history(events, "id", ["ts", "name"], "name").collect()}
    assert kept == {(1, 10, "a"), (1, 11, "b"), (2, 5, "c")}
    entries = spark.createDataFrame([(1, 10, "a"), (1, 15, "b"), (2, 5, "c")], "id long, ts long, name string")
    probes = spark.createDataFrame([(1, 5), (1, 10), (1, 12), (1, 15), (1, 18), (2, 3), (2, 5), (2, 10), (3, 1)], "id long, t long")
    want = {(1, 5): (None, "a"), (1, 10): ("a", "a"), (1, 12): ("a", "a"), (1, 15): ("b", "b"), (1, 18): ("b", "b"), (2, 3): (None, "c"), (2, 5): ("c", "c"), (2, 10): ("c", "c"), (3, 1): (None, None)}
    for k, strict in enumerate((True, False)):
        got = {(r.id, r.t): r.found for r in temporal.asof(probes, entries, "id", "t", "ts", "name", [], strict, "found").collect()}
        assert got == {x: v[k] for x, v in want.items()}
    open_ = spark.createDataFrame([(1, 10, None), (1, 15, 20), (1, 30, None)], "id long, start long, end long")
    assert sorted((r.start, r.end) for r in temporal.close_intervals(open_, "id", "start", "end").collect()) == [(10, 15), (15, 20), (30, None)]


def test_modules(spark):
    high = -(2**62)
    modules = spark.createDataFrame([("m1", 10, 20, 5), ("m2", 50, 20, 10), ("m3", 90, 40, 3), ("k", high, 1 << 20, 1), ("none", 20, 0, 1)], "module_id string, base long, size long, load_ts long")
    want = {(20, 0): None, (10, 5): "m1", (20, 5): "m1", (30, 5): None, (60, 5): None, (60, 10): "m2", (100, 2): None, (100, 4): "m3", (5, 20): None, (150, 20): None, (high + 70000, 2): "k"}
    probes = spark.createDataFrame(list(want), "ip long, t long")
    assert {(r.ip, r.t): r.module_id for r in temporal.module_at(probes, modules, []).collect()} == want


def test_keyed_stacks_use_the_next_body(spark):
    keys = spark.createDataFrame([(1, 1), (2, 2), (2, 5)], "key long, seq long")
    bodies = spark.createDataFrame([(1, 4, "x"), (2, 3, "y"), (2, 6, "z")], "key long, seq long, body string")
    assert {(r.key, r.seq): r.body for r in temporal.following(keys, bodies, "key", "seq", "body").collect()} == {(1, 1): "x", (2, 2): "y", (2, 5): "z"}


def test_descendants(spark):
    links = spark.createDataFrame([(456, 123), (891, 123), (910, 891), (789, 1), (123, 0)], "pid long, ppid long")
    got = {r.pid for r in temporal.descendants(links, spark.createDataFrame([(123,)], "pid long")).collect()}
    assert got == {123, 456, 891, 910}


def test_filters(spark):
    assert [filters.wildcard_to_regex(x) for x in ("*", "*.exe", "filename (1).so")] == ["^(?:.*)$", r"^(?:.*\.exe)$", r"^(?:filename\ \(1\)\.so)$"]
    names = spark.createDataFrame([("a.exe",), ("b.so",), ("filename (1).so",)], "m string")
    assert {r.m for r in names.where(filters.module_passes(F.col("m"), include=["*.exe", "filename (1).so"])).collect()} == {"a.exe", "filename (1).so"}
    assert {r.m for r in names.where(filters.module_passes(F.col("m"), exclude=["?.exe"])).collect()} == {"b.so", "filename (1).so"}
    paths = spark.createDataFrame([("/a/x",), ("/b/my-file.exe",), ("/c",)], "p string")
    rules = [("prefix", "/a/", "/z/"), ("regex", r"my-file\.exe$", "other-file.dll"), ("prefix", "/b/", "/never/")]
    assert [r.q for r in paths.select(filters.map_path(F.col("p"), rules).alias("q")).collect()] == ["/z/x", "/b/other-file.dll", "/c"]
    samples = spark.createDataFrame([(1, 5, 1, 1), (2, 10, 1, 2), (3, 15, 2, 3)], "sample_id long, ts long, process_id long, thread_id long")
    pick = lambda **k: {r.sample_id for r in filters.filtered(samples, filters.SampleFilter(**k)).collect()}
    assert pick(min_time=5, max_time=10) == {1, 2} and pick(min_time=9, max_time=8) == set()
    assert pick(excluded_processes=(1,)) == {3} and pick(excluded_threads=(2,)) == {1, 3}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.percent(F.lit(34), F.lit(292)).alias("p"), scalars.percent(F.lit(1), F.lit(0)).alias("z"), scalars.hex_address(F.lit(-1)).alias("h"),
        scalars.generic_symbol(F.lit("C:\\x\\m.dll"), F.lit(255)).alias("g"), scalars.ticks_to_ns(F.lit(9007199254740993), F.lit(0), 10_000_000).alias("t"),
        scalars.without_context_markers(F.array(F.lit(-128), F.lit(7), F.lit(-4096))).alias("c"), scalars.root_first(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), F.array(F.lit(3), F.lit(4)).cast("array<bigint>")).alias("r"),
        scalars.is_kernel_address(F.lit(-5)).alias("k"), scalars.is_kernel_address(F.lit(2**31), 4).alias("k4"),
    ).first()
    assert (row.p, row.z, row.h, row.g, row.t) == (11.643835616438356, 0.0, "0xffffffffffffffff", "m.dll!0x00000000000000ff", 900719925474099300)
    assert (row.c, row.r, row.k, row.k4) == ([7, -4096], [2, 1, 4, 3], True, True)


def test_paging_and_counters(spark):
    rows = spark.createDataFrame([("g", x, v) for x, v in (("a", 5), ("b", 4), ("c", 3), ("d", 2))], "k string, name string, v long")
    assert {(r.name, r.v) for r in paging.top_with_others(rows, ["k"], "name", "v", 3).collect()} == {("a", 5), ("b", 4), ("[others]", 5)}
    assert paging.top_with_others(rows, ["k"], "name", "v", 4).count() == 4
    assert [r.name for r in paging.page(rows, ["v", "name"], 2, 1, descending=True).collect()] == ["c", "d"]
    c = spark.createDataFrame([(1, 1, 100), (1, 2, 120), (1, 3, 30)], "t long, seq long, v long")
    assert [r.delta for r in counters.deltas(c, "t", ["seq"], "v").orderBy("seq").collect()] == [None, 20, 30]
    assert [r.segment for r in counters.segments(c, "t", ["seq"], "v > 110").orderBy("seq").collect()] == [0, 1, 1]
