"""What would break with size: cycles, depth, names with separators, one busy key, huge mappings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberstack.operators import calltree, filters, graph, hits, symbols, temporal


def test_cycles_end(spark):
    links = spark.createDataFrame([(3, 4), (4, 3), (5, 4), (6, 6), (7, 6), (8, None)], "pid long, ppid long")
    of = lambda *pids: {r.pid for r in temporal.descendants(links, spark.createDataFrame([(x,) for x in pids], "pid long")).collect()}
    assert of(3) == {3, 4, 5} and of(6) == {6, 7} and of(9) == {9} and temporal.descendants(links, links.select("pid").limit(0)).count() == 0


def test_a_chain_of_a_thousand(spark):
    links = spark.range(1, 1001).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    assert graph.reachable(links, spark.range(1).select(F.col("id").alias("node"))).count() == 1001


@pytest.mark.parametrize("seed", [1, 2])
def test_any_graph(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    want, grow = {0, 7}, True
    while grow:
        more = {c for c, p in edges if p in want} - want
        want |= more
        grow = bool(more)
    got = graph.reachable(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame([(0,), (7,), (7,)], "node long"))
    assert {r.node for r in got.collect()} == want


def _frames(spark, stacks):
    rows = [(s, 0, d, m, f) for s, stack in enumerate(stacks) for d, (m, f) in enumerate(stack, 1)]
    return hits.with_leaf(spark.createDataFrame(rows, "sample_id long, source_id long, depth long, module string, symbol string"))


def test_names_with_separators_are_told_apart(spark):
    tree = calltree.nodes(_frames(spark, [[("a", "b>m!c")], [("a", "b"), ("m", "c")], [("a!b", "c")], [("a", "b!c")], [(None, "x")], [("", "x")]])).cache()
    assert tree.count() == 7 and tree.select("key").distinct().count() == 7
    one = tree.where("module = 'a' and symbol = 'b'").first()
    assert [(r.module, r.symbol) for r in calltree.children(tree, one.key).collect()] == [("m", "c")]
    edges = hits.function_edges(_frames(spark, [[("a!b", "c"), ("x", "y")], [("a", "b!c"), ("x", "y")]]))
    assert edges.where("caller is not null").count() == 2


def test_a_deep_hot_path(spark):
    deep = [("m", f"f{i}") for i in range(300)]
    tree = calltree.nodes(_frames(spark, [deep, deep, deep[:100] + [("m", "side")]]))
    root = spark.range(1).select(F.lit(0).cast("long").alias("self"))
    path = calltree.hot_path(tree, root).orderBy("depth").collect()
    assert [r.depth for r in path] == list(range(1, 301)) and path[-1].path.endswith("f299") and path[99].total == 3
    shown = {(r.symbol, r.expanded) for r in calltree.hot_tree(tree, root).where("depth = 101").collect()}
    assert shown == {("f100", True), ("side", False)}


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("slices", [1, 7, 50])
def test_asof_of_one_key_in_slices(spark, strict, slices):
    rng = random.Random(3)
    entries = [(k, rng.randrange(1000), i, None if rng.random() < 0.1 else f"v{i}") for i in range(200) for k in (rng.choice([1, 1, 1, 2]),)]
    probes = [(rng.choice([1, 1, 2, 3]), rng.randrange(-50, 1100), i) for i in range(300)]
    want = {}
    for k, t, i in probes:
        own = sorted((s, tie, v) for kk, s, tie, v in entries if kk == k and v is not None)
        before = [v for s, _, v in own if s <= t]
        want[i] = before[-1] if before else own[0][2] if own and not strict else None
    got = temporal.asof(spark.createDataFrame(probes, "k long, t long, i long"), spark.createDataFrame(entries, "k long, s long, tie long, v string"), "k", "t", "s", "v", ["tie"], strict, "found", slices)
    assert {r.i: r.found for r in got.collect()} == want
    none = spark.createDataFrame([], "k long, s long, tie long, v string")
    assert temporal.asof(spark.createDataFrame(probes, "k long, t long, i long"), none, "k", "t", "s", "v", ["tie"], strict, "found").where("found is null").count() == 300


def test_one_busy_key_is_many_groups(spark):
    entries = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("s"), F.col("id").cast("string").alias("v"))
    probes = spark.range(20000).select(F.lit(1).alias("k"), (F.col("id") % 1000).alias("t"))
    plan = temporal.asof(probes, entries, "k", "t", "s", "v", [], True, "found", 40)
    assert plan.where("found <> cast(t as string)").count() == 0
    assert "hashpartitioning(k" in plan._jdf.queryExecution().toString() and "__slice" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("spread", ["id", "id * id", "0"])
def test_slices_are_even_when_all_entries_are_before_all_probes(spark, spread):
    entries = spark.createDataFrame([(1, -5, "a"), (1, -4, "b"), (1, -9, "c"), (2, 10, "d")], "k long, s long, v string")
    probes = spark.range(20000).select(F.lit(1).alias("k"), F.expr(spread).alias("t"))
    times = probes.select(F.col("t").cast("double")).unionByName(entries.select(F.col("s").cast("double").alias("t")))
    groups = [r["count"] for r in temporal.with_slice(probes, temporal.time_bounds(times, 40), 40, "t", "n").groupBy("n").count().collect()]
    assert spread == "0" or max(groups) < 2 * 20000 / 40
    for strict in (True, False):
        assert temporal.asof(probes, entries, "k", "t", "s", "v", [], strict, "found", 40).where("found = 'b'").count() == 20000


def test_huge_mappings(spark):
    top = -(2**63)
    modules = spark.createDataFrame([("big", 1 << 20, 1 << 46, 0), ("half", 1 << 50, top, 1), ("tiny", (1 << 30) + 5, 1, 2), ("edge", -16, 16, 0), ("none", 5, 0, 0)], "module_id string, base long, size long, load_ts long")
    want = {(1 << 45, 1): "big", ((1 << 30) + 5, 3): "tiny", ((1 << 30) + 6, 3): "big", ((1 << 46) + (1 << 20) - 1, 9): "big", ((1 << 46) + (1 << 20), 9): None, (1 << 60, 9): "half", (-1, 9): "edge", (-16, 0): "edge", (5, 9): None, ((1 << 50) + 1, 0): None}
    probes = spark.createDataFrame(list(want), "ip long, t long")
    assert {(r.ip, r.t): r.module_id for r in temporal.module_at(probes, modules, []).collect()} == want
    assert temporal.module_at(probes, modules.limit(0), []).where("module_id is null").count() == len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ranges = [(rng.choice("ab"), b, b + rng.choice([1, 16, 300, 5000, 1 << 40]), f"r{i}") for i in range(60) for b in (rng.randrange(-2000, 20000),)]
    asked = sorted({(rng.choice("abc"), rng.randrange(-3000, 30000)) for _ in range(300)})
    got = symbols.in_range(spark.createDataFrame(asked, "module string, rel long"), spark.createDataFrame(ranges, "module string, rel_begin long, rel_end long, symbol string"), ["symbol"])
    for r in got.collect():
        held = [(b, -e, s) for m, b, e, s in ranges if m == r.module and b <= r.rel < e]
        assert r.symbol == (max(held)[2] if held else None), r


def test_samples_of_no_process_are_not_excluded(spark):
    samples = spark.createDataFrame([(1, 5, None, None), (2, 6, 1, 2)], "sample_id long, ts long, process_id long, thread_id long")
    assert [r.sample_id for r in filters.filtered(samples, filters.SampleFilter(excluded_processes=(1,), excluded_threads=(2,))).collect()] == [1]


def test_a_million_numbers_by_all_tasks(spark):
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.lit("x").alias("v"))
    got = temporal.numbered(rows, ["k"], "n").cache()
    order = got.withColumn("want", F.expr("k"))
    assert got.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (0, 999_999, 1_000_000)
    step = order.withColumn("part", F.expr("n div 1000")).groupBy("part").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("c"))
    parts = step.orderBy("part").collect()
    assert all(r.c == 1000 for r in parts) and all(x.b < y.a for x, y in zip(parts, parts[1:]))
    assert got.groupBy(F.spark_partition_id()).count().count() >= 4
    twice = spark.createDataFrame([("b", 3), ("a", 5), ("b", 1), ("c", 1), ("c", 1)], "key string, t long")
    assert {(r.key, r.n) for r in temporal.dense_ids(twice, ["key"], ["t"], "n").collect()} == {("b", 0), ("c", 1), ("a", 2)}
    assert temporal.numbered(twice.limit(0), ["t"], "n").count() == 0


@pytest.mark.parametrize("slices", [1, 6, 40])
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_across_slices(spark, slices, ahead):
    rng = random.Random(slices)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(300), None]), i, rng.choice([None, f"v{i}"])) for i in range(400)]
    got = temporal.neighbour(spark.createDataFrame(rows, "k long, t long, i long, v string"), "k", ["t", "i"], F.col("v"), "near", ahead, slices).collect()
    for r in got:
        own = sorted((t is not None, t or 0, i, v) for k, t, i, v in rows if k == r.k and v is not None)
        mine = (r.t is not None, r.t or 0, r.i)
        near = [v for *at, v in own if tuple(at) > mine][:1] if ahead else [v for *at, v in own if tuple(at) < mine][-1:]
        assert r.near == (near[0] if near else None), r
    assert len(got) == 400


def test_histories_of_one_key_are_many_groups(spark):
    rows = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") / 5000).cast("long").alias("p"))
    found = temporal.history(rows, "k", ["t"], "p")
    assert [r.t for r in found.orderBy("t").collect()] == [0, 5000, 10000, 15000] and found.columns == ["k", "t", "p"]
    ends = temporal.close_intervals(found.withColumn("e", F.lit(None).cast("long")), "k", "t", "e").orderBy("t").collect()
    assert [r.e for r in ends] == [5000, 10000, 15000, None]
    assert "__slice" in found._jdf.queryExecution().toString()
