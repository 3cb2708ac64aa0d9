"""The dictionary of stacks against frames by sample: every question of a recording gives the same, and frames are stored once."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from emberstack.operators import calltree, dictionary, filters, hits
from emberstack.recording import Recording
from emberstack.sources import open as opener
from emberstack.sources import perf_data as perf
from emberstack.tables import saved
from test_ranges import _head, _record, _sample

FRAMES = "sample_id long, depth long, module string, symbol string, file string, func_line long, instr_line long"


@pytest.fixture(scope="module")
def both(spark):
    """A recording with frames by sample, and the same over a dictionary."""
    rng = random.Random(1)
    stacks = [[(rng.choice("mn"), rng.choice("fgh")) for _ in range(rng.randrange(1, 6))] for _ in range(12)] + [[]]
    samples, frames = [], []
    for i in range(300):
        samples.append((i, rng.randrange(2), 10 * rng.randrange(100), 1 + i % 2, 5 + i % 4))
        for d, (m, f) in enumerate(rng.choice(stacks), 1):
            frames.append((i, d, m, f, None if f == "h" else f"{f}.c", ord(f), ord(f) + d))
    samples = spark.createDataFrame(samples, "sample_id long, source_id long, ts long, process_id long, thread_id long")
    frames = saved(hits.with_leaf(spark.createDataFrame(frames, FRAMES)))
    processes, threads = spark.createDataFrame([(1, "p"), (2, "q")], "process_id long, name string"), spark.createDataFrame([(5 + k, 1 + k % 2) for k in range(4)], "thread_id long, process_id long")
    frame = F.struct("depth", "module", "symbol", "file", "func_line", "instr_line", "is_leaf")
    stack = frames.groupBy(F.col("sample_id").alias("of")).agg(F.array_sort(F.collect_list(frame)).alias("stack"))
    named, distinct = dictionary.interned(samples.join(stack, F.col("sample_id") == F.col("of"), "left").drop("of"), ["stack"])
    shared = distinct.select("stack_id", F.explode("stack").alias("f")).select("stack_id", "f.*")
    return Recording(samples, frames, processes, threads), Recording(saved(named), saved(shared), processes, threads)


def _same(a, b):
    assert a.columns == b.columns
    x, y = (sorted(map(str, map(tuple, df.collect()))) for df in (a, b))
    assert x == y and x


@pytest.mark.parametrize("f", [filters.SampleFilter(), filters.SampleFilter(200, 700), filters.SampleFilter(excluded_processes=(2,), excluded_threads=(5,))])
def test_every_question_gives_the_same(both, f):
    one, other = (r.filtered(f) for r in both)
    for ask in (
        lambda r: r.hottest_functions(4, 0), lambda r: r.functions_page(1, 1, "total", 5, 0, True), lambda r: r.call_tree(0, 1), lambda r: r.hot_path(0, 1), lambda r: r.hot_tree(1, 1),
        lambda r: r.expand(0, 1), lambda r: r.callers_and_callees("m", "f", 0, 1, 3), lambda r: r.callers("m", "f", 0, 1, 2), lambda r: r.callees("n", "g", 0, 1, 3), lambda r: r.line_info("m", "f", 1),
    ):
        _same(ask(one), ask(other))


def test_weighted_frames_against_frames_by_sample(both):
    one, other = both
    plain = one.stack_frames.join(one.samples, "sample_id")
    _same(hits.function_hits(plain), hits.function_hits(other._weighted(), "n").select("source_id", "module", "symbol", "total", "self"))
    _same(hits.file_hits(plain), hits.file_hits(other._weighted(), "n"))
    _same(hits.function_edges(plain), dictionary.edges(other.frames, other._weights()))
    _same(hits.function_attribution(plain), hits.function_attribution(other._weighted()))
    tree = calltree.nodes(other.frames, ("source_id",), other._weights())
    _same(calltree.nodes(plain, ("source_id",)), tree)


def test_frames_are_stored_once_for_each_distinct_stack(both):
    one, other = both
    assert other.frames.select("stack_id").distinct().count() == 12
    assert other.frames.count() < one.frames.count() / 10
    assert other.stack_frames.count() == one.frames.count()
    assert other.samples.where("stack_id is null").count() == one.samples.join(one.frames, "stack_id", "left_anti").count() > 0


def test_a_recording_of_few_stacks(spark, tmp_path):
    """Two stacks in 300 samples of three threads."""
    trailer = lambda ts: struct.pack("<2iqq", 5, 5, ts, 11)
    data = _record(perf.COMM, struct.pack("<2i", 5, 5) + b"app".ljust(8, b"\0") + trailer(1))
    data += b"".join(_record(perf.FORK, struct.pack("<4iq", 5, 5, tid, 5, 2) + trailer(2)) for tid in (6, 7, 8))
    data += _record(perf.MMAP2, struct.pack("<2i3q", 5, 5, 4096, 4096, 0) + b"\0" * 24 + struct.pack("<2I", 5, 2) + b"/a.so".ljust(8, b"\0") + trailer(3))
    data += b"".join(_sample(i, [5000, 4100] if i % 2 else [5000]) for i in range(300))
    (tmp_path / "a.data").write_bytes(_head(len(data), perf.SAMPLE_ID_ALL) + data)
    r = opener.open_recording(spark, str(tmp_path / "a.data"), str(tmp_path / "store"))
    assert r.samples.count() == 300 == r.samples.where("stack_id is not null").count()
    assert r.frames.count() == 3 and r.stack_frames.count() == 450
    process = r.samples.first().process_id
    assert {(x.symbol, x.total, x.self) for x in r.hottest_functions(5, 0).collect()} == {("a.so!0x0000000000001388", 300, 300), ("a.so!0x0000000000001004", 150, 0)}
    assert sorted(x.total for x in r.call_tree(0, process).collect()) == [150, 150, 150]


def test_equal_addresses_in_different_epochs_are_different_stacks(spark):
    events = [("comm", 0, 5, 6, "app", None, None, None, None), ("mmap2", 0, 5, 6, "/a.so", 4096, 4096, None, None)]
    events += [("sample", t, 5, 6, None, None, None, 5000, [5000]) for t in (10, 20)] + [("mmap2", 30, 5, 6, "/b.so", 4096, 4096, None, None)] + [("sample", t, 5, 6, None, None, None, 5000, [5000]) for t in (40, 50, 60)]
    schema = "kind string, ts long, pid long, tid long, name string, addr long, len long, ip long, ips array<long>"
    rows = spark.createDataFrame(events, schema).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    rows = rows.withColumns({"path": F.lit("x"), "ppid": F.lit(None).cast("long"), "event_id": F.lit(1).cast("long"), "page_offset": F.lit(0).cast("long"), "build_id": F.lit(None).cast("string")})
    attributes = spark.createDataFrame([("x", 0, "cycles", 0, 0, [1])], perf.ATTRIBUTES)
    r = opener.perf_recording(saved(rows), attributes)
    assert {(x.module, x.total) for x in hits.module_hits(r._weighted(), "n").collect()} == {("/a.so", 2), ("/b.so", 3)}
    assert r.frames.count() == 2


@pytest.fixture(scope="module")
def sliced(both):
    return dictionary.SlicedHits(both[1].samples, both[1].frames, 100)


@pytest.mark.parametrize("seed", range(4))
def test_random_filters_of_sliced_hits(both, sliced, seed):
    rng = random.Random(seed)
    for _ in range(3):
        low, high = sorted(rng.randrange(-50, 1100) for _ in range(2))
        f = filters.SampleFilter(rng.choice([None, low, low // 100 * 100]), rng.choice([None, high, high // 100 * 100 + 99]), tuple(rng.sample([1, 2], rng.randrange(2))), tuple(rng.sample([5, 6, 7, 8], rng.randrange(3))))
        rows = filters.filtered(both[1].samples, f)
        want = hits.function_hits(dictionary.weighted(both[1].frames, dictionary.weights(rows)), "n")
        text = lambda df: sorted(map(str, df.select("source_id", "module", "symbol", "total", "self").collect()))
        assert text(sliced.function_hits(f)) == text(want)


def test_whole_slices_read_no_frames(both, sliced):
    plan = lambda f: sliced.function_hits(f)._jdf.queryExecution().optimizedPlan().toString()
    inner = plan(filters.SampleFilter(100, 899, (2,)))
    assert "stack_id" not in inner and "depth" not in inner and "Join" not in inner
    cut = plan(filters.SampleFilter(150, 899))
    assert "Join" in cut and "ts" in cut


def test_pages_by_place(spark):
    rng = random.Random(2)
    rows = [(rng.choice("mno"), f"f{i}", rng.randrange(9), rng.randrange(5)) for i in range(95)]
    df = spark.createDataFrame(rows, "module string, symbol string, total long, self long")
    from emberstack.recording import SORTS

    pages = dictionary.SortedPages(df, SORTS)
    for name, order in SORTS.items():
        keyed = sorted(rows, key=lambda r: tuple(dict(zip(df.columns, r))[c] for c in order))
        for index in (0, 3, 9, 10):
            assert [tuple(r) for r in pages.page(name, 10, index).collect()] == keyed[10 * index : 10 * index + 10]
            assert [tuple(r) for r in pages.page(name, 10, index, True).collect()] == keyed[::-1][10 * index : 10 * index + 10]
