"""Known inputs and results of the operators that bring events together."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberstack.operators import lifetimes, stacks, switches, symbols


def _rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_process_intervals(spark):
    events = [(1, 10, "start", 123, "a.exe"), (2, 15, "start", 456, "b.exe"), (3, 17, "end", 789, None), (4, 20, "end", 456, None), (5, 35, "start", 456, "d.exe"), (6, 45, "end", 456, None)]
    found = lifetimes.intervals(spark.createDataFrame(events, "seq long, ts long, kind string, pid long, name string"), "pid", ["name"])
    assert _rows(found, "pid", "start_ts", "end_ts", "name") == {(123, 10, None, "a.exe"), (456, 15, 20, "b.exe"), (456, 35, 45, "d.exe")}


def test_thread_intervals_and_their_process(spark):
    events = [(1, 10, "start", 111, 123), (2, 10, "start", 111, 123), (3, 15, "start", 222, 456), (4, 16, "end", 222, 456), (5, 40, "start", 333, 456), (6, 45, "start", 222, 123), (7, 50, "end", 444, 123)]
    threads = lifetimes.intervals(spark.createDataFrame(events, "seq long, ts long, kind string, tid long, pid long"), "tid", ["pid"])
    assert _rows(threads, "tid", "start_ts", "end_ts", "pid") == {(111, 10, None, 123), (222, 15, 16, 456), (222, 45, None, 123), (333, 40, None, 456)}
    processes = spark.createDataFrame([(123, 10), (456, 15), (456, 35)], "pid long, start_ts long")
    assert _rows(lifetimes.with_process(threads, processes), "tid", "start_ts", "process_start") == {(111, 10, 10), (222, 15, 15), (222, 45, 10), (333, 40, 35)}


def test_a_start_of_the_same_thread_and_process_is_the_same_entry(spark):
    events = [(1, 10, "start", 7, 1), (2, 15, "end", 7, 1), (3, 20, "start", 7, 1)]
    threads = lifetimes.intervals(spark.createDataFrame(events, "seq long, ts long, kind string, tid long, pid long"), "tid", ["pid"])
    assert _rows(threads, "start_ts", "end_ts") == {(10, 15)}


def test_targets(spark):
    processes = [(123, 10, 0, "a"), (456, 20, 123, "b"), (891, 22, 123, "c"), (910, 23, 891, "d"), (789, 21, 5, "e"), (950, 24, 891, "conhost.exe")]
    processes = spark.createDataFrame(processes, "pid long, start_ts long, ppid long, name string")
    marked = spark.createDataFrame([(123, 15)], "pid long, ts long")
    sampled = spark.createDataFrame([(789, 21)], "pid long, start_ts long")
    assert _rows(lifetimes.targets(processes, marked, sampled), "pid", "start_ts") == {(123, 10), (456, 20), (891, 22), (910, 23)}
    assert _rows(lifetimes.targets(processes, marked.where("false"), sampled), "pid", "start_ts") == {(789, 21)}


def test_sampled_processes(spark):
    threads = spark.createDataFrame([(1, 9, 5, 0, 20), (1, 8, 6, 30, None), (2, 7, 6, 0, 5)], "tid long, pid long, process_start long, start_ts long, end_ts long")
    samples = spark.createDataFrame([(1, 10), (1, 25), (2, 6)], "tid long, ts long")
    assert _rows(lifetimes.sampled_processes(threads, samples), "pid") == {(9,)}


def test_context_switches(spark):
    rows = [(1, 12, 0, 111, []), (3, 15, 111, 222, [100, 200]), (4, 16, 222, 111, [110, 220]), (6, 21, 111, 222, [120, 240]), (7, 22, 222, 111, [130, 260]), (8, 23, 111, 222, [140, 280]), (10, 30, 222, 0, [150, 300]), (12, 37, 0, 111, [160, 310]), (13, 37, 111, 0, [200, 400])]
    cs = spark.createDataFrame(rows, "seq long, ts long, old_tid long, new_tid long, pmc array<long>")
    marks = spark.createDataFrame([(2, 14, 111), (5, 20, 222), (9, 25, 111), (11, 35, 111)], "seq long, ts long, tid long")
    threads = spark.createDataFrame([(1, 111, 14), (2, 111, 35), (3, 222, 20)], "thread_key long, tid long, start_ts long")
    found = switches.per_thread(cs, marks, threads)
    assert {r.thread_key: (r.context_switches, r.pmc) for r in found.collect()} == {1: (3, [20, 40]), 2: (1, [40, 90]), 3: (3, [30, 60])}
    owned = found.withColumn("process_key", F.when(F.col("thread_key") == 2, 8).otherwise(9))
    assert {r.process_key: (r.context_switches, r.pmc) for r in switches.per_process(owned).collect()} == {8: (1, [40, 90]), 9: (6, [50, 100])}


KERNEL = -(2**47)


def test_direct_stacks(spark):
    samples = spark.createDataFrame([(1, 0, 111, 10, 1), (2, 0, 111, 20, 4), (3, 11, 111, 10, 2)], "sample_id long, source_id long, tid long, ts long, seq long")
    rows = [(3, 11, 10, 111, [1, 2]), (5, 21, 20, 111, [5]), (6, 12, 10, 111, [3, KERNEL]), (7, 12, 10, 222, [4]), (8, 12, 15, 111, [4]), (9, 22, 10, 111, [])]
    found = stacks.direct(samples, spark.createDataFrame(rows, "seq long, ts long, event_ts long, tid long, ips array<long>"))
    whole = {r.sample_id: (r.user_ips, r.kernel_ips) for r in stacks.attached(samples, found).collect()}
    assert whole == {1: ([1, 2], [3, KERNEL]), 2: ([5], None), 3: ([1, 2], [3, KERNEL])}
    ips = [r.ip for r in stacks.addresses(stacks.attached(samples, found)).where("sample_id = 1").orderBy("depth").collect()]
    assert ips == [2, 1, KERNEL, 3]


def test_keyed_stacks_whose_key_is_used_again(spark):
    samples = spark.createDataFrame([(1, 0, 1, 10, 1), (2, 0, 1, 20, 5)], "sample_id long, source_id long, tid long, ts long, seq long")
    keys = spark.createDataFrame([(2, 10, 10, 1, 2, False), (3, 10, 10, 1, 9, True), (6, 20, 20, 1, 2, False)], "seq long, ts long, event_ts long, tid long, key long, is_kernel boolean")
    bodies = spark.createDataFrame([(4, 2, [7]), (7, 2, [8]), (8, 9, [KERNEL]), (9, 2, [6])], "seq long, key long, ips array<long>")
    whole = stacks.attached(samples, stacks.keyed(samples, keys, bodies))
    assert {r.sample_id: (r.user_ips, r.kernel_ips) for r in whole.collect()} == {1: ([7], [KERNEL]), 2: ([8], None)}
    assert all(r.user_ips is None for r in stacks.attached(samples).collect())


def test_counter_samples_hide_timer_samples(spark):
    timer = spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "sample_id long, source_id long, tid long")
    counted = spark.createDataFrame([(3, 0, 1), (4, 11, 1)], "sample_id long, source_id long, tid long")
    assert _rows(stacks.of_source(timer, counted, 0), "sample_id") == {(2,), (3,)}
    assert _rows(stacks.of_source(timer, counted, 11), "sample_id") == {(4,)}


def test_equal_stacks(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [2, 1]), (3, [1, 2]), (4, [1])], "sample_id long, ips array<long>")
    assert {(tuple(r.ips), r.n, r.first_sample) for r in stacks.distinct_stacks(rows).collect()} == {((1, 2), 2, 1), ((2, 1), 1, 2), ((1,), 1, 4)}


def test_debug_info(spark):
    images = spark.createDataFrame([(1, 5, 100, "a"), (1, 5, 200, "b")], "pid long, ts long, base long, name string")
    infos = spark.createDataFrame([(1, 1, 5, 100, "old.pdb", "x"), (2, 1, 5, 100, "a.pdb", "y"), (3, 1, 6, 200, "b.pdb", "z")], "seq long, pid long, ts long, base long, debug_file string, signature string")
    assert _rows(stacks.with_debug_info(images, infos), "name", "debug_file") == {("a", "a.pdb"), ("b", None)}


def test_symbols(spark):
    functions = spark.createDataFrame([("m", 0, 100, "f", "a.c", 3), ("m", 4000, 9000, "g", None, None)], "module string, rel_begin long, rel_end long, symbol string, file string, func_line long")
    lines = spark.createDataFrame([("m", 0, 50, 4), ("m", 50, 100, 5)], "module string, rel_begin long, rel_end long, instr_line long")
    addresses = spark.createDataFrame([("m", 0, 16), ("m", 99, 17), ("m", 100, 18), ("m", 8999, 19), ("n", 1, -1)], "module string, rel long, ip long")
    found = _rows(symbols.resolved(addresses, functions, lines), "symbol", "file", "instr_line")
    assert found == {("f", "a.c", 4), ("f", "a.c", 5), ("m!0x0000000000000012", None, None), ("g", None, None), ("n!0xffffffffffffffff", None, None)}


def test_volumes_and_device_paths(spark):
    parts = spark.createDataFrame([(1, 1, "C:"), (2, 1, "E:"), (2, 2, "F:")], "disk long, partition long, drive string")
    assert _rows(symbols.volumes(parts), "drive", "volume") == {("C:", 1), ("E:", 2), ("F:", 3)}
    devices = {"\\Device\\HarddiskVolume1": "C:", "\\Device\\HarddiskVolume10": "D:"}
    paths = {r"\Device\HarddiskVolume1\a": r"C:\a", r"\Device\HarddiskVolume10\a": r"D:\a", r"\Device\HarddiskVolume2\a": r"\Device\HarddiskVolume2\a", r"\SystemRoot\x": r"C:\WINDOWS\x"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.out for r in df.withColumn("out", symbols.local_path(F.col("path"), devices, "C:\\WINDOWS\\")).collect()} == paths


def test_source_names_and_build_ids(spark):
    described = spark.createDataFrame([(0, "cycles", [1, 2]), (1, "misses", [3])], "place long, name string, ids array<long>")
    ids = spark.createDataFrame([(2,), (3,), (9,), (None,)], "event_id long")
    assert _rows(symbols.source_names(ids, described), "event_id", "name") == {(2, "cycles"), (3, "misses"), (9, "unknown event 9"), (None, "cycles")}
    modules = spark.createDataFrame([("a", None), ("b", "x")], "filename string, build_id string")
    assert _rows(symbols.build_ids(modules, spark.createDataFrame([("a", "y"), ("b", "z")], "filename string, build_id string")), "filename", "build_id") == {("a", "y"), ("b", "x")}
