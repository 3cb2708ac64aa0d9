"""Answers as JSON and as text."""

from __future__ import annotations

import json

from emberstack import results
from emberstack.operators import filters, hits
from emberstack.recording import Recording


def _recording(spark, **more):
    samples = spark.createDataFrame([(1, 0, 10, 1, 5), (2, 0, 20, 1, 6), (3, 1, 30, 1, 6), (4, 0, 40, 2, 7)], "sample_id long, source_id long, ts long, process_id long, thread_id long")
    frames = [(1, 1, "m", "f", "a", 1, 2), (1, 2, "m", "g", "", 5, 6), (2, 1, "m", "f", "a", 1, 3), (4, 1, "k", "f", None, None, None)]
    frames = hits.with_leaf(spark.createDataFrame(frames, "sample_id long, depth long, module string, symbol string, file string, func_line long, instr_line long"))
    processes = spark.createDataFrame([(1, 11, "p", 0, 50), (2, 12, None, 5, None), (3, 13, "idle", 1, 2)], "process_id long, pid long, name string, start_ts long, end_ts long")
    threads = spark.createDataFrame([(5, 1, 21, 'the "first"', 3, [1]), (6, 1, 22, None, 4, None), (7, 2, 23, "t", 1, None)], "thread_id long, process_id long, tid long, name string, context_switches long, pmc array<long>")
    return Recording(samples, frames, processes, threads, **more)


def test_process_report(spark):
    found = {r.process_id: r for r in _recording(spark).process_report().collect()}
    assert {k: ([(s.source_id, s.n) for s in r.samples], r.n_modules, r.n_functions, r.n_files) for k, r in found.items()} == {
        1: ([(0, 2), (1, 1)], 1, 2, 1), 2: ([(0, 1), (1, 0)], 1, 1, 0), 3: ([(0, 0), (1, 0)], 0, 0, 0)}
    assert {t.tid: [s.n for s in t.samples] for r in found.values() for t in r.threads or []} == {21: [1, 0], 22: [1, 1], 23: [1, 0]}
    some = _recording(spark).filtered(filters.SampleFilter(excluded_threads=(5,))).process_report()
    assert {r.process_id: ([s.n for s in r.samples], r.n_functions) for r in some.collect()} == {1: ([1, 1], 1), 2: ([1, 0], 1), 3: ([0, 0], 0)}


def test_json(spark, tmp_path):
    results.write_json(results.about(_recording(spark)), str(tmp_path))
    rows = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "processes")).collect()), key=lambda r: r["process_id"])
    assert [r["name"] for r in rows] == ["p", None, "idle"] and rows[2]["threads"] is None and "end_ts" in rows[1]
    assert sorted(t["name"] or "" for t in rows[0]["threads"]) == ["", 'the "first"'] and rows[0]["samples"][0] == {"source_id": 0, "source": None, "n": 2}
    assert json.loads(spark.read.text(str(tmp_path / "session")).first().value)["samples"] == 4
    assert spark.read.text(str(tmp_path / "system")).count() == 0


def test_summary(spark, tmp_path):
    names = spark.createDataFrame([(0, "cycles", True), (1, "misses", False)], "source_id long, name string, has_stacks boolean")
    system = spark.createDataFrame([("box", "Linux", "x86_64", "cpu", 8)], "hostname string, platform string, architecture string, cpu_name string, n_processors int")
    session = spark.createDataFrame([("run it", None, 30)], "command_line string, date timestamp, runtime_ns long")
    text = results.summary(_recording(spark, source_names=names, system=system, session=session)).select("text")
    text.write.text(str(tmp_path / "out"))
    lines = [r.text for r in text.collect()]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines)
    shown = [" ".join(x.split()) for x in lines]
    assert shown[:3] == ["Session", "Command line: run it", "Runtime (ns): 30"] and "Date" not in " ".join(shown)
    assert shown[shown.index("System") :][:3] == ["System", "Hostname: box", "Platform: Linux"]
    assert shown[shown.index("Source cycles") :][:3] == ["Source cycles", "Id: 0", "Samples: 3"]
    assert shown[shown.index("Process 11 p") :] == [
        "Process 11 p", "Start: 0", "End: 50", "Context switches: 7", "cycles: 2", "misses: 1", "Modules: 1", "Functions: 2", "Files: 1",
        'Thread 21 the "first"', "Context switches: 3", "cycles: 1", "misses: 0", "Thread 22", "Context switches: 4", "cycles: 1", "misses: 1",
        "Process 12", "Start: 5", "Context switches: 1", "cycles: 1", "misses: 0", "Modules: 1", "Functions: 1", "Files: 0", "Thread 23 t", "Context switches: 1", "cycles: 1", "misses: 0",
        "Process 13 idle", "Start: 1", "End: 2", "cycles: 0", "misses: 0", "Modules: 0", "Functions: 0", "Files: 0"]
