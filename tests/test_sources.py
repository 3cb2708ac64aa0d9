"""Readers over files written here, streams over files, and the recording's questions."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from emberstack.operators import filters, hits
from emberstack.recording import Recording
from emberstack.sources import open as opener
from emberstack.sources import perf_data as perf
from emberstack.streaming import live

KIND = perf.IDENTIFIER | perf.IP | perf.TID | perf.TIME | perf.PERIOD | perf.CALLCHAIN


def _record(kind: int, body: bytes, order: str, misc: int = 0) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack(order + "IHH", kind, misc, len(body) + 8) + body


def _file(order: str) -> bytes:
    def pack(form, *values):
        return struct.pack(order + form, *values)

    def trailer(ts, event=11):
        return pack("2iqq", 1, 1, ts, event)

    attr = [pack("2I5Q", 0, 48, config, 1, KIND, 0, perf.SAMPLE_ID_ALL) for config in (0, 3)]
    data = _record(perf.COMM, pack("2i", 5, 6) + b"worker\0\0" + trailer(7), order)
    data += _record(perf.MMAP2, pack("2i3q", 5, 6, 4096, 8192, 16) + bytes([20, 0, 0, 0]) + bytes(range(20)) + pack("2I", 5, 2) + b"/lib/a.so\0".ljust(16, b"\0") + trailer(8), order, perf.BUILD_ID)
    data += _record(perf.FORK, pack("4iq", 9, 5, 10, 6, 12) + trailer(12), order)
    data += _record(68, b"", order)
    for event, ip, ts, chain in ((11, 5000, 20, [-512, 5000, 6000]), (22, -8, 21, [])):
        data += _record(perf.SAMPLE, pack("qq2iqq", event, ip, 5, 6, ts, 100) + pack("Q", len(chain)) + pack(f"{len(chain)}q", *chain), order)

    def text(s):
        return pack("I", len(s) + 1) + s.encode() + b"\0"

    desc = pack("2I", 2, 48) + b"".join(a + pack("I", 1) + text(n) + pack("q", i) for a, n, i in zip(attr, ("cycles", "misses"), (11, 22)))
    found = [(3, text("box")), (11, pack("I", 2) + text("perf") + text("record")), (perf.EVENT_DESC, desc)]
    at = 104 + len(data) + 16 * len(found)
    table, bodies = b"", b""
    for _, body in found:
        table += pack("2Q", at + len(bodies), len(body))
        bodies += body
    magic = b"PERFILE2" if order == "<" else b"2ELIFREP"
    return magic + pack("8Q", 104, 48, 0, 0, 104, len(data), 0, 0) + pack("4Q", sum(1 << n for n, _ in found), 0, 0, 0) + data + table + bodies


@pytest.mark.parametrize("order", ["<", ">"])
def test_perf_data(spark, tmp_path, order):
    (tmp_path / "a.data").write_bytes(_file(order))
    path = str(tmp_path)
    rows = {r.seq: r for r in perf.events(spark, path).collect()}
    assert [rows[i].kind for i in sorted(rows)] == ["comm", "mmap2", "fork", "sample", "sample"]
    assert (rows[0].pid, rows[0].tid, rows[0].name, rows[0].ts) == (5, 6, "worker", 7)
    assert (rows[1].addr, rows[1].len, rows[1].page_offset, rows[1].build_id, rows[1].name) == (4096, 8192, 16, bytes(range(20)).hex(), "/lib/a.so")
    assert (rows[2].pid, rows[2].ppid, rows[2].tid, rows[2].ts) == (9, 5, 10, 12)
    found = {r.event_id: (r.ip, r.ts, r.ips) for r in perf.samples(perf.events(spark, path)).collect()}
    assert found == {11: (5000, 20, [5000, 6000]), 22: (-8, 21, [])}
    assert {(r.place, r.name, r.config, tuple(r.ids)) for r in perf.attributes(spark, path).collect()} == {(0, "cycles", 0, (11,)), (1, "misses", 3, (22,))}
    assert {r.key: r.value for r in perf.metadata(spark, path).collect()} == {"hostname": "box", "command_line": "perf record"}
    assert perf.modules(perf.events(spark, path)).first().filename == "/lib/a.so"


def test_no_perf_data(spark, tmp_path):
    (tmp_path / "a.data").write_bytes(b"x" * 200)
    with pytest.raises(Exception, match="not a perf.data file"):
        perf.events(spark, str(tmp_path)).collect()


def _run(df, name: str, mode: str):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 10.0, 0), (1, 2, 14.0, 5), (1, 3, 3.0, 70), (2, 1, 1.0, 71)], "key long, seq long, value double, at long")
    rows.withColumn("time", F.timestamp_seconds("at")).withColumn("source_id", F.col("key")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = _run(live.deltas(stream.select("key", "seq", "value")), "deltas", "append")
    assert {(r.key, r.seq): r.delta for r in found} == {(1, 1): None, (1, 2): 4.0, (1, 3): 3.0, (2, 1): None}
    found = _run(live.samples_by_window(stream, "1 minute", "1 minute"), "windows", "complete")
    assert sorted((r.start.minute, r.source_id, r.n) for r in found) == [(0, 1, 2), (1, 1, 1), (1, 2, 1)]


def test_recording(spark):
    samples = spark.createDataFrame([(1, 0, 10, 1, 5), (2, 0, 20, 1, 6), (3, 0, 30, 1, 6), (4, 0, 40, 2, 7)], "sample_id long, source_id long, ts long, process_id long, thread_id long")
    frames = [(1, 1, "m", "f", "a", 1, 2), (1, 2, "m", "g", "a", 5, 6), (2, 1, "m", "f", "a", 1, 3), (4, 1, "m", "h", None, None, None)]
    frames = hits.with_leaf(spark.createDataFrame(frames, "sample_id long, depth long, module string, symbol string, file string, func_line long, instr_line long"))
    r = Recording(samples, frames, spark.createDataFrame([(1, "p"), (2, "q")], "process_id long, name string"), spark.createDataFrame([(5, 1, 3, [1]), (6, 1, 4, [2, 2]), (7, 2, 1, None)], "thread_id long, process_id long, context_switches long, pmc array<long>"))
    top = r.hottest_functions(2, 0).collect()
    assert [(x.symbol, x.total, x.self, x.self_percent) for x in top] == [("f", 2, 1, 25.0), ("g", 1, 1, 25.0)]
    assert [x.symbol for x in r.functions_page(1, 0, "name", 1, 1).collect()] == ["g"]
    assert [x.path for x in r.hot_path(0, 1).collect()] == ["m!f"]
    assert {x.callee: x.total for x in r.callees("m", "f", 0, 1, 5).collect()} == {"m!g": 1}
    assert {x.caller: x.total for x in r.callers("m", "f", 0, 1, 5).collect()} == {"[root]": 2}
    assert {(x.instr_line, x.total, x.self) for x in r.line_info("m", "f", 1).collect()} == {(2, 1, 0), (3, 1, 1)}
    assert r.line_info("m", "h", 2).count() == 0
    assert {x.name: (x.context_switches, x.pmc, len(x.threads)) for x in r.process_list().collect()} == {"p": (7, [3, 2], 2), "q": (1, None, 1)}
    none = r.filtered(filters.SampleFilter(excluded_processes=(1,)))
    assert none.hottest_functions(5, 0).count() == 1
    assert {(x.thread_id, x.n) for x in none.process_sample_info(1).collect()} == {(5, 1), (6, 2)}
    assert r.session_info().first().samples == 4


def test_a_file_is_a_recording(spark, tmp_path):
    (tmp_path / "a.data").write_bytes(_file("<"))
    functions = spark.createDataFrame([("/lib/a.so", 900, 1000, "work", "a.cpp", 3)], opener.FUNCTIONS)
    r = opener.open_recording(spark, str(tmp_path / "a.data"), str(tmp_path / "store"), functions)
    assert {(x.sample_id, x.source_id, x.ts) for x in r.samples.collect()} == {(4, 0, 20), (5, 1, 21)}
    assert [(x.depth, x.module, x.symbol, x.file, x.is_leaf) for x in r.stack_frames.orderBy("depth").collect()] == [
        (1, "/lib/a.so", "a.so!0x0000000000001770", None, False), (2, "/lib/a.so", "work", "a.cpp", True)]
    with pytest.raises(ValueError, match="unsupported file extension"):
        opener.open_recording(spark, "x.unknown", str(tmp_path / "other"))
    (tmp_path / "many.data").mkdir()
    for name in ("a.data", "b.data"):
        (tmp_path / "many.data" / name).write_bytes(_file("<"))
    with pytest.raises(ValueError, match="2 recordings"):
        opener.open_recording(spark, str(tmp_path / "many.data"), str(tmp_path / "other"))
    events = spark.read.parquet(str(tmp_path / "store/events"))
    assert {(x.kind, x.n) for x in opener.counts(events).collect()} == {("comm", 1), ("mmap2", 1), ("fork", 1), ("sample", 2)}
    assert {(x.event_id, x.n, x.first_ts, x.last_ts) for x in opener.counts_by_event(events).collect()} == {(11, 1, 20, 20), (22, 1, 21, 21)}


def test_names_and_forks(spark):
    rows = [("comm", 0, 123, 123, "perf-exec"), ("comm", 10, 123, 123, "proc-a"), ("comm", 15, 456, 456, "proc-b"), ("fork", 15, 456, 456, None), ("fork", 20, 456, 111, None), ("fork", 25, 123, 222, None), ("comm", 25, 123, 222, "thread-222")]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, kind string, ts long, pid long, tid long, name string")
    p = opener.processes(events)
    of = {x.process_id: (x.pid, x.name, x.start_ts, x.end_ts) for x in p.collect()}
    assert list(of) == [2**32, 2**32 + 1, 2**32 + 2] and set(of.values()) == {(123, "perf-exec", 0, 10), (123, "proc-a", 10, None), (456, "proc-b", 15, None)}
    found = {(x.tid, x.name, x.start_ts, x.end_ts, of[x.process_id][1]) for x in opener.threads(events, p).collect()}
    assert found == {(123, "perf-exec", 0, 10, "perf-exec"), (123, "proc-a", 10, None, "proc-a"), (456, "proc-b", 15, None, "proc-b"), (111, None, 20, None, "proc-b"), (222, "thread-222", 25, None, "proc-a")}
