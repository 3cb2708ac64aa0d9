"""Records of the recording tool, checks of attributes, and rounds against a recorder's own way of giving records out."""

from __future__ import annotations

import heapq
import random
import struct

import pytest

from emberstack.operators import rounds, symbols
from emberstack.sources import perf_data as perf

KIND = perf.IDENTIFIER | perf.IP | perf.TID | perf.TIME


def _record(kind: int, body: bytes, order: str = "<", misc: int = 0) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack(order + "IHH", kind, misc, len(body) + 8) + body


def _sample(ts: int, event: int = 11, order: str = "<") -> bytes:
    return _record(perf.SAMPLE, struct.pack(order + "qq2iq", event, 7, 5, 6, ts), order)


def _file(data: bytes, order: str = "<", attributes=((KIND, 0, 0, 11),), features: bytes = b"") -> bytes:
    n = len(attributes)
    ids = 104 + 64 * n
    attrs = b"".join(struct.pack(order + "2I5Q", 0, 48, 0, 1, kind, form, flags) + struct.pack(order + "2Q", ids + 8 * i, 8) for i, (kind, form, flags, _) in enumerate(attributes))
    attrs += b"".join(struct.pack(order + "q", event) for *_, event in attributes)
    begin = 104 + len(attrs)
    table = struct.pack(order + "2Q", begin + len(data) + 16, len(features)) if features else b""
    magic = b"PERFILE2" if order == "<" else b"2ELIFREP"
    words = struct.pack(order + "4Q", 1 << perf.BUILD_IDS if features else 0, 0, 0, 0)
    return magic + struct.pack(order + "8Q", 104, 64, 104, 64 * n, begin, len(data), 0, 0) + words + attrs + data + table + features


@pytest.mark.parametrize("order", ["<", ">"])
def test_tool_records(spark, tmp_path, order):
    def pack(form, *values):
        return struct.pack(order + form, *values)

    data = b"".join([
        _record(perf.ID_INDEX, pack("Q8q", 2, 11, 0, 3, -1, 22, 1, 4, 77), order),
        _record(perf.THREAD_MAP, pack("Qq16s", 1, 5, b"worker"), order),
        _record(perf.CPU_MAP, pack("2H3H", 0, 3, 2, 0xFFFF, 7), order),
        _record(perf.CPU_MAP, pack("3H2I", 1, 2, 4, 0b101, 1 << 31), order),
        _record(perf.CPU_MAP, pack("3H4x2Q", 1, 2, 8, 1, 1 << 63 | 2), order),
        _record(perf.CPU_MAP, pack("H2B2H", 2, 1, 0, 4, 6), order),
        _record(perf.CPU_MAP, pack("2H", 0, 0), order),
        _record(perf.FINISHED_INIT, b"", order), _sample(1, order=order), _record(perf.FINISHED_ROUND, b"", order)])
    ids = b"".join(_record(67, pack("i", -1) + bytes(range(20)) + bytes([n, 0, 0, 0]) + name.ljust(16, b"\0"), order, misc) for n, name, misc in ((0, b"/a.so\0", 0), (8, b"/b.so\0", perf.BUILD_ID_SIZE)))
    (tmp_path / "a.data").write_bytes(_file(data, order, features=ids))
    for size in (64, 1 << 20):
        rows = perf.tools(spark, str(tmp_path), size).orderBy("seq", "place").collect()
        of = lambda seq, *names: [tuple(r[n] for n in names) for r in rows if r.seq == seq]  # noqa: E731, B023
        assert of(0, "place", "id", "idx", "cpu", "tid") == [(0, 11, 0, 3, -1), (1, 22, 1, 4, 77)]
        assert of(1, "place", "tid", "name") == [(0, 5, "worker")]
        assert [[c for (c,) in of(i, "cpu")] for i in range(2, 7)] == [[2, -1, 7], [0, 2, 63], [0, 65, 127], [-1, 4, 5, 6], [None]]
        assert of(6, "kind", "place") == [("cpu_map", None)] and of(7, "kind") == [("finished_init",)] and of(8, "kind") == [] and of(9, "kind") == [("finished_round",)]
    assert perf.events(spark, str(tmp_path)).count() == 1
    listed = perf.build_ids(spark, str(tmp_path))
    assert {(r.pid, r.build_id, r.filename) for r in listed.collect()} == {(-1, bytes(range(20)).hex(), "/a.so"), (-1, bytes(range(8)).hex(), "/b.so")}
    modules = spark.createDataFrame([("/a.so", None), ("/b.so", "ff"), ("/c.so", None)], "filename string, build_id string")
    assert {r.filename: r.build_id for r in symbols.build_ids(modules, listed).collect()} == {"/a.so": bytes(range(20)).hex(), "/b.so": "ff", "/c.so": None}


@pytest.mark.parametrize("attributes, message", [
    ((), "no event attributes"),
    (((KIND | perf.READ, 0, 0, 11),), "read values without ids"),
    (((KIND, 0, 0, 11), (KIND - perf.IDENTIFIER + perf.ID, 0, 0, 22)), "place of the id"),
    (((perf.ID | perf.TID, 0, 0, 11), (perf.ID | perf.TID | perf.STREAM, 0, 0, 22)), "place of the id"),
    (((KIND, 0, perf.SAMPLE_ID_ALL, 11), (KIND, 0, 0, 22)), "sample_id_all"),
    (((KIND, 4, 0, 11), (KIND, 5, 0, 22)), "read_format")])
def test_attributes_that_do_not_fit(attributes, message):
    with pytest.raises(ValueError, match=message):
        perf.Recording(_file(_sample(1), attributes=attributes))


def test_a_record_is_read_by_the_attribute_of_its_own_id(spark, tmp_path):
    both = ((KIND, 0, perf.SAMPLE_ID_ALL, 11), (KIND | perf.STREAM | perf.CPU, 0, perf.SAMPLE_ID_ALL, 22))
    comm = struct.pack("<2i", 5, 6) + b"worker\0\0"
    data = _record(perf.COMM, comm + struct.pack("<2iqq", 1, 1, 7, 11)) + _record(perf.COMM, comm + struct.pack("<2iqq2Iq", 1, 1, 8, 99, 3, 0, 22)) + _record(perf.COMM, comm + struct.pack("<2iqq", 1, 1, 9, 0))
    (tmp_path / "a.data").write_bytes(_file(data, attributes=both))
    assert [(r.name, r.ts, r.cpu) for r in perf.events(spark, str(tmp_path)).orderBy("seq").collect()] == [("worker", 7, None), ("worker", 8, 3), ("worker", 9, None)]
    unknown = _file(_record(perf.COMM, comm + struct.pack("<2iqq", 1, 1, 7, 33)), attributes=both)
    with pytest.raises(ValueError, match="unknown event id 33"):
        list(perf.Recording(unknown).events())


def _given_out(rows: list[tuple], marks: set[int]) -> list[tuple]:
    """A recorder's queue: at a mark what is no newer than the newest of the rounds before it goes, at the end the rest. Gives
    (seq, round, slot) in the order given out."""
    queue, out, newest, limit, number = [], [], None, None, 0
    for seq in sorted({r[0] for r in rows} | marks):
        if seq in marks:
            while queue and limit is not None and queue[0][0] <= limit:
                ts, s, r = heapq.heappop(queue)
                out.append((s, r, number))
            limit, number = newest, number + 1
        else:
            ts = next(r[1] for r in rows if r[0] == seq)
            heapq.heappush(queue, (ts, seq, number))
            newest = ts if newest is None else max(newest, ts)
    # What is left goes as at the marks that would follow.
    while queue:
        while queue and limit is not None and queue[0][0] <= limit:
            ts, s, r = heapq.heappop(queue)
            out.append((s, r, number))
        limit, number = newest, number + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rounds_are_given_out_as_by_a_recorder(spark, seed):
    rng = random.Random(seed)
    rows, marks, seq = [], [], 0
    for path in ("a", "b", "c"):
        seq, base = 0, 0
        for _ in range(rng.choice([0, 1, 6, 12])):
            for _ in range(rng.randrange(12)):
                # Back into the round before at most, but for a broken promise in the odd seeds.
                rows.append((path, seq, base + rng.randrange(-90, 100) - (300 if seed % 2 and rng.random() < 0.1 else 0), rng.choice([11, 22, None])))
                seq += 1
            base += 100
            marks.append((path, seq))
            seq += 1
        rows.append((path, seq, base + 5, 11))
    records = spark.createDataFrame([(*r, "x") for r in rows], "path string, seq long, ts long, event_id long, round string")
    marked = spark.createDataFrame(marks + marks[:1], "path string, seq long")
    found = rounds.ordered(records, marked).collect()
    for path in ("a", "b", "c"):
        want = _given_out([r[1:] for r in rows if r[0] == path], {m for p, m in marks if p == path})
        got = [r for r in found if r.path == path]
        assert [(r.seq, r.round, r.slot) for r in got] == want
        high = None
        for slot in sorted({r.slot for r in got}):
            here = [r for r in got if r.slot == slot]
            assert all(r.late == (high is not None and r.ts < high) for r in here)
            high = max([r.ts for r in here] + ([] if high is None else [high]))
        if not any(r.late for r in got):
            assert [r.ts for r in got] == sorted(r.ts for r in got)
    numbers = {(r.path, r.seq): r.place for r in rounds.places(rounds.ordered(records, marked)).collect()}
    for path in ("a", "b", "c"):
        assert [numbers[path, r.seq] for r in found if r.path == path] == list(range(1, 1 + sum(r.path == path for r in found)))
    if seed % 2 == 0:
        assert not any(r.late for r in found)
    want = {}
    for r in found:
        want.setdefault((r.path, r.round, r.event_id), []).append(r.ts)
    got = {(r.path, r.round, r.event_id): (r.n, r.first_ts, r.last_ts) for r in rounds.counts(records, marked).collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}


def test_no_marks_no_times_no_records(spark):
    records = spark.createDataFrame([("a", 0, 5), ("a", 1, None), ("a", 2, 3)], "path string, seq long, ts long")
    none = spark.createDataFrame([], "path string, seq long")
    assert [(r.seq, r.round, r.slot, r.late) for r in rounds.ordered(records, none).collect()] == [(1, 0, 0, False), (2, 0, 1, False), (0, 0, 1, False)]
    assert rounds.ordered(records.limit(0), none).count() == 0
    one = spark.createDataFrame([("a", 1)], "path string, seq long")
    assert rounds.ordered(records.limit(0), one).count() == 0
