"""Self-made ETL files of both pointer sizes, plain, compressed and packed, up to a recording."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from emberstack.operators import filters
from emberstack.sources import etl
from emberstack.sources import open as opener

START, FREQUENCY = 1000, 10_000_000  # a tick is 100 ns
KERNEL = {8: -(2**47) + 0x1000, 4: 0x80001000}


def _encoded(kind: str, values: dict, pointer: int) -> bytes:
    out = b""
    for name, form in etl.LAYOUT[kind]:
        v = values.get(name, "" if form[0] in "ws" else [] if form == "ptrs" else str(uuid.UUID(int=0)) if form == "guid" else 0)
        word = "<q" if pointer == 8 else "<I"
        if form == "ptr":
            out += struct.pack(word, v)
        elif form in etl.NUMBERS:
            out += struct.pack("<" + etl.NUMBERS[form], v)
        elif form == "ptrs":
            out += b"".join(struct.pack(word, x) for x in v)
        elif form == "guid":
            out += uuid.UUID(v).bytes_le
        elif form == "s":
            out += v.encode() + b"\0"
        elif form == "w":
            out += (v + "\0").encode("utf-16-le")
        elif form == "ws":
            out += b"".join((x + "\0").encode("utf-16-le") for x in v)
        elif form == "sid":
            out += b"\0" * 4 if not values.get("sid") else struct.pack("<I", 1) + b"\0" * (2 * pointer - 4) + bytes([1, 2]) + b"\0" * 14
        elif form.startswith("pad"):
            out += b"\0" * int(form[3:])
        else:
            out += v.encode("utf-16-le").ljust(2 * int(form[1:]), b"\0")
    return out


def _event(kind: str, ts: int, values: dict, pointer: int, type_: int | None = None, pmc: tuple = (), header: str = "compact") -> bytes:
    where, types, version = next((w, t, v) for k, w, t, v, _ in etl.RECORDS if k == kind and (type_ is None or type_ in t))
    type_ = types[0] if type_ is None else type_
    body = _encoded(kind, values, pointer)
    if where in etl.GROUPS:
        group = etl.GROUPS[where]
        if pmc or header == "perfinfo":
            raw = struct.pack("<HBBHBBq", version | len(pmc) << 8, 17, 0xC0, 16 + 8 * len(pmc) + len(body), type_, group, ts) + b"".join(struct.pack("<q", x) for x in pmc)
        elif header == "system":
            raw = struct.pack("<HBBHBBIIqII", version, 2, 0xC0, 32 + len(body), type_, group, 7, 9, ts, 0, 0)
        else:
            raw = struct.pack("<HBBHBBIIq", version, 4, 0xC0, 24 + len(body), type_, group, 7, 9, ts)
    elif header == "manifest":
        raw = struct.pack("<HBBHHIIq", 80 + len(body), 19, 0xC0, 0, 0, 7, 9, ts) + uuid.UUID(where).bytes_le + struct.pack("<HBBBBHQ", type_, version, 0, 0, 0, 0, 0) + b"\0" * 24
    elif header == "instance":
        raw = struct.pack("<HBBBBHIIq", 72 + len(body), 21, 0xC0, type_, 0, version, 7, 9, ts) + uuid.UUID(where).bytes_le + b"\0" * 32
    else:
        raw = struct.pack("<HBBBBHIIq", 48 + len(body), 20, 0xC0, type_, 0, version, 7, 9, ts) + uuid.UUID(where).bytes_le + b"\0" * 8
    raw += body
    return raw + b"\0" * (-len(raw) % 8)


def _literals(data: bytes) -> bytes:
    return b"".join(b"\0\0\0\0" + data[i : i + 32] for i in range(0, len(data), 32))


def _buffer(events: list[bytes], processor: int, sequence: int, kind: int = 0, compress: bool = False, size: int = 8192, state: int = 0) -> bytes:
    body = b"".join(events)
    kept = 72 + len(body)
    if compress:
        body = _literals(body)
    size = 72 + len(body) if compress else size
    head = struct.pack("<3Iiqqq2HI", size, kept, kept, 0, 0, sequence, 0, processor, 0, state) + struct.pack("<IHHqq", 0, 64 if compress else 0, kind, 0, 0)
    assert len(head) == 72 and 72 + len(body) <= size
    return head + body.ljust(size - 72, b"\0")


def _file(pointer: int, compress: bool = False, form: int = 3) -> bytes:
    k, e = KERNEL[pointer], lambda kind, ts, type_=None, pmc=(), header="compact", **v: _event(kind, ts, v, pointer, type_, pmc, header)
    first = [
        e("cpu", 1000, computer_name="BOX", architecture=9), e("pnp", 1001, description="Intel Processor", friendly_name="Fast CPU"), e("build_info", 1002, product_name="Windows X", header="full"),
        e("system_paths", 1003, windows_directory="C:\\Win"), e("volume", 1004, nt_path="\\Device\\HarddiskVolume7", dos_path="D:"),
        e("physical_disk", 1005, disk=0, partitions=3), e("logical_disk", 1006, disk=1, partition=2, drive="E:"), e("physical_disk", 1005, disk=1, partitions=2),
        e("process", 1010, 3, pid=5, ppid=1, name="VsDiagnostics.exe", command_line="VsDiagnostics.exe start 1"), e("process", 1020, 1, pid=10, ppid=5, name="app.exe", command_line="app", sid=True),
        e("process", 1030, 1, pid=11, ppid=10, name="child.exe"), e("process", 1031, 1, pid=12, ppid=10, name="conhost.exe"), e("process", 1032, 1, pid=20, ppid=1, name="other.exe"),
        e("thread", 1021, 1, pid=10, tid=100, name="main"), e("thread", 1031, 1, pid=11, tid=110), e("thread", 1033, 1, pid=20, tid=200),
        e("debug_info", 1040, 36, base=0x10000, pid=10, age=3, debug_file="app.pdb", signature="01020304-0506-0708-090a-0b0c0d0e0f10", header="instance"),
        e("image", 1040, 10, base=0x10000, size=0x8000, pid=10, checksum=77, filename="\\Device\\HarddiskVolume7\\app.exe"), e("image", 1041, 3, base=k - 0x1000, size=0x4000, pid=0, filename="\\SystemRoot\\ntos.exe"),
        e("image", 1042, 2, base=0x20000, size=0x8000, pid=10, filename="gone.dll"), e("image", 1043, 10, base=0x30000, size=0x1000, pid=11, filename="\\Device\\HarddiskVolume5\\lib.dll"),
        e("target_started", 1050, pid=10, header="manifest"), e("sample_interval", 1051, 73, source=0, name="Timer"), e("sample_interval", 1052, 74, source=0, name="ignored"), e("pmc_config", 1053, count=2, names=["cycles", "misses"]),
    ]
    second = [
        e("context_switch", 1060, pmc=(100, 7), new_tid=100, old_tid=0), e("sample", 1100, ip=0x10010, tid=100, header="perfinfo"),
        e("stack", 1101, event_ts=1100, pid=10, tid=100, ips=[k + 8, k]), e("stack", 1102, event_ts=1100, pid=10, tid=100, ips=[0x10020, 0x10050]),
        e("context_switch", 1110, pmc=(150, 9), new_tid=0, old_tid=100), e("sample", 1200, ip=0x30010, tid=110), e("sample", 1250, ip=k + 0x20, tid=100), e("pmc_sample", 1260, ip=0x10010, tid=100, source=19),
        e("sample", 1270, ip=0x20010, tid=200), e("thread", 1900, 2, pid=10, tid=100), e("process", 1950, 2, pid=10, ppid=5, name="app.exe"),
    ]
    third = [
        e("sample", 1300, ip=0x10010, tid=100), e("stack_key", 1301, 38, event_ts=1300, pid=10, tid=100, key=0x99), e("stack_body", 1400, 34, key=0x99, ips=[1]), e("stack_body", 1500, 36, key=0x99, ips=[0x10030, 0x10050]),
        struct.pack("<HBBHBBIIq", 3, 4, 0xC0, 24, 99, 30, 7, 9, 1501),
    ]
    mode = etl.COMPRESSED_MODE if compress else 0
    head = e("trace_header", START, header="system", buffer_size=8192 if not compress else 20000, n_processors=2, buffers_written=4, pointer_size=pointer, perf_freq=FREQUENCY, start_time=133500000000000000, end_time=133500000000002000, log_file_mode=mode, session_name="s", file_name="f")
    return _buffer([head], 0, 0, etl.HEADER_BUFFER, state=form) + _buffer(third, 1, 3, compress=compress) + _buffer(first, 0, 1, compress=compress) + _buffer(second, 0, 2, compress=compress)


def _package(raw: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("metadata.xml", '<Package>\n  <Resource Name="x" Type="Other"/>\n  <Resource Id="1" Name="rec.etl" ResourcePackageUriPrefix="abc" Type="DiagnosticsHub.Resource.EtlFile" />\n</Package>')
        z.writestr("abc/rec.etl", raw)
    return out.getvalue()


def test_xpress():
    assert etl.xpress(bytes.fromhex("ffffff1f61626317000fff2601"), 300) == b"abc" * 100
    assert etl.xpress(bytes.fromhex("3f000000") + b"abcdefghijklmnopqrstuvwxyz", 26) == b"abcdefghijklmnopqrstuvwxyz"
    assert etl.xpress(_literals(bytes(range(256)) * 3), 768) == bytes(range(256)) * 3
    with pytest.raises(ValueError, match="out of range"):
        etl.xpress(bytes.fromhex("000000801000"), 30)
    with pytest.raises(ValueError, match="within a match"):
        etl.decompressed(bytes.fromhex("000000801700"), 30, 3)
    for form in (2, 4):
        with pytest.raises(ValueError, match="not supported"):
            etl.decompressed(b"", 1, form)


@pytest.mark.parametrize("pointer", [8, 4])
@pytest.mark.parametrize("compress", [False, True])
def test_events(spark, tmp_path, pointer, compress):
    (tmp_path / "a.etl").write_bytes(_file(pointer, compress))
    events = etl.events(spark, str(tmp_path / "a.etl")).cache()
    assert events.count() == 26 + 11 + 5 and events.where("kind is null").select("type", "version").collect() == [(99, 3)]
    assert {(r.kind, r.type): r.n for r in etl.counts(events, only=["process", "image"]).collect()} == {("process", 1): 4, ("process", 3): 1, ("process", 2): 1, ("image", 10): 2, ("image", 3): 1, ("image", 2): 1}
    assert etl.counts(events, without=["sample"], pid=9).where("kind = 'sample'").count() == 0
    order = [r.ts for r in etl.records(events, "sample").orderBy("seq").collect()]
    assert order == [1100, 1200, 1250, 1270, 1300]
    app = etl.records(events, "process").where("pid = 10 and type = 1").first()
    assert (app.ppid, app.name, app.command_line, app.seq.ts) == (5, "app.exe", "app", 1020)
    assert etl.records(events, "pmc_config").first().names == ["cycles", "misses"]
    assert etl.records(events, "context_switch").orderBy("seq").first().pmc == [100, 7]
    assert etl.records(events, "debug_info").first().signature == "01020304-0506-0708-090a-0b0c0d0e0f10"
    assert etl.records(events, "stack").orderBy("seq").first().ips == [KERNEL[pointer] + 8, KERNEL[pointer]]
    head = etl.session(spark, str(tmp_path / "a.etl")).first()
    assert (head.start_ticks, head.frequency, head.pointer_size, head.n_processors, head.n_buffers) == (START, FREQUENCY, pointer, 2, 4)


@pytest.mark.parametrize(("name", "pointer"), [("a.etl", 8), ("b.diagsession", 4)])
def test_recording(spark, tmp_path, name, pointer):
    raw = _file(pointer, compress=pointer == 4)
    (tmp_path / name).write_bytes(_package(raw) if name.endswith("session") else raw)
    functions = spark.createDataFrame([("D:\\app.exe", 0x40, 0x60, "main", "app.c", 3), ("D:\\app.exe", 0x20, 0x28, "leaf", "app.c", 9)], opener.FUNCTIONS)
    lines = spark.createDataFrame([("D:\\app.exe", 0x20, 0x24, 11)], opener.LINES)
    r = opener.open_recording(spark, str(tmp_path / name), str(tmp_path / "store"), functions, lines)
    assert {(p.pid, p.name, p.start_ts, p.end_ts) for p in r.processes.collect()} == {(10, "app.exe", 2000, 95000), (11, "child.exe", 3000, None)}
    samples = {x.ts: x for x in r.samples.collect()}
    assert sorted(samples) == [10000, 20000, 25000, 26000, 30000] and {x.source_id for x in samples.values()} == {0, 1}
    frames = {}
    for f in r.stack_frames.orderBy("depth").collect():
        frames.setdefault(f.sample_id, []).append((f.depth, f.module, f.symbol, f.instr_line, f.is_leaf))
    k = KERNEL[pointer]
    kernel = lambda at: f"ntos.exe!0x{(k + at) % 2**64:016x}"
    assert frames[samples[10000].sample_id] == [(1, "D:\\app.exe", "main", None, False), (2, "D:\\app.exe", "leaf", 11, False), (3, "C:\\Win\\ntos.exe", kernel(0), None, False), (4, "C:\\Win\\ntos.exe", kernel(8), None, True)]
    assert frames[samples[20000].sample_id] == [(None, "E:\\lib.dll", "lib.dll!0x0000000000030010", None, True)]
    assert frames[samples[25000].sample_id] == [(None, "C:\\Win\\ntos.exe", kernel(0x20), None, True)]
    assert [f[:3] for f in frames[samples[30000].sample_id]] == [(1, "D:\\app.exe", "main"), (2, "D:\\app.exe", "app.exe!0x0000000000010030")]
    assert {(x.source_id, x.name, x.n, x.has_stacks) for x in r.sample_sources().collect()} == {(0, "Timer", 4, True), (1, "Unknown (19)", 1, False)}
    about = r.system_info().first()
    assert tuple(about) == ("BOX", "Windows X", "x64", "Fast CPU", 2)
    session = r.session_info().first()
    assert (session.command_line, session.runtime_ns, session.samples, session.date.year) == ("VsDiagnostics.exe start 1", 200000, 5, 2024)
    main = r.threads.where("tid = 100").first()
    assert (main.context_switches, main.pmc, main.name) == (1, [50, 2], "main")
    short = r.filtered(filters.SampleFilter(min_time=-5, max_time=21000))
    app = r.processes.where("pid = 10").first().process_id
    assert {x.symbol for x in short.hottest_functions(9, 0).collect()} == {"main", "leaf", kernel(0), kernel(8), "lib.dll!0x0000000000030010"}
    shown = {x.symbol: (x.total, x.expanded) for x in r.hot_tree(0, app).collect()}
    assert shown["main"] == (2, True) and len(shown) >= 3
    both = {(x.side, x.symbol): (x.edge_total, x.total, x.self) for x in r.callers_and_callees("D:\\app.exe", "main", 0, app, 5).where("source_id = 0").collect()}
    assert both == {("caller", "[root]"): (2, 2, 0), ("callee", "leaf"): (1, 1, 0), ("callee", "app.exe!0x0000000000010030"): (1, 1, 1)}
    line = r.line_info("D:\\app.exe", "leaf", app).first()
    assert (line.instr_line, line.function_file, line.function_line) == (11, "app.c", 9)


def test_modules_that_are_not_looked_up(spark, tmp_path):
    (tmp_path / "a.etl").write_bytes(_file(8))
    functions = spark.createDataFrame([("X:\\app.exe", 0x40, 0x60, "main", "app.c", 3)], opener.FUNCTIONS)
    found = lambda **o: {x.symbol for x in opener.open_recording(spark, str(tmp_path / "a.etl"), str(tmp_path / "s"), functions, options=opener.SymbolOptions(**o)).stack_frames.collect()}
    rules = (("prefix", "D:\\", "X:\\"),)
    assert "main" in found(path_rules=rules) and "main" not in found() and "main" not in found(path_rules=rules, exclude=("*app.exe",))


@pytest.mark.parametrize(("raw", "says"), [
    (b"x" * 20, "no buffer header"), (b"\0" * 500, "no plain header buffer"), (_buffer([], 0, 0, etl.HEADER_BUFFER), "first record|trace header"),
    (_file(8)[:12000], "buffer 1"), (_file(8, True, 2), "not supported"), (_file(8)[:8192] + b"\xff" * 80, "bytes"),
])
def test_broken_files(spark, tmp_path, raw, says):
    (tmp_path / "a.etl").write_bytes(raw)
    with pytest.raises(Exception, match=says):
        etl.events(spark, str(tmp_path / "a.etl")).collect()


@pytest.mark.parametrize(("raw", "says"), [(b"\xd0\xcf\x11\xe0abc", "compound"), (b"plain", "not a diagsession"), (_package(b"")[:0] or b"PK", "zip|Zip")])
def test_broken_packages(raw, says):
    with pytest.raises(Exception, match=says):
        etl.package_content(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("metadata.xml", "<Package/>")
    with pytest.raises(ValueError, match="names no ETL"):
        etl.package_content(out.getvalue())
