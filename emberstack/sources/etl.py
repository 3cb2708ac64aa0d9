"""ETL recordings, plain or in a diagsession package, as tables of events.

One task follows the headers of a file's buffers, a few bytes of each; the buffers are then dealt to all tasks, which read,
decompress and decode them, so a file may be of any size. Packages, and files in stores that only Spark reads, are read whole by
its ``binaryFile`` source (2 GB at most) first. What an event holds is read later, by kind, from its payload: see
:func:`records`. Order within a file is that of ``seq``: time, then processor, buffer and place in it.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberstack.sources.ranges import View, listed, opened, reachable

# Fixed values of the format: sizes, groups, header types by the way they are laid out, flags, providers.
BUFFER_HEADER = 72
GROUPS = {"header": 0, "process": 3, "thread": 5, "config": 11, "perfinfo": 15, "image": 20, "stackwalk": 24}
SYSTEM, COMPACT, PERFINFO, FULL, INSTANCE, EVENT_HEADER = (1, 2), (3, 4), (16, 17), (10, 20), (11, 21), (18, 19)
HEADER_BUFFER, COMPRESSED_FLAG, COMPRESSED_MODE, PEBS, EXTENDED = 4, 1 << 6, 1 << 26, 1 << 15, 1
NONE, XPRESS = (0, 1), 3
IMAGE_ID, CONFIG_EX = "b3e675d7-2554-4f18-830b-2762732560de", "9b79ee91-b5fd-41c0-a243-4248e266e9d0"
DIAGNOSTICS_HUB, PROFILER = "9e5f9046-43c6-4f62-ba13-7b19896253ff", "460b83b6-fc11-481b-b7aa-4038ca4c4c48"
TIME_ZONE = 172

# Record kinds as (kind, group or provider, types, version, layout). A layout names fields in order with their types:
# u and i with bits, ptr (of the file's width), f64, guid, w and s (UTF-16 and byte strings up to a null), wN (N characters),
# padN (N bytes), sid (an optional security id), ptrs (pointers to the end), ws (as many w as the field before says).
RECORDS = [
    ("trace_header", "header", (0,), 2, f"buffer_size:u32 os_major:u8 os_minor:u8 sp_major:u8 sp_minor:u8 build:u32 n_processors:u32 end_time:u64 timer_resolution:u32 max_file_size:u32 log_file_mode:u32 buffers_written:u32 start_buffers:u32 pointer_size:u32 events_lost:u32 cpu_speed:u32 logger_name:ptr log_file_name:ptr _:pad{TIME_ZONE + 4} boot_time:u64 perf_freq:u64 start_time:u64 reserved:u32 buffers_lost:u32 session_name:w file_name:w"),
    ("header_extension", "header", (5, 32), 2, " ".join(f"group_mask_{i}:u32" for i in range(1, 9)) + " kernel_event_version:u32"),
    ("partition_info", "header", (80,), 2, "event_version:u16 reserved:u16 partition_type:u32 qpc_offset:i64 partition_id:w parent_id:w"),
    ("cpu", "config", (10,), 3, "mhz:u32 n_processors:u32 mem_size:u32 page_size:u32 granularity:u32 computer_name:w256 domain_name:w134 hyper_threading:ptr highest_user_address:ptr architecture:u16 level:u16 revision:u16 pae:u8 nx:u8 memory_speed:u32"),
    ("physical_disk", "config", (11,), 2, "disk:u32 bytes_per_sector:u32 sectors_per_track:u32 tracks_per_cylinder:u32 cylinders:u64 scsi_port:u32 scsi_path:u32 scsi_target:u32 scsi_lun:u32 manufacturer:w256 partitions:u32 write_cache:u8 _:pad1 boot_drive:w3 spare:w2"),
    ("logical_disk", "config", (12,), 2, "start_offset:u64 partition_size:u64 disk:u32 size:u32 drive_type:u32 drive:w4 _:pad4 partition:u32 sectors_per_cluster:u32 bytes_per_sector:u32 _:pad4 free_clusters:i64 clusters:i64 file_system:w16 volume_extent:i32 _:pad4"),
    ("pnp", "config", (22,), 5, "class_guid:guid upper_filters:u32 lower_filters:u32 status:u32 problem:u32 device_id:w description:w friendly_name:w pdo_name:w service_name:w"),
    ("process", "process", (1, 2, 3, 4, 39), 4, "unique_key:ptr pid:u32 ppid:u32 session:u32 exit_status:i32 directory_table:ptr flags:u32 _:sid name:s command_line:w package:w application:w"),
    ("process_counters", "process", (32, 33), 2, "pid:u32 page_faults:u32 handles:u32 reserved:u32 peak_virtual_size:ptr peak_working_set:ptr peak_pagefile:ptr peak_paged_pool:ptr peak_non_paged_pool:ptr virtual_size:ptr working_set:ptr pagefile:ptr paged_pool:ptr non_paged_pool:ptr private_pages:ptr"),
    ("thread_name", "thread", (72,), 2, "pid:u32 tid:u32 name:w"),
    ("thread", "thread", (1, 2, 3, 4), 3, "pid:u32 tid:u32 stack_base:ptr stack_limit:ptr user_stack_base:ptr user_stack_limit:ptr affinity:ptr start_address:ptr teb:ptr tag:u32 base_priority:u8 page_priority:u8 io_priority:u8 flags:u8 name:w"),
    ("thread_v4", "thread", (1, 2, 3, 4), 4, "pid:u32 tid:u32 stack_base:ptr stack_limit:ptr user_stack_base:ptr user_stack_limit:ptr affinity:ptr start_address:ptr teb:ptr tag:u32 base_priority:u8 page_priority:u8 io_priority:u8 flags:u8 name:w"),
    ("context_switch", "thread", (36,), 4, "new_tid:u32 old_tid:u32 new_priority:i8 old_priority:i8 previous_c_state:u8 spare:i8 wait_reason:i8 thread_flags:i8 old_state:i8 ideal_processor:i8 wait_time:u32 reserved:u32"),
    ("image", "process", (10,), 3, "base:ptr size:ptr pid:u32 checksum:u32 time_stamp:u32 signature_level:u8 signature_type:u8 _:pad2 default_base:ptr _:pad16 filename:w"),
    ("image", "image", (2, 3, 4), 3, "base:ptr size:ptr pid:u32 checksum:u32 time_stamp:u32 signature_level:u8 signature_type:u8 _:pad2 default_base:ptr _:pad16 filename:w"),
    ("sample", "perfinfo", (46,), 2, "ip:ptr tid:u32 count:u16 reserved:u16"),
    ("pmc_sample", "perfinfo", (47,), 2, "ip:ptr tid:u32 source:u16 reserved:u16"),
    ("pmc_config", "perfinfo", (48,), 2, "count:u32 names:ws"),
    ("pmc_corruption", "perfinfo", (49,), 2, "processor:u32 count:u32"),
    ("sample_interval", "perfinfo", (73, 74), 3, "source:u32 new_interval:u32 old_interval:u32 name:w"),
    ("stack", "stackwalk", (32,), 2, "event_ts:u64 pid:u32 tid:u32 ips:ptrs"),
    ("stack_key", "stackwalk", (37, 38), 2, "event_ts:u64 pid:u32 tid:u32 key:ptr"),
    ("stack_body", "stackwalk", (34, 35, 36), 2, "key:ptr ips:ptrs"),
    ("image_info", IMAGE_ID, (0,), 2, "base:ptr size:ptr pid:u32 time_stamp:u32 filename:w"),
    ("debug_info", IMAGE_ID, (36, 37), 2, "base:ptr pid:u32 signature:guid age:u32 debug_file:s"),
    ("build_info", CONFIG_EX, (32,), 0, "install_date:u64 build_lab:w product_name:w"),
    ("system_paths", CONFIG_EX, (33,), 0, "system_directory:w windows_directory:w"),
    ("volume", CONFIG_EX, (35,), 0, "nt_path:w dos_path:w"),
    ("target_started", DIAGNOSTICS_HUB, (1,), 2, "pid:u32 reason:u32 at:u64"),
    ("target_stopped", DIAGNOSTICS_HUB, (2,), 1, "pid:u32 at:u64"),
    ("machine_info", DIAGNOSTICS_HUB, (5,), 0, "name:w os_description:w architecture:u32"),
    ("counter_info", DIAGNOSTICS_HUB, (6,), 0, "counter:u32 at:u64 value:f64"),
    ("mark_info", DIAGNOSTICS_HUB, (7,), 0, "message:w"),
    ("profile_target", PROFILER, (1,), 0, "pid:u32"),
]
KIND = {(GROUPS.get(where, where), type_, version): kind for kind, where, types, version, _ in RECORDS for type_ in types}
LAYOUT = {kind: [tuple(f.split(":")) for f in layout.split()] for kind, _, _, _, layout in RECORDS}
NUMBERS = {"u8": "B", "i8": "b", "u16": "H", "i16": "h", "u32": "I", "i32": "i", "u64": "q", "i64": "q", "f64": "d"}

ARROW = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}
HEADERS = "path string, number int, processor int, sequence long, kept int, compressed boolean, form int, pointer_size int, at long, size int"
BUFFERS = "path string, number int, processor int, sequence long, kept int, compressed boolean, form int, pointer_size int, body binary"
EVENTS = "path string, ts long, processor int, buffer long, place int, kind string, provider string, type int, version int, pid long, tid long, pmc array<long>, pointer_size int, payload binary"
SESSION = "path string, start_ticks long, frequency long, start_time long, end_time long, pointer_size int, n_processors int, n_buffers int, buffer_size int"


def spark_type(kind: str) -> str:
    return {"f64": "double", "guid": "string", "w": "string", "s": "string", "ptrs": "array<bigint>", "ws": "array<string>"}.get(kind, "string" if kind[0] == "w" else "bigint")


def _guid(raw: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", raw)
    return f"{a:08x}-{b:04x}-{c:04x}-{raw[8:10].hex()}-{raw[10:16].hex()}"


def _wide(raw: bytes, at: int, most: int | None = None) -> tuple[str | None, int]:
    """A UTF-16 string at ``at`` up to a null (within ``most`` characters) and where it ends; null beyond the record."""
    if at >= len(raw):
        return None, at
    end = at
    limit = len(raw) - 1 if most is None else min(len(raw) - 1, at + 2 * most)
    while end < limit and raw[end : end + 2] != b"\0\0":
        end += 2
    return raw[at:end].decode("utf-16-le", "replace"), end + 2 if most is None else at + 2 * most


def values(layout: list[tuple[str, str]], raw: bytes, pointer: int) -> list:
    """The fields of a record's payload; null for what lies beyond its end."""
    out, at, word = [], 0, "<q" if pointer == 8 else "<I"
    for _, kind in layout:
        value = None
        if kind == "ptr":
            if at + pointer <= len(raw):
                (value,) = struct.unpack_from(word, raw, at)
            at += pointer
        elif kind in NUMBERS:
            size = struct.calcsize("<" + NUMBERS[kind])
            if at + size <= len(raw):
                (value,) = struct.unpack_from("<" + NUMBERS[kind], raw, at)
            at += size
        elif kind == "ptrs":
            n = max(0, (len(raw) - at) // pointer)
            value = list(struct.unpack_from(f"<{n}{word[1]}", raw, at))
            at += n * pointer
        elif kind == "guid":
            value = _guid(raw[at : at + 16]) if at + 16 <= len(raw) else None
            at += 16
        elif kind == "s":
            end = raw.find(b"\0", at)
            end = len(raw) if end < 0 else end
            value = raw[at:end].decode("utf-8", "replace") if at < len(raw) else None
            at = end + 1
        elif kind == "w":
            value, at = _wide(raw, at)
        elif kind == "ws":
            value = []
            for _ in range(out[-1] or 0):
                text, at = _wide(raw, at)
                value.append(text)
        elif kind == "sid":
            there = at + 4 <= len(raw) and any(raw[at : at + 4])
            at += 2 * pointer + 8 + 4 * raw[at + 2 * pointer + 1] if there else 4
        elif kind.startswith("pad"):
            at += int(kind[3:])
        else:
            value, at = _wide(raw, at, int(kind[1:]))
        out.append(value)
    return out


def xpress(data: bytes, size: int) -> bytes:
    """Plain LZ77 of the Xpress codec: 32 flag bits, then for each a literal byte or a match of 13 bits of distance and 3 of length; a
    length of 7 goes on in half a byte (two matches share one), then a byte, two bytes or four."""
    out, at, half = bytearray(), 0, None
    flags = left = 0
    while at < len(data) and len(out) < size:
        if not left:
            (flags,), left, at = struct.unpack_from("<I", data, at), 32, at + 4
            continue
        left -= 1
        if not flags >> left & 1:
            out.append(data[at])
            at += 1
            continue
        if at + 2 > len(data):
            break
        (pair,) = struct.unpack_from("<H", data, at)
        at, back, length = at + 2, (pair >> 3) + 1, pair & 7
        if length == 7:
            if half is None:
                half, more, at = at, data[at] & 15, at + 1
            else:
                half, more = None, data[half] >> 4
            length += more
            if more == 15:
                long, at = data[at], at + 1
                length += long
                if long == 255:
                    (length,), at = struct.unpack_from("<H", data, at), at + 2
                    if not length:
                        (length,), at = struct.unpack_from("<I", data, at), at + 4
                    if length < 22:
                        raise ValueError("compressed data with a match that is too short")
        length += 3
        if back > len(out) or len(out) + length > size:
            raise ValueError("compressed data with a match out of range")
        while length:
            piece = out[len(out) - back : len(out) - back + length]
            out += piece
            length -= len(piece)
    return bytes(out)


def decompressed(body: bytes, size: int, form: int) -> bytes:
    if form in NONE:
        return body[:size]
    if form != XPRESS:
        raise ValueError(f"compression format {form} is not supported")
    try:
        out = xpress(body, size)
    except (IndexError, struct.error) as e:
        raise ValueError("compressed data ends within a match") from e
    if len(out) != size:
        raise ValueError(f"buffer of {len(out)} bytes, not {size}, after decompression")
    return out


def package_content(raw: bytes) -> bytes:
    """The recording within a diagsession package: the first ETL resource that its metadata names."""
    if raw[:4] == b"\xd0\xcf\x11\xe0":
        raise ValueError("a diagsession of the old compound format is not supported")
    if raw[:2] != b"PK":
        raise ValueError("not a diagsession package")
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        for line in package.read("metadata.xml").decode("utf-8", "replace").splitlines():
            line = line.strip()
            if line.startswith("<Resource ") and line.endswith("/>") and 'Type="DiagnosticsHub.Resource.EtlFile"' in line:
                name, prefix = xml_attribute(line, "Name"), xml_attribute(line, "ResourcePackageUriPrefix")
                if name is not None and prefix is not None:
                    return package.read(f"{prefix}/{name}")
    raise ValueError("the metadata names no ETL resource")


def xml_attribute(node: str, name: str) -> str | None:
    found = re.search(rf'{re.escape(name)}="([^"]*)"', node)
    return found[1] if found else None


def session_of(raw: bytes) -> dict:
    """What the header buffer says of a file."""
    if len(raw) < BUFFER_HEADER:
        raise ValueError("not an ETL file: no buffer header")
    size, state, flags, kind = *struct.unpack_from("<I", raw), *struct.unpack_from("<I", raw, 44), *struct.unpack_from("<2H", raw, 52)
    if kind != HEADER_BUFFER or flags & COMPRESSED_FLAG:
        raise ValueError("not an ETL file: the first buffer is no plain header buffer")
    if size < BUFFER_HEADER + 32 or len(raw) < BUFFER_HEADER + 32:
        raise ValueError("not an ETL file: the header buffer is too small")
    event = next(events_of(raw[BUFFER_HEADER:size]), None)
    if event is None or event[:4] != ("trace_header", None, 0, 2):
        raise ValueError("not an ETL file: the first record is no trace header")
    found = dict(zip((n for n, _ in LAYOUT["trace_header"]), values(LAYOUT["trace_header"], event[-1], 8)))
    if found["pointer_size"] != 8:
        found = dict(zip((n for n, _ in LAYOUT["trace_header"]), values(LAYOUT["trace_header"], event[-1], 4)))
    return {
        "start_ticks": event[4], "frequency": found["perf_freq"], "start_time": found["start_time"], "end_time": found["end_time"], "pointer_size": found["pointer_size"],
        "n_processors": found["n_processors"], "n_buffers": found["buffers_written"], "buffer_size": found["buffer_size"], "form": state & 0xFFFF if found["log_file_mode"] & COMPRESSED_MODE else 0,
    }


def first_buffer(file: View) -> bytes:
    """The header buffer of a file, as far as the file goes."""
    return file[0 : max(BUFFER_HEADER, min(struct.unpack("<I", file[0:4])[0], 1 << 26))] if len(file) >= 4 else b""


def headers_of(file: View, session: dict, at: int = 0, number: int = 0, growing: bool = False) -> Iterator[tuple]:
    """``(number, processor, sequence, kept, compressed, form, pointer_size, at, size)`` of the buffers from one on. Of a ``growing``
    file those that are there in full, however many its header says."""
    while growing or number < session["n_buffers"]:
        if at + BUFFER_HEADER > len(file):
            if growing:
                return
            raise ValueError(f"no header of buffer {number}")
        head = file[at : at + BUFFER_HEADER]
        size, kept = struct.unpack_from("<2I", head)
        (sequence,), (processor,), (flags,) = struct.unpack_from("<q", head, 24), struct.unpack_from("<H", head, 40), struct.unpack_from("<H", head, 52)
        compressed = bool(flags & COMPRESSED_FLAG)
        if growing and BUFFER_HEADER <= size <= session["buffer_size"] and at + size > len(file):
            return
        if not BUFFER_HEADER <= size <= session["buffer_size"] or at + size > len(file):
            raise ValueError(f"buffer {number} of {size} bytes")
        if sequence > session["n_buffers"] and not growing or processor > session["n_processors"]:
            raise ValueError(f"buffer {number} of sequence {sequence} and processor {processor}")
        if kept > (session["buffer_size"] if compressed else size):
            raise ValueError(f"buffer {number} keeps {kept} of {size} bytes")
        yield number, processor, sequence, kept, compressed, session["form"], session["pointer_size"], at, size
        at, number = at + size, number + 1


def buffers_of(raw: bytes) -> Iterator[tuple]:
    """``(number, processor, sequence, kept, compressed, form, pointer_size, body)`` of every buffer of a file."""
    for *head, at, size in headers_of(View(raw), session_of(raw)):
        yield *head, raw[at + BUFFER_HEADER : at + size]


def rows_of(path: str, processor: int, sequence: int, kept: int, compressed: bool, form: int, pointer_size: int, body: bytes, kinds: frozenset | None = None) -> list[tuple]:
    """The events of a buffer as rows of EVENTS, those of ``kinds`` alone where they are given."""
    size = kept - BUFFER_HEADER
    payloads = decompressed(body, size, form) if compressed else body[:size]
    return [
        (path, ts, processor, sequence, place, kind, provider, type_, version, pid, tid, pmc, pointer_size, payload if kind else None)
        for place, (kind, provider, type_, version, ts, pid, tid, pmc, payload) in enumerate(events_of(payloads)) if kinds is None or kind in kinds
    ]


def events_of(payload: bytes) -> Iterator[tuple]:
    """``(kind, provider, type, version, ts, pid, tid, pmc, payload)`` of every event of a buffer, in order."""
    at = 0
    while at + 4 <= len(payload):
        head, form, flags = struct.unpack_from("<HBB", payload, at)
        if not flags & 0x80 or not flags & 0x40 or flags & 0x10:
            raise ValueError(f"no trace header at {at}")
        pid = tid = pmc = provider = None
        if form in SYSTEM or form in COMPACT:
            version, (size, type_, group, tid, pid, ts) = head, struct.unpack_from("<HBBIIq", payload, at + 4)
            where, begin = group, 32 if form in SYSTEM else 24
        elif form in PERFINFO:
            version, (size, type_, group, ts) = head & 0x78FF, struct.unpack_from("<HBBq", payload, at + 4)
            n, pebs = head >> 8 & 7, 8 * bool(head & PEBS)
            pmc = list(struct.unpack_from(f"<{n}q", payload, at + 16 + pebs)) if n else None
            where, begin = group, 16 + pebs + 8 * n
        elif form in FULL or form in INSTANCE:
            size, (type_, version, tid, pid, ts) = head, struct.unpack_from("<BxHIIq", payload, at + 4)
            where = provider = _guid(payload[at + 24 : at + 40])
            begin = 48 if form in FULL else 72
        elif form in EVENT_HEADER:
            size, (tid, pid, ts), (type_, version) = head, struct.unpack_from("<IIq", payload, at + 8), struct.unpack_from("<HB", payload, at + 40)
            if struct.unpack_from("<H", payload, at + 4)[0] & EXTENDED:
                raise ValueError("event headers with extended data are not supported")
            where = provider = _guid(payload[at + 24 : at + 40])
            begin = 80
        else:
            raise ValueError(f"trace header type {form} is not supported")
        if size < begin:
            raise ValueError(f"event of {size} bytes at {at}")
        yield KIND.get((where, type_, version)), provider, type_, version, ts, pid, tid, pmc, payload[at + begin : at + size]
        at += size + -size % 8


def _by_ranges(spark: SparkSession, path: str) -> tuple[DataFrame | None, bool]:
    """``(path)`` of the files that tasks read by ranges, or None; and whether there are others."""
    files = listed(spark, path).select("path")
    if not reachable(files):
        return None, True
    packed = F.lower("path").endswith(".diagsession")
    return files.where(~packed), files.where(packed).head() is not None


def contents(spark: SparkSession, path: str, packages: bool = False) -> DataFrame:
    """``(path, content)`` of the recordings, or of ``packages`` alone, those in packages unpacked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if packages:
        files = files.where(F.lower("path").endswith(".diagsession"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                raw = package_content(raw) if name.lower().endswith(".diagsession") else raw
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([raw], pa.binary())], ["path", "content"])

    return files.mapInArrow(run, "path string, content binary")


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(zip(*rows), named)], [n for n, _ in named])


def session(spark: SparkSession, path: str) -> DataFrame:
    """One row for a file: ticks and frequency of its clock, start and end in 100 ns since 1601, sizes."""
    names = [c.split()[0] for c in SESSION.split(", ")]

    def of(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    found = {"path": r["path"], **session_of(r["content"] if whole else first_buffer(View(opened(r["path"]))))}
                    yield _rows(SESSION, [tuple(found[n] for n in names)])

        return run

    ranged, others = _by_ranges(spark, path)
    found = [] if ranged is None else [ranged.mapInArrow(of(False), SESSION)]
    if others or not found:
        found.append(contents(spark, path, packages=ranged is not None).mapInArrow(of(True), SESSION))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def buffers(spark: SparkSession, path: str, packages: bool = False) -> DataFrame:
    """The buffers of the recordings, undecoded, of files read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                held: list[tuple] = []
                for row in buffers_of(raw):
                    held.append((name, *row))
                    if len(held) == 64:
                        yield _rows(BUFFERS, held)
                        held = []
                if held:
                    yield _rows(BUFFERS, held)

    return contents(spark, path, packages).mapInArrow(run, BUFFERS)


def headers(files: DataFrame) -> DataFrame:
    """The headers of the buffers of ``files(path)``: where each is and how large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as file:
                    view, held = View(file), []
                    for row in headers_of(view, session_of(first_buffer(view))):
                        held.append((name, *row))
                        if len(held) == 10_000:
                            yield _rows(HEADERS, held)
                            held = []
                    if held:
                        yield _rows(HEADERS, held)

    return files.mapInArrow(run, HEADERS)


def events(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Every event with its undecoded payload (none for a kind that is not known), or those of ``kinds``; ``kind`` is that of
    :data:`RECORDS`, else null."""
    wanted = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                if "at" in b:
                    with opened(b["path"]) as file:
                        body = file.read_at(b["size"] - BUFFER_HEADER, b["at"] + BUFFER_HEADER)
                else:
                    body = b["body"]
                rows = rows_of(b["path"], b["processor"], b["sequence"], b["kept"], b["compressed"], b["form"], b["pointer_size"], body, wanted)
                if rows:
                    yield _rows(EVENTS, rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged, others = _by_ranges(spark, path)
    found = [] if ranged is None else [headers(ranged).repartition(tasks, "path", "number").mapInArrow(run, EVENTS)]
    if others or not found:
        found.append(buffers(spark, path, packages=ranged is not None).repartition(tasks, "path", "number").mapInArrow(run, EVENTS))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def records(events: DataFrame, kind: str) -> DataFrame:
    """``(path, ts, seq, type, pmc, *fields)``: the events of one kind with the fields of its layout; ``seq`` orders a file's events."""
    layout = LAYOUT[kind]
    fields = [(i, n, t) for i, (n, t) in enumerate(layout) if n != "_"]
    schema = "path string, ts bigint, processor int, buffer bigint, place int, type int, pmc array<bigint>, " + ", ".join(f"{n} {spark_type(t)}" for _, n, t in fields)
    kept = ["path", "ts", "processor", "buffer", "place", "type", "pmc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [values(layout, raw, width) for raw, width in zip(batch.column("payload").to_pylist(), batch.column("pointer_size").to_pylist())]
            if found:
                own = list(zip(*(batch.column(c).to_pylist() for c in kept)))
                yield _rows(schema, [(*o, *(v[i] for i, _, _ in fields)) for o, v in zip(own, found)])

    rows = events.where(F.col("kind") == kind).select(*kept, "pointer_size", "payload").mapInArrow(run, schema)
    return rows.select("path", "ts", F.struct("ts", "processor", "buffer", "place").alias("seq"), "type", "pmc", *[n for _, n, _ in fields])


def counts(events: DataFrame, only: list[str] | None = None, without: list[str] | None = None, pid: int | None = None) -> DataFrame:
    """``(kind, provider, type, version, n)``: what a file holds, of known kinds and others."""
    if only is not None:
        events = events.where(F.col("kind").isin(*only))
    if without:
        events = events.where(~F.coalesce(F.col("kind").isin(*without), F.lit(False)))
    if pid is not None:
        events = events.where(F.col("pid") == pid)
    return events.groupBy("kind", "provider", "type", "version").agg(F.count("*").alias("n"))
