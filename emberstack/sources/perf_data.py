"""perf.data recordings as tables of events and attributes.

A file of any size is cut into byte ranges that all tasks read. Where the records of a range begin is known only from the records
before it, so it is guessed first: each range finds a place from which records follow one another to its end, and tells where
the chain leaves it and how many it has counted. Then the chain is closed from the file's first record on: a range whose guess is not
where the one before it left is walked again from there. Only then are records read, each range from its true start, with
their places in the file. Only the record layouts are read in Python; everything after is DataFrame work.

Stores that only Spark reads are read by its ``binaryFile`` source, a file of 2 GB at most by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberstack.sources.ranges import View, listed, opened, reachable

# Fixed values of the format: record types, bits of sample_type and of features, and flags.
COMM, EXIT, FORK, SAMPLE, MMAP2, AUXTRACE = 3, 4, 7, 9, 10, 71
FINISHED_ROUND, ID_INDEX, THREAD_MAP, CPU_MAP, FINISHED_INIT = 68, 69, 73, 74, 82
TOOL_KINDS = {FINISHED_ROUND: "finished_round", ID_INDEX: "id_index", THREAD_MAP: "thread_map", CPU_MAP: "cpu_map", FINISHED_INIT: "finished_init"}
KINDS = {COMM: "comm", EXIT: "exit", FORK: "fork", SAMPLE: "sample", MMAP2: "mmap2"}
IP, TID, TIME, ADDR, READ, CALLCHAIN, ID, CPU, PERIOD, STREAM, RAW, IDENTIFIER = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 65536
EVENT_DESC, SAMPLE_ID_ALL, BUILD_ID = 12, 1 << 18, 1 << 14
BUILD_IDS, BUILD_ID_SIZE, READ_BY_ID = 2, 1 << 15, 4
TEXTS = {3: "hostname", 4: "os_release", 5: "version", 6: "arch", 8: "cpu_desc", 9: "cpu_id"}
BATCH = 50_000
RANGE = 1 << 25  # bytes of a file that a task reads at once
LARGEST = 1 << 16  # no record is larger, but for what follows an auxtrace record
SURE = 64  # so many records in a chain make a guess

EVENTS = """path string, seq long, kind string, ts long, pid long, tid long, ppid long, cpu long, event_id long, ip long, period long, ips array<long>,
  addr long, len long, page_offset long, build_id string, name string"""
COLUMNS = [c.split()[0] for c in EVENTS.split(",")]
TOOLS = "path string, seq long, kind string, place long, id long, idx long, cpu long, tid long, name string"
FILE_IDS = "path string, pid long, build_id string, filename string"
ATTRIBUTES = "path string, place long, name string, config long, sample_type long, ids array<long>"
METADATA = "path string, key string, value string"


def _id_places(kind: int) -> tuple[int, int] | None:
    """Where the id is: bytes from the beginning of a sample, and from the end of any other record; None if there is none."""
    if kind & IDENTIFIER:
        return 0, 8
    if not kind & ID:
        return None
    return 8 * sum(bool(kind & b) for b in (IP, TID, TIME, ADDR)), 8 * (1 + sum(bool(kind & b) for b in (CPU, STREAM)))


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


class Recording:
    """The header, attributes and features of one file."""

    def __init__(self, data: bytes | View, growing: bool = False):
        """Of a ``growing`` file whose header says nothing of its size yet, all that is there are records."""
        self.data, self.growing = data if isinstance(data, View) else View(data), growing
        data = self.data
        if data[:8] not in (b"PERFILE2", b"2ELIFREP"):
            raise ValueError("not a perf.data file")
        self.order = "<" if data[:8] == b"PERFILE2" else ">"
        size, self.attr_size, attrs, attrs_size, self.begin, self.size = self.read("6Q", 8)
        if size != 104:
            raise ValueError(f"header of {size} bytes")
        words = self.read("4Q", 72)
        bits = [n for n in range(256) if words[n // 64] >> n % 64 & 1]
        self.features = {n: self.read("2Q", self.begin + self.size + 16 * i) for i, n in enumerate(bits)}
        self.attributes = self._described() if EVENT_DESC in self.features else self._listed(attrs, attrs_size)
        self._check_attributes()
        self.by_id = {i: a for a in self.attributes for i in a["ids"]}

    def read(self, form: str, at: int) -> tuple:
        return self.data.unpack(self.order + form, at)

    def _attribute(self, at: int, place: int, name: str | None, ids: tuple) -> dict:
        config, _, kind, form, flags = self.read("5Q", at + 8)
        return {"place": place, "name": name, "config": config, "sample_type": kind, "read_format": form, "flags": flags, "ids": list(ids)}

    def _listed(self, at: int, size: int) -> list[dict]:
        found = []
        step = self.attr_size + 16 if self.attr_size >= 48 and size % (self.attr_size + 16) == 0 else self.attr_size
        for place, a in enumerate(range(at, at + size, step)):
            ids_at, ids_size = self.read("2Q", a + step - 16)
            found.append(self._attribute(a, place, None, self.read(f"{ids_size // 8}q", ids_at)))
        return found

    def _described(self) -> list[dict]:
        at = self.features[EVENT_DESC][0]
        n, size = self.read("2I", at)
        at, found = at + 8, []
        for place in range(n):
            n_ids, length = self.read("2I", at + size)
            name = _text(self.data[at + size + 8 : at + size + 8 + length])
            found.append(self._attribute(at, place, name, self.read(f"{n_ids}q", at + size + 8 + length)))
            at += size + 8 + length + 8 * n_ids
        return found

    def _check_attributes(self) -> None:
        """What lets a record be read before its attribute is known must be the same in all attributes."""
        if not self.attributes:
            raise ValueError("no event attributes")
        main = self.attributes[0]
        if main["sample_type"] & READ and not main["read_format"] & READ_BY_ID:
            raise ValueError("read values without ids")
        for a in self.attributes:
            if _id_places(a["sample_type"]) != _id_places(main["sample_type"]):
                raise ValueError("event attributes that differ in the place of the id")
            if (a["flags"] ^ main["flags"]) & SAMPLE_ID_ALL:
                raise ValueError("event attributes that differ in sample_id_all")
            if a["read_format"] != main["read_format"]:
                raise ValueError("event attributes that differ in read_format")

    def texts(self) -> Iterator[tuple[str, str]]:
        for n, key in TEXTS.items():
            if n in self.features:
                at = self.features[n][0]
                yield key, _text(self.data[at + 4 : at + 4 + self.read("I", at)[0]])
        if 7 in self.features:
            yield "n_cpus", str(self.read("2I", self.features[7][0])[0])
        if 10 in self.features:
            yield "total_memory_kb", str(self.read("Q", self.features[10][0])[0])
        if 11 in self.features:
            at, words = self.features[11][0], []
            (n,), at = self.read("I", at), at + 4
            for _ in range(n):
                length = self.read("I", at)[0]
                words.append(_text(self.data[at + 4 : at + 4 + length]))
                at += 4 + length
            yield "command_line", " ".join(words)

    @property
    def end(self) -> int:
        return len(self.data) if self.growing and not self.size else min(self.begin + self.size, len(self.data))

    def following(self, at: int) -> int | None:
        """Where the record after the one at ``at`` begins; None for a record of impossible size, which ends the scan."""
        if at + 8 > self.end:
            return None
        kind, _, size = self.read("IHH", at)
        if size < 8 or at + size > self.end:
            return None
        return at + size + (self.read("Q", at + 8)[0] if kind == AUXTRACE and size >= 16 else 0)

    def walked(self, at: int, stop: int) -> tuple[int, int, bool]:
        """From a record on: the first place at or beyond ``stop`` where one begins, how many there are before it, and whether the scan ends
        there."""
        n = 0
        while at < stop:
            after = self.following(at)
            if after is None:
                return at, n, True
            at, n = after, n + 1
        return at, n, False

    def guessed(self, begin: int, stop: int) -> int | None:
        """A place from ``begin`` on, within the largest record's length, from which a chain of plausible records leads on."""
        for start in range(begin + -(begin - self.begin) % 8, min(stop, begin + LARGEST, self.end), 8):
            at = start
            for _ in range(SURE):
                if at >= stop or at == self.end:
                    break
                kind, _, size = self.read("IHH", at) if at + 8 <= self.end else (0, 0, 0)
                after = self.following(at) if size and size % 8 == 0 and (0 < kind < 32 or 64 <= kind < 96) else None
                if after is None:
                    at = None
                    break
                at = after
            if at is not None:
                return start
        return None

    def events(self, at: int | None = None, stop: int | None = None, seq: int = 0, kinds: frozenset | None = None) -> Iterator[dict]:
        """Records of the known ``kinds`` (all by default) in the order of the file, from a record on, of number ``seq``, to ``stop``."""
        at, stop = self.begin if at is None else at, self.end if stop is None else stop
        while at < stop:
            after = self.following(at)
            if after is None:
                return
            kind, misc, size = self.read("IHH", at)
            if kind in KINDS and (kinds is None or KINDS[kind] in kinds):
                yield {"seq": seq, "kind": KINDS[kind], **(self._sample(at + 8) if kind == SAMPLE else self._record(kind, misc, at + 8, at + size))}
            seq += 1
            at = after

    def _of(self, at: int, end: int | None = None) -> dict:
        """The attribute of a sample, or of another record by its ``end``: by the id at its fixed place; of no id the first."""
        main = self.attributes[0]
        places = _id_places(main["sample_type"])
        if len(self.attributes) > 1 and places:
            event = self.read("q", at + places[0] if end is None else end - places[1])[0]
            if event and event not in self.by_id:
                raise ValueError(f"unknown event id {event}")
            return self.by_id.get(event, main)
        return main

    def tools(self, at: int | None = None, stop: int | None = None, seq: int = 0) -> Iterator[dict]:
        """Records that the recording tool itself wrote, a row for each of their entries; one row, of no place, if there is none."""
        at, stop = self.begin if at is None else at, self.end if stop is None else stop
        while at < stop and (after := self.following(at)) is not None:
            kind, _, size = self.read("IHH", at)
            if kind in TOOL_KINDS:
                n = -1
                for n, entry in enumerate(self._entries(kind, at + 8, at + size)):
                    yield {"seq": seq, "kind": TOOL_KINDS[kind], "place": n, **entry}
                if n < 0:
                    yield {"seq": seq, "kind": TOOL_KINDS[kind]}
            at, seq = after, seq + 1

    def _entries(self, kind: int, at: int, end: int) -> Iterator[dict]:
        if kind == ID_INDEX:
            for i in range(min(self.read("Q", at)[0], (end - at - 8) // 32)):
                yield dict(zip(("id", "idx", "cpu", "tid"), self.read("4q", at + 8 + 32 * i)))
        elif kind == THREAD_MAP:
            for i in range(min(self.read("Q", at)[0], (end - at - 8) // 24)):
                yield {"tid": self.read("q", at + 8 + 24 * i)[0], "name": _text(self.data[at + 16 + 24 * i : at + 32 + 24 * i])}
        elif kind == CPU_MAP:
            yield from ({"cpu": cpu} for cpu in self._cpus(at))

    def _cpus(self, at: int) -> Iterator[int]:
        """Cpus of a map as a list, a mask of words of 4 or 8 bytes, or a range; -1 stands for any."""
        form = self.read("H", at)[0]
        if form == 0:
            n = self.read("H", at + 2)[0]
            yield from (-1 if c == 0xFFFF else c for c in self.read(f"{n}H", at + 4))
        elif form == 1:
            n, width = self.read("2H", at + 2)
            for i, word in enumerate(self.read(f"{n}{'I' if width == 4 else 'Q'}", at + (6 if width == 4 else 10))):
                yield from (8 * width * i + bit for bit in range(8 * width) if word >> bit & 1)
        elif form == 2:
            anywhere, _, first, last = self.read("2B2H", at + 2)
            yield from [-1] * bool(anywhere)
            yield from range(first, last + 1)
        else:
            raise ValueError(f"unknown form {form} of a cpu map")

    def build_ids(self) -> Iterator[dict]:
        """The build ids that the header lists by file."""
        at, size = self.features.get(BUILD_IDS, (0, 0))
        stop = at + size
        while at + 8 <= stop:
            _, misc, size = self.read("IHH", at)
            if size < 36 or at + size > stop:
                return
            length = min(20, self.data[at + 32 : at + 33][0]) if misc & BUILD_ID_SIZE else 20
            yield {"pid": self.read("i", at + 8)[0], "build_id": self.data[at + 12 : at + 12 + length].hex(), "filename": _text(self.data[at + 36 : at + size])}
            at += size

    def _sample(self, at: int) -> dict:
        a, row = self._of(at), {}
        kind = a["sample_type"]
        for bit, form, names in ((IDENTIFIER, "q", ["event_id"]), (IP, "q", ["ip"]), (TID, "2i", ["pid", "tid"]), (TIME, "q", ["ts"]), (ADDR, "q", ["addr"]), (ID, "q", ["event_id"]), (STREAM, "q", []), (CPU, "2I", ["cpu"]), (PERIOD, "q", ["period"])):
            if kind & bit:
                row.update(zip(names, self.read(form, at)))
                at += 8
        if kind & READ:
            form = a["read_format"]
            times, each = bin(form & 3).count("1"), 1 + bool(form & 4) + bool(form & 16)
            at += 8 * (1 + times + each * self.read("Q", at)[0] if form & 8 else times + each)
        if kind & CALLCHAIN:
            row["ips"] = list(self.read(f"{self.read('Q', at)[0]}q", at + 8))
        return row

    def _record(self, kind: int, misc: int, at: int, end: int) -> dict:
        row: dict = {}
        if self.attributes[0]["flags"] & SAMPLE_ID_ALL:
            bits = self._of(at, end)["sample_type"]
            for bit, form, names in ((IDENTIFIER, "q", ["event_id"]), (CPU, "2I", ["cpu"]), (STREAM, "q", []), (ID, "q", ["event_id"]), (TIME, "q", ["ts"]), (TID, "2i", [])):
                if bits & bit:
                    end -= 8
                    row.update(zip(names, self.read(form, end)))
        if kind in (FORK, EXIT):
            row["pid"], row["ppid"], row["tid"], _, row["ts"] = self.read("4iq", at)
            return row
        row["pid"], row["tid"] = self.read("2i", at)
        if kind == COMM:
            return row | {"name": _text(self.data[at + 8 : end])}
        row["addr"], row["len"], row["page_offset"] = self.read("3q", at + 8)
        if misc & BUILD_ID:
            row["build_id"] = self.data[at + 36 : at + 36 + min(20, self.data[at + 32 : at + 33][0])].hex()
        return row | {"name": _text(self.data[at + 64 : end])}


def _batches(path: str, rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of a bounded length, with the columns of ``schema``."""
    named = [c.split() for c in schema.split(",")]
    held: dict[str, list] = {n: [] for n, _ in named}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[n], ARROW[kind]) for n, kind in named], [n for n, _ in named])

    for row in rows:
        for n in held:
            held[n].append(path if n == "path" else row.get(n))
        if len(held["path"]) == BATCH:
            yield batch()
            held = {n: [] for n in held}
    yield batch()


ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def _parsed(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """What ``rows`` reads of the header of each file."""
    files = listed(spark, path)
    whole = not reachable(files)
    if whole:
        files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for r in table.to_pylist():
                yield from _batches(r["path"], rows(Recording(r["content"] if whole else View(opened(r["path"])))), schema)

    return files.mapInArrow(run, schema)


def segments(spark: SparkSession, path: str, size: int = RANGE) -> list[tuple[str, int, int, int]]:
    """``(path, start, stop, seq)``: the files cut where records begin, about every ``size`` bytes; ``seq`` is the number of the first
    record in its file. What reaches the driver is a row for each range."""
    files = listed(spark, path)
    each = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}")))).alias("place"))
    each = each.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for r in table.to_pylist():
                with opened(r["path"]) as file:
                    recording = Recording(View(file))
                    begin, stop = max(recording.begin, r["place"] * size), min(recording.end, (r["place"] + 1) * size)
                    row = {"place": r["place"], "begin": begin, "stop": stop}
                    if begin < stop:
                        start = begin
                        if begin > recording.begin:
                            recording.data.hold(begin, min(begin + 4 * LARGEST, stop) + 64)
                            start = recording.guessed(begin, stop)
                        if start is not None:
                            recording.data.hold(start, stop + 64)
                            at, n, over = recording.walked(start, stop)
                            row |= {"start": start, "exit": at, "n": n, "over": int(over)}
                    yield from _batches(r["path"], iter([row]), GUESSES)

    found: dict[str, list] = {}
    for r in each.mapInArrow(run, GUESSES).orderBy("path", "place").collect():
        if r["begin"] < r["stop"]:
            found.setdefault(r["path"], []).append(r)
    out = []
    for name, guesses in found.items():
        at, seq, recording = guesses[0]["begin"], 0, None
        for r in guesses:
            if at >= r["stop"]:  # data that follows a record fills the range
                continue
            after, n, over = r["exit"], r["n"], bool(r["over"])
            if r["start"] != at:
                recording = recording or Recording(View(opened(name)))
                recording.data.hold(at, r["stop"] + 64)
                after, n, over = recording.walked(at, r["stop"])
            if n:
                out.append((name, at, r["stop"], seq))
            at, seq = after, seq + n
            if over:
                break
    return out


GUESSES = "path string, place long, begin long, stop long, start long, exit long, n long, over long"


def events(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None, size: int = RANGE) -> DataFrame:
    """A row for each comm, exit, fork, mmap2 and sample record, or those of ``kinds``; ``seq`` is its place in the file. u64 values are two's
    complement. Records of other kinds aren't decoded, and only ``columns`` leave Python."""
    schema = ",".join(c for c in EVENTS.split(",") if columns is None or c.split()[0] in ("path", *columns))
    wanted = None if kinds is None else frozenset(kinds)
    return _read(spark, path, schema, lambda r, *span: r.events(*span, kinds=wanted), size)


def _read(spark: SparkSession, path: str, schema: str, rows, size: int) -> DataFrame:
    """What ``rows`` reads of the records of each range, or of the whole file where there are no ranges."""
    if not reachable(listed(spark, path)):
        return _parsed(spark, path, schema, rows)
    cut = segments(spark, path, size)
    if not cut:  # nothing but headers; what is no recording fails here
        return _parsed(spark, path, schema, rows)
    tasks = spark.createDataFrame(cut, "path string, start long, stop long, seq long").repartition(len(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for r in table.to_pylist():
                with opened(r["path"]) as file:
                    recording = Recording(View(file))
                    recording.data.hold(r["start"], r["stop"] + LARGEST)
                    yield from _batches(r["path"], rows(recording, r["start"], r["stop"], r["seq"]), schema)

    return tasks.mapInArrow(run, schema)


def tools(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Records of the recording tool, a row for each entry: marks of finished rounds and of the finished start, ``id_index`` (id, idx,
    cpu, tid), ``thread_map`` (tid, name) and ``cpu_map`` (cpu, -1 for any) whichever way it is written. ``seq`` is the record's place
    in the file, as in :func:`events`, ``place`` the entry's in the record, null for a record without entries."""
    return _read(spark, path, TOOLS, Recording.tools, size)


def build_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(path, pid, build_id, filename)`` as the headers list them, for :func:`emberstack.operators.symbols.build_ids`."""
    return _parsed(spark, path, FILE_IDS, Recording.build_ids)


def attributes(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, ATTRIBUTES, lambda r: iter(r.attributes))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, METADATA, lambda r: ({"key": k, "value": v} for k, v in r.texts()))


def samples(events: DataFrame) -> DataFrame:
    """Samples with a thread and a time, their call chains without context markers."""
    rows = events.where("kind = 'sample' and tid is not null and ts is not null")
    return rows.withColumn("ips", F.expr("filter(ips, x -> not (x between -4095 and -1))"))


def modules(events: DataFrame) -> DataFrame:
    """The mappings as ``(path, pid, module_id, base, size, load_ts, page_offset, build_id, filename)``."""
    return events.where("kind = 'mmap2'").select("path", "pid", F.col("seq").alias("module_id"), F.col("addr").alias("base"), F.col("len").alias("size"), F.col("ts").alias("load_ts"), "page_offset", "build_id", F.col("name").alias("filename"))
