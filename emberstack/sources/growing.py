"""Recordings that are still being written, as a stream of events.

A micro-batch reads what was appended since the one before: of a perf.data file whole records, of an ETL file whole buffers. The
offset of a file is where its next record or buffer begins and its number; what lies before an offset never changes, so a batch
that is repeated after a failure is the same, and a restarted query goes on where its checkpoint says. New files of a folder
are taken up as they come.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from emberstack.sources import etl, perf_data
from emberstack.sources.ranges import View, opened

NAME = "growing_recording"


@dataclass
class Piece(InputPartition):
    """Records, or buffers, of a file from one that begins at ``at``, of number ``number``, up to ``stop``."""

    path: str
    at: int
    number: int
    stop: int


def _files(path: str, suffix: str) -> list[str]:
    """The recordings at a path, by name; none where there is nothing yet."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = system.get_file_info(name)
    if found.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(name, recursive=True))
    else:
        found = [found]
    start = path[: len(path) - len(name)] if "://" in path else ""
    return sorted(start + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


class PerfFile:
    """Whole records of a perf.data file."""

    suffix = ".data"

    def __init__(self, view: View):
        self.recording = perf_data.Recording(view, growing=True)

    def first(self) -> int:
        return self.recording.begin

    def cut(self, at: int, number: int, stop: int | None, size: int) -> Iterator[tuple[int, int]]:
        """Where pieces of about ``size`` bytes begin, and what follows the last."""
        yield at, number
        end = self.recording.end if stop is None else stop
        while at < end:
            self.recording.data.hold(at, min(end, at + size) + 64)
            after, n, over = self.recording.walked(at, min(end, at + size))
            if after > end:  # what follows a record is not there yet
                after, n = self._before(at, n - 1)
                over = True
            if n:
                yield after, number + n
            at, number = after, number + n
            if over:
                return

    def _before(self, at: int, n: int) -> tuple[int, int]:
        for _ in range(n):
            at = self.recording.following(at)
        return at, n

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        self.recording.data.hold(piece.at, piece.stop)
        yield from perf_data._batches(piece.path, self.recording.events(piece.at, piece.stop, piece.number), perf_data.EVENTS)


class EtlFile:
    """Whole buffers of an ETL file."""

    suffix = ".etl"

    def __init__(self, view: View):
        self.view, self.session = view, etl.session_of(etl.first_buffer(view))

    def first(self) -> int:
        return 0

    def _headers(self, at: int, number: int) -> Iterator[tuple]:
        return etl.headers_of(self.view, self.session, at, number, growing=True)

    def cut(self, at: int, number: int, stop: int | None, size: int) -> Iterator[tuple[int, int]]:
        yield at, number
        last = at
        for n, *_, begin, length in self._headers(at, number):
            if stop is not None and begin >= stop:
                return
            if begin + length - last >= size or stop is None or begin + length == stop:
                last = begin + length
                yield last, n + 1

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        for _, processor, sequence, kept, compressed, form, pointer, at, size in self._headers(piece.at, piece.number):
            if at >= piece.stop:
                return
            found = etl.rows_of(piece.path, processor, sequence, kept, compressed, form, pointer, self.view[at + etl.BUFFER_HEADER : at + size])
            if found:
                yield etl._rows(etl.EVENTS, found)


KINDS = {"perf": (PerfFile, perf_data.EVENTS), "etl": (EtlFile, etl.EVENTS)}


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, kind: str, size: int):
        self.path, self.kind, self.size = path, kind, size
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """By file the place and number of what comes next. Files are followed from where this reader last was; after a restart
        from their beginning, which reads headers alone."""
        kind = KINDS[self.kind][0]
        for name in _files(self.path, kind.suffix):
            with opened(name) as file:
                try:
                    own = kind(View(file))
                except (ValueError, IndexError, struct.error):
                    continue  # its header is not there in full yet
                *_, last = own.cut(*(self.known.get(name) or (own.first(), 0)), None, self.size)
                self.known[name] = list(last)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        kind, pieces = KINDS[self.kind][0], []
        for name, (stop, _) in end.items():
            with opened(name) as file:
                own = kind(View(file))
                at, number = start.get(name) or (own.first(), 0)
                if at < stop:
                    places = list(own.cut(at, number, stop, self.size))
                    pieces += [Piece(name, a, n, b) for (a, n), (b, _) in zip(places, places[1:])]
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        with opened(piece.path) as file:
            yield from KINDS[self.kind][0](View(file)).rows(piece)

    def commit(self, end: dict) -> None:
        self.known.update(end)


class GrowingRecording(DataSource):
    """Options: ``path`` (a file or a folder), ``kind`` (perf or etl), ``piece_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "perf")][1]

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("kind", "perf"), int(self.options.get("piece_bytes", perf_data.RANGE)))


def stream(spark: SparkSession, path: str, kind: str = "perf", piece_bytes: int = perf_data.RANGE) -> DataFrame:
    """The events of the recordings at ``path``, as :func:`emberstack.sources.perf_data.events` or
    :func:`emberstack.sources.etl.events` give them for finished files, as a stream.

    A file whose header is not complete yet has no events. An ETL file's header may say less than the file holds; a perf.data file's
    records end where its header says, or, as long as that says nothing, with the last whole record.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    spark.dataSource.register(GrowingRecording)
    return spark.readStream.format(NAME).option("path", path).option("kind", kind).option("piece_bytes", piece_bytes).load()
