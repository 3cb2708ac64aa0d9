"""Byte ranges of large files, read by the tasks that need them.

Spark lists the files; a task opens its file by Arrow's file systems and reads its range alone, so a file may be of any size and
is read by all tasks. Stores that Arrow doesn't know are read whole by Spark's ``binaryFile`` source instead.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of the files at ``path``: a file, a folder or a pattern. No content is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def opened(path: str) -> pa.NativeFile:
    """A file of random access."""
    local = re.sub("^file:/+", "/", path)
    system, name = fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)
    return system.open_input_file(name)


def reachable(files: DataFrame) -> bool:
    """Whether Arrow can open what Spark has listed; of no files it can."""
    first = files.select("path").head()
    if first is None:
        return True
    try:
        opened(first["path"]).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, pa.ArrowKeyError):  # a scheme that only Spark reads
        return False
    return True


class View:
    """A file's bytes by their places; one window is held, the rest is read as it is asked for."""

    def __init__(self, file: pa.NativeFile | bytes):
        self.file = file
        self.size = len(file) if isinstance(file, bytes) else file.size()
        self.begin, self.held = 0, file if isinstance(file, bytes) else b""

    def hold(self, begin: int, end: int) -> None:
        """Hold [begin, end), as far as the file goes."""
        if not isinstance(self.file, bytes):
            end = max(begin, min(end, self.size))
            self.begin, self.held = begin, self.file.read_at(end - begin, begin)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        begin, end = at.start or 0, min(self.size if at.stop is None else at.stop, self.size)
        if self.begin <= begin and end <= self.begin + len(self.held):
            return self.held[begin - self.begin : max(begin, end) - self.begin]
        return self.file.read_at(max(0, end - begin), begin)

    def unpack(self, form: str, at: int) -> tuple:
        """As ``struct.unpack_from`` of the whole file."""
        size = struct.calcsize(form)
        if self.begin <= at and at + size <= self.begin + len(self.held):
            return struct.unpack_from(form, self.held, at - self.begin)
        return struct.unpack(form, self[at : at + size])
