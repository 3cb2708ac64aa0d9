"""Symbols of ELF modules as the tables ``functions`` and ``lines`` of a recording.

A task reads the section headers of a module; its symbol table is then dealt out by pieces and its line programs by unit, so one
large module is read by all tasks. Only layouts are decoded in Python; which symbol stands for a place, which file and line a
function begins at, and where an address lies in the file are joins.

Files must be ones that Arrow can open. Names are the linker's, not demangled. A line is that of the line program, so within
inlined code it is the inlined code's own, while the function is the one that holds it. Compressed debug sections are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberstack.operators import symbols
from emberstack.sources.perf_data import _batches, _text
from emberstack.sources.ranges import View, listed, opened

# Fixed values of the formats.
SYMTAB, DYNSYM, NOBITS, EXECUTABLE, COMPRESSED, FUNCTION = 2, 11, 8, 4, 1 << 11, 2
GLOBAL, WEAK = 1, 2
STRING, LINE_STRP, STRP, UDATA, BLOCK, DATA16 = 0x08, 0x1F, 0x0E, 0x0F, 0x09, 0x1E
SIZES = {0x0B: 1, 0x05: 2, 0x06: 4, 0x07: 8, DATA16: 16}
PATH, DIRECTORY = 1, 2
PIECE = 20_000  # symbols that a task reads at once

SECTIONS = "path string, number long, name string, type long, flags long, address long, offset long, size long, link long, entry long"
PIECES = "path string, begin long, n long, strings long, entry long"
SYMBOLS = "path string, section long, address long, size long, binding long, name string"
UNITS = "path string, begin long, stop long, names long, texts long"
ROWS = "path string, begin long, stop long, file string, line long"


class Module:
    """The section headers of one file."""

    def __init__(self, view: View):
        self.view = view
        head = view[:16]
        if head[:4] != b"\x7fELF" or head[4] not in (1, 2) or head[5] not in (1, 2):
            raise ValueError("not an ELF file")
        self.wide, self.order = head[4] == 2, "<" if head[5] == 1 else ">"
        table = self.read("Q" if self.wide else "I", 40 if self.wide else 32)[0]
        step, n, names = self.read("3H", 58 if self.wide else 46)
        self.sections: list[dict] = []
        if not table:
            return
        first = self._section(table, 0)
        n, names = n or first["size"], first["link"] if names == 0xFFFF else names  # more than two bytes hold
        view.hold(table, table + step * n)
        self.sections = [self._section(table + step * i, i) for i in range(n)]
        for s in self.sections:
            s["name"] = self.text(self.sections[names]["offset"] + s.pop("at"))

    def read(self, form: str, at: int) -> tuple:
        return self.view.unpack(self.order + form, at)

    def _section(self, at: int, number: int) -> dict:
        name, kind, flags, address, offset, size, link, _, _, entry = self.read("2I4Q2I2Q" if self.wide else "10I", at)
        return {"number": number, "at": name, "type": kind, "flags": flags, "address": address, "offset": offset, "size": size, "link": link, "entry": entry}

    def text(self, at: int) -> str:
        """The text that ends with a zero."""
        out, step = b"", 128
        while True:
            piece = self.view[at + len(out) : at + len(out) + step]
            out += piece
            if len(piece) < step or 0 in piece:
                return _text(out)
            step *= 2

    def named(self, name: str) -> dict | None:
        found = next((s for s in self.sections if s["name"] == name and s["type"] != NOBITS), None)
        if found and found["flags"] & COMPRESSED:
            raise ValueError(f"compressed section {name}")
        return found

    def pieces(self) -> Iterator[dict]:
        """The symbol table, else that of dynamic linking, by pieces."""
        tables = [s for kind in (SYMTAB, DYNSYM) for s in self.sections if s["type"] == kind]
        for s in tables[:1]:
            entry = s["entry"] or (24 if self.wide else 16)
            for at in range(0, s["size"] // entry, PIECE):
                yield {"begin": s["offset"] + at * entry, "n": min(PIECE, s["size"] // entry - at), "strings": self.sections[s["link"]]["offset"], "entry": entry}

    def functions(self, begin: int, n: int, strings: int, entry: int) -> Iterator[dict]:
        self.view.hold(begin, begin + n * entry)
        found = []
        for at in range(begin, begin + n * entry, entry):
            if self.wide:
                name, info, _, section, address, size = self.read("I2BH2Q", at)
            else:
                name, address, size, info, _, section = self.read("3I2BH", at)
            if info & 15 == FUNCTION and section and name:
                found.append({"section": section, "address": address, "size": size, "binding": info >> 4, "name": name})
        if found:
            self.view.hold(strings + min(f["name"] for f in found), strings + max(f["name"] for f in found) + 4096)
        for f in found:
            yield f | {"name": self.text(strings + f["name"])}

    def units(self) -> Iterator[dict]:
        """Where line programs begin and end, and the texts they name begin."""
        lines, names, texts = (self.named(s) for s in (".debug_line", ".debug_line_str", ".debug_str"))
        if not lines:
            return
        at, end = lines["offset"], lines["offset"] + lines["size"]
        while at + 4 <= end:
            size, head = self.read("I", at)[0], 4
            if size == 0xFFFFFFFF:
                size, head = self.read("Q", at + 4)[0], 12
            if at + head + size > end:
                raise ValueError("a line program that goes on past its section")
            yield {"begin": at, "stop": at + head + size, "names": names and names["offset"], "texts": texts and texts["offset"]}
            at += head + size


class Program:
    """One line program: its files, and the rows it says."""

    def __init__(self, module: Module, begin: int, stop: int, names: int | None, texts: int | None):
        self.module, self.data, self.at = module, module.view[begin:stop], 4
        self.order, self.strings = module.order, {LINE_STRP: names, STRP: texts}
        self.offset = "I"
        if self.data[:4] == b"\xff" * 4:
            self.offset, self.at = "Q", 12
        self.version = self._take("H")
        self.address = self._take("B") if self.version >= 5 else 8 if module.wide else 4
        if self.version >= 5:
            self._take("B")
        size = self._take(self.offset)
        program = self.at + size
        self.least = self._take("B")
        if self.version >= 4:
            self._take("B")  # operations of an instruction; those of long instruction words count as one
        self._take("B")
        self.base, self.range, self.first = self._take("b"), self._take("B"), self._take("B")
        self.lengths = [self._take("B") for _ in range(self.first - 1)]
        if not 2 <= self.version <= 5 or not self.range:
            self.files, self.at = [], len(self.data)
            return
        self.files = self._tables() if self.version >= 5 else self._lists()
        self.at = program

    def _take(self, form: str) -> int:
        value = struct.unpack_from(self.order + form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return value

    def _uleb(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    def _sleb(self) -> int:
        begin = self.at
        value, bits = self._uleb(), 7 * (self.at - begin)
        return value - (1 << bits) if value >> bits - 1 else value

    def _string(self) -> str:
        end = self.data.index(0, self.at)
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def _lists(self) -> list[str]:
        """Files of versions up to 4, from 1 on; directory 0 is the compiler's, which the program doesn't name."""
        folders, files = [""], [""]
        while folder := self._string():
            folders.append(folder)
        while name := self._string():
            files.append(_joined(folders, self._uleb(), name))
            self._uleb(), self._uleb()
        return files

    def _tables(self) -> list[str]:
        """Files of version 5, from 0 on."""
        folders = [str(e.get(PATH, "")) for e in self._table()]
        folders = [f if f.startswith("/") or not i else f"{folders[0]}/{f}" for i, f in enumerate(folders)]
        return [_joined(folders, int(e.get(DIRECTORY, 0)), str(e.get(PATH, ""))) for e in self._table()]

    def _table(self) -> list[dict]:
        forms = [(self._uleb(), self._uleb()) for _ in range(self._take("B"))]
        return [{what: self._value(form) for what, form in forms} for _ in range(self._uleb())]

    def _value(self, form: int) -> int | str:
        if form == STRING:
            return self._string()
        if form in self.strings:
            at = self._take(self.offset)
            return "" if self.strings[form] is None else self.module.text(self.strings[form] + at)
        if form == UDATA:
            return self._uleb()
        if form == BLOCK:
            self.at += self._uleb()
            return 0
        if form not in SIZES:
            raise ValueError(f"form {form} in a line program")
        begin, self.at = self.at, self.at + SIZES[form]
        return int.from_bytes(self.data[begin : self.at], "little" if self.order == "<" else "big")

    def rows(self) -> Iterator[dict]:
        """Ranges of addresses that are of one file and line. Of rows of one address the last counts."""
        address, file, line, held = 0, 1, 1, None

        def until(end: int) -> Iterator[dict]:
            if held and held[0] < end:
                yield {"begin": held[0], "stop": end, "file": self.files[held[1]] if held[1] < len(self.files) else None, "line": held[2]}

        while self.at < len(self.data):
            code = self._take("B")
            if code >= self.first:
                address += self.least * ((code - self.first) // self.range)
                line += self.base + (code - self.first) % self.range
            elif code == 0:
                size = self._uleb()
                after = self.at + size
                kind = self._take("B") if size else None
                if kind == 2:
                    address = int.from_bytes(self.data[self.at : after], "little" if self.order == "<" else "big")
                elif kind == 1:
                    yield from until(address)
                    address, file, line, held = 0, 1, 1, None
                self.at = after
                continue
            elif code == 2:
                address += self.least * self._uleb()
                continue
            elif code == 3:
                line += self._sleb()
                continue
            elif code == 4:
                file = self._uleb()
                continue
            elif code == 8:
                address += self.least * ((255 - self.first) // self.range)
                continue
            elif code == 9:
                address += self._take("H")
                continue
            elif code != 1:
                for _ in range(self.lengths[code - 1]):
                    self._uleb()
                continue
            yield from until(address)
            held = (address, file, line)


def _joined(folders: list[str], folder: int, name: str) -> str:
    before = folders[folder] if folder < len(folders) else ""
    return name if name.startswith("/") or not before else f"{before}/{name}"


def _dealt(rows: DataFrame, schema: str, read) -> DataFrame:
    """What ``read(module, row)`` says of each of ``rows(path, ...)``, which all tasks share."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, Module] | None = None
        for table in batches:
            for r in table.to_pylist():
                if held is None or held[0] != r["path"]:
                    held = (r["path"], Module(View(opened(r["path"]))))
                yield from _batches(r["path"], _signed(read(held[1], r)), schema)

    return rows.repartition(n, *rows.columns).mapInArrow(run, schema)


def _signed(rows: Iterator[dict]) -> Iterator[dict]:
    """Unsigned numbers as two's complement."""
    for row in rows:
        yield {k: v - (1 << 64) if isinstance(v, int) and v >> 63 else v for k, v in row.items()}


def sections(spark: SparkSession, path: str) -> DataFrame:
    return _dealt(listed(spark, path).select("path"), SECTIONS, lambda m, r: iter([dict(s) for s in m.sections]))


def _in_file(rows: DataFrame, code: DataFrame) -> DataFrame:
    """``rows(path, begin, stop, ...)`` of addresses as places in the file: of the section of code, a handful in each module, that holds
    their begin; they end with it at the latest. Rows of none go, as those of code that the linker has left out."""
    held = (F.col("path") == F.col("c_path")) & (F.col("begin") >= F.col("address")) & (F.col("begin") < F.col("address") + F.col("bytes"))
    to = F.col("offset") - F.col("address")
    found = rows.join(code, held).withColumns({"rel_begin": F.col("begin") + to, "rel_end": F.least("stop", F.col("address") + F.col("bytes")) + to})
    return found.select(*[c for c in rows.columns if c not in ("begin", "stop")], "rel_begin", "rel_end")


def symbol_tables(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """``functions(module, rel_begin, rel_end, symbol, file, func_line)`` and ``lines(module, rel_begin, rel_end, instr_line)`` of the ELF
    files at ``path``, for :func:`emberstack.sources.open.open_recording`.

    A module's name is its path without ``root``, such as that of a copy of another machine's files. Addresses are places in the
    file, as mappings name them. Of symbols that begin at one address a global one counts, then a weak one, then the least name; one
    without a size goes up to the next or its section's end. Of the line programs ``file`` and ``func_line`` are what they say of a
    function's begin, null if nothing. A file that is no ELF file is an error; one without symbols or sections gives no rows.
    """
    files = listed(spark, path).select("path")
    module = F.regexp_replace("path", "^file:/+", "/")
    module = F.when(module.startswith(root), F.substring(module, len(root) + 1, 1 << 30)).otherwise(module) if root else module
    code = sections(spark, path).where(F.col("flags").bitwiseAND(EXECUTABLE) != 0).where(F.col("type") != NOBITS)
    code = code.select(F.col("path").alias("c_path"), F.col("number").alias("c_number"), "address", F.col("size").alias("bytes"), "offset")
    said = _dealt(_dealt(files, UNITS, lambda m, r: m.units()), ROWS, lambda m, r: Program(m, r["begin"], r["stop"], r["names"], r["texts"]).rows())
    lines = _in_file(said, code).select(module.alias("module"), "rel_begin", "rel_end", "file", F.col("line").alias("instr_line"))

    read = ("begin", "n", "strings", "entry")
    found = _dealt(_dealt(files, PIECES, lambda m, r: m.pieces()), SYMBOLS, lambda m, r: m.functions(*[r[c] for c in read]))
    rank = F.when(F.col("binding") == GLOBAL, 0).when(F.col("binding") == WEAK, 1).otherwise(2)
    best = found.groupBy("path", "section", "address").agg(F.min_by(F.struct("name", "size"), F.struct(rank, "name", "size")).alias("s"))
    following = F.lead("address", 1, 2**63 - 1).over(Window.partitionBy("path", "section").orderBy("address"))  # the functions of one module
    spans = best.withColumn("next", following).select("path", F.col("address").alias("begin"), F.when(F.col("s.size") > 0, F.col("address") + F.col("s.size")).otherwise(F.col("next")).alias("stop"), F.col("s.name").alias("symbol"))
    spans = _in_file(spans, code).select(module.alias("module"), "rel_begin", "rel_end", "symbol")
    begun = symbols.in_range(spans.withColumn("rel", F.col("rel_begin")), lines, ["file", "instr_line"])
    functions = begun.select("module", "rel_begin", "rel_end", "symbol", "file", F.col("instr_line").alias("func_line"))
    return functions, lines.select("module", "rel_begin", "rel_end", "instr_line")
