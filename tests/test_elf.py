"""Symbols of ELF modules: files made here in both byte orders and widths, and, where there is an assembler, its own against what was
assembled."""

from __future__ import annotations

import shutil
import struct
import subprocess

import pytest

from emberstack.sources import elf
from emberstack.sources import open as opener
from emberstack.operators import symbols

TEXT_AT, TEXT_ADDRESS = 0x200, 0x401000
FUNCS = [("outer", 0x401000, 5, 0x12), ("alias", 0x401000, 5, 0x22), ("_own", 0x401000, 5, 0x02), ("nosize", 0x401008, 0, 0x02), ("last", 0x401020, 0, 0x12), ("datum", 0x401004, 4, 0x11)]


def _program(order: str, wide: bool, version: int) -> tuple[bytes, bytes]:
    """A line program of two sequences, and the texts it names: its opcodes are special from 13 on, base -3, range 12."""
    size = 8 if wide else 4

    def address(at):
        return bytes([0, size + 1, 2]) + at.to_bytes(size, "little" if order == "<" else "big")

    body = address(0x401000) + bytes([3, 9, 1])  # line 10
    body += bytes([13 + 12 * 1 + 4])  # one on, line + 1
    body += bytes([2, 1, 4, 2, 3, 0xA1, 2, 1])  # one on, file 2, line + 289 = 300
    body += bytes([3, 0xDD, 0x7D, 4, 1]) + bytes([9]) + struct.pack(order + "H", 2) + bytes([1])  # two on, file 1, line 9
    body += bytes([8, 1])  # 20 on, the same line
    body += bytes([0x0C, 0, 0, 3, 0x80, 9, 9])  # an instruction set, an unknown extended opcode
    body += bytes([2, 0x10, 0, 1, 1])  # the end at 0x401028
    body += address(0) + bytes([1, 2, 8, 0, 1, 1])  # code that the linker has left out
    texts = b"/src\0inc\0"
    lengths = bytes([0, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 1])
    fixed = bytes([1] + ([1] if version >= 4 else []) + [1, 0xFD, 12, 13]) + lengths
    if version >= 5:
        tables = bytes([1, 1, 0x1F, 2]) + struct.pack(order + "2I", 0, 5)
        tables += bytes([3, 1, 8, 2, 0x0B, 5, 0x1E, 3]) + b"".join(name + bytes([0, folder]) + bytes(16) for name, folder in ((b"a.c", 0), (b"a.c", 0), (b"b.h", 1)))
        head = struct.pack(order + "H2BI", version, size, 0, len(fixed + tables))
    else:
        tables = b"/src\0/src/inc\0\0" + b"a.c\0" + bytes([1, 0, 0]) + b"b.h\0" + bytes([2, 0xFF, 1, 0]) + b"\0"
        head = struct.pack(order + "HI", version, len(fixed + tables))
    unit = head + fixed + tables + body
    return struct.pack(order + "I", len(unit)) + unit, texts


def _module(order: str = "<", wide: bool = True, version: int = 5, flags: int = 0, tables: bool = True) -> bytes:
    lines, texts = _program(order, wide, version)
    names, strings, symtab = b"\0", b"\0", bytes(24 if wide else 16)
    for name, address, size, info in FUNCS:
        at = len(strings)
        strings += name.encode() + b"\0"
        symtab += struct.pack(order + "I2BH2Q", at, info, 0, 1, address, size) if wide else struct.pack(order + "3I2BH", at, address, size, info, 0, 1)
    undefined = len(strings)
    strings += b"imported\0"
    symtab += struct.pack(order + "I2BH2Q", undefined, 0x12, 0, 0, 0, 0) if wide else struct.pack(order + "3I2BH", undefined, 0, 0, 0x12, 0, 0)
    made = [("", 0, 0, 0, b"", 0, 0), (".text", 1, 6, TEXT_ADDRESS, bytes(0x30), 0, 0)]
    if tables:
        made += [(".symtab", 2, 0, 0, symtab, 3, 24 if wide else 16), (".strtab", 3, 0, 0, strings, 0, 0), (".debug_line", 1, flags, 0, lines * 2, 0, 0), (".debug_line_str", 1, 0, 0, texts, 0, 0)]
    made.append((".shstrtab", 3, 0, 0, b"", 0, 0))
    at, body, headers = TEXT_AT, b"", b""
    places = []
    for name, *_ in made:
        places.append(len(names))
        names += name.encode() + b"\0"
    for place, (name, kind, flag, address, content, link, entry) in zip(places, made):
        content = names if name == ".shstrtab" else content
        headers += struct.pack(order + ("2I4Q2I2Q" if wide else "10I"), place, kind, flag, address, at + len(body), len(content), link, 0, 1, entry)
        body += content
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2, 1]) + bytes(9)
    form, step = ("HHIQQQIHHHHHH", 64) if wide else ("HHIIIIIHHHHHH", 40)
    head = ident + struct.pack(order + form, 3, 62, 1, 0, 0, at + len(body), 0, 64, 0, 0, step, len(made), len(made) - 1)
    return head.ljust(TEXT_AT, b"\0") + body + headers


@pytest.mark.parametrize("order, wide, version", [("<", True, 5), (">", True, 4), ("<", False, 3), (">", False, 5), ("<", True, 2)])
def test_functions_and_lines(spark, tmp_path, monkeypatch, order, wide, version):
    monkeypatch.setattr(elf, "PIECE", 3)
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.so").write_bytes(_module(order, wide, version))
    (tmp_path / "lib/bare.so").write_bytes(_module(order, wide, version, tables=False))
    functions, lines = elf.symbol_tables(spark, str(tmp_path / "lib"), str(tmp_path))
    to = TEXT_AT - TEXT_ADDRESS
    inc = "/src/inc/b.h"
    assert sorted(map(tuple, functions.collect())) == sorted([
        ("/lib/a.so", 0x200, 0x205, "outer", "/src/a.c", 10), ("/lib/a.so", 0x208, 0x220, "nosize", "/src/a.c", 9), ("/lib/a.so", 0x220, 0x230, "last", "/src/a.c", 9)])
    want = [("/lib/a.so", a + to, b + to, n) for a, b, n in ((0x401000, 0x401001, 10), (0x401001, 0x401002, 11), (0x401002, 0x401004, 300), (0x401004, 0x401018, 9), (0x401018, 0x401028, 9))]
    assert sorted(map(tuple, lines.collect())) == sorted(want * 2)
    assert functions.columns == [c.split()[0] for c in opener.FUNCTIONS.split(", ")] and lines.columns == [c.split()[0] for c in opener.LINES.split(", ")]
    asked = spark.createDataFrame([("/lib/a.so", 0x202, 1), ("/lib/a.so", 0x207, 2), ("/lib/a.so", 0x221, 3), ("/lib/b.so", 0x202, 4)], "module string, rel long, ip long")
    got = {r.ip: (r.symbol, r.file, r.func_line, r.instr_line) for r in symbols.resolved(asked, functions, lines).collect()}
    assert got == {1: ("outer", "/src/a.c", 10, 300), 2: ("a.so!0x0000000000000002", None, None, 9), 3: ("last", "/src/a.c", 9, 9), 4: ("b.so!0x0000000000000004", None, None, None)}
    rows = list(elf.Program(m := elf.Module(elf.View(_module(order, wide, version))), *[next(m.units())[c] for c in ("begin", "stop", "names", "texts")]).rows())
    assert {r["file"] for r in rows} == {"/src/a.c", inc}


def test_what_is_no_module(spark, tmp_path):
    (tmp_path / "a.so").write_bytes(b"#!/bin/sh\n" * 10)
    with pytest.raises(Exception, match="not an ELF file"):
        elf.sections(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="compressed section .debug_line"):
        list(elf.Module(elf.View(_module(flags=elf.COMPRESSED))).units())
    cut = _module()
    at = cut.index(_program("<", True, 5)[0])
    with pytest.raises(ValueError, match="past its section"):
        list(elf.Module(elf.View(cut[:at] + struct.pack("<I", 1 << 20) + cut[at + 4 :])).units())


ASSEMBLY = """
  .text
  .globl outer
  .type outer,@function
outer:
  .file 1 "/src/a.c"
  .file 2 "/src/b.h"
  .loc 1 10
  nop
  .loc 1 11
  nop
  .loc 2 300
  nop
  nop
  .loc 1 9
  ret
  .size outer,.-outer
  .weak alias
  .set alias,outer
  .type alias,@function
  .type nosize,@function
nosize:
  .loc 1 40
  .rept 3000
  nop
  .endr
  .loc 1 4100
  ret
  .section .text.other,"ax"
  .globl third
  .type third,@function
third:
  .loc 1 900
  nop
  ret
  .size third,.-third
"""


@pytest.mark.skipif(not (shutil.which("as") and shutil.which("ld")), reason="no assembler")
@pytest.mark.parametrize("options", [["--gdwarf-5"], ["--gdwarf-4"], ["--gdwarf-3"], ["--gdwarf-2"]])
def test_an_assembled_module(spark, tmp_path, options):
    (tmp_path / "a.s").write_text(ASSEMBLY)
    (tmp_path / "b.s").write_text(ASSEMBLY.replace("outer", "second").replace("third", "fourth").replace("alias", "other").replace("nosize", "free"))
    for name in "ab":
        if subprocess.run(["as", *options, "-o", f"{name}.o", f"{name}.s"], cwd=tmp_path, capture_output=True).returncode:
            pytest.skip("the assembler is of another machine")
    subprocess.run(["ld", "-Ttext=0x7001000", "-e", "outer", "-o", "app", "a.o", "b.o"], cwd=tmp_path, check=True)
    functions, lines = elf.symbol_tables(spark, str(tmp_path / "app"), str(tmp_path))
    found = {r.symbol: r for r in functions.collect()}
    assert set(found) == {"outer", "nosize", "third", "second", "free", "fourth"}
    assert {k: (r.rel_end - r.rel_begin, r.file, r.func_line) for k, r in found.items() if k in ("outer", "second", "third", "fourth")} == {"outer": (5, "/src/a.c", 10), "second": (5, "/src/a.c", 10), "third": (2, "/src/a.c", 900), "fourth": (2, "/src/a.c", 900)}
    asked = [(f"{k}+{at}", found[k].rel_begin + at, line) for k in ("outer", "second") for at, line in enumerate((10, 11, 300, 300, 9))]
    asked += [(f"{k}+{at}", found[k].rel_begin + at, line) for k in ("nosize", "free") for at, line in ((0, 40), (2999, 40), (3000, 4100))]
    rows = spark.createDataFrame([("/app", rel, k) for k, rel, _ in asked], "module string, rel long, k string")
    assert {r.k: r.instr_line for r in symbols.in_range(rows, lines, ["instr_line"]).collect()} == {k: line for k, _, line in asked}
    content = (tmp_path / "app").read_bytes()
    assert content[found["outer"].rel_begin : found["outer"].rel_end] == b"\x90" * 4 + b"\xc3"
