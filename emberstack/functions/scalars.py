"""Column functions of the profile model; all are built-ins, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(2**63)


def percent(value: Column, whole: Column) -> Column:
    """0 for an empty whole, else value * 100 / whole in that order."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(value * F.lit(100.0) / whole)


def ticks_to_ns(ticks: Column, start: Column, per_second: int) -> Column:
    """Nanoseconds since the session's start, 0 before it; exact by reducing the fraction."""
    from math import gcd

    g = gcd(10**9, per_second)
    return F.when(ticks.isNotNull(), F.call_function("div", F.greatest(ticks - start, F.lit(0)) * F.lit(10**9 // g), F.lit(per_second // g)))


def unsigned(address: Column) -> Column:
    """A key that orders two's complement addresses as unsigned numbers."""
    return address.bitwiseXOR(F.lit(SIGN))


def wrapping_sum(a: Column, b: Column) -> Column:
    """The sum modulo 2**64, by halves, as ANSI arithmetic fails where it wraps."""
    half = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def wrapping_difference(a: Column, b: Column) -> Column:
    return wrapping_sum(wrapping_sum(a, F.bitwise_not(b)), F.lit(1).cast("long"))


def hex_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(address), 16, "0")))


def generic_symbol(module: Column, address: Column) -> Column:
    """``file!0x...`` by the file's base name, or the address alone without a module."""
    base = F.when(module.contains("\\"), F.substring_index(module, "\\", -1)).otherwise(F.substring_index(module, "/", -1))
    return F.when(module.isNull(), hex_address(address)).otherwise(F.concat(base, F.lit("!"), hex_address(address)))


def is_kernel_address(address: Column, pointer_size: int = 8) -> Column:
    return address >= 2**31 if pointer_size == 4 else (address < 0) | (address >= 0x800000000000)


def without_context_markers(ips: Column) -> Column:
    """Call chains without the markers, which are the topmost 4095 unsigned values."""
    return F.filter(ips, lambda x: ~x.between(-4095, -1))


def root_first(user: Column, kernel: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return F.concat(F.reverse(F.coalesce(user, none)), F.reverse(F.coalesce(kernel, none)))


def unix_micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 in UTC of a timestamp with or without time zone."""
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def ns_to_ticks(ns: Column, per_second: int) -> Column:
    """Ticks of a duration, rounded towards zero; exact by reducing the fraction."""
    from math import gcd

    g = gcd(10**9, per_second)
    return F.call_function("div", ns * F.lit(per_second // g), F.lit(10**9 // g))


def relative_ns(ts: Column, start: Column) -> Column:
    """Nanoseconds since the session's start, 0 before it."""
    return F.when(ts.isNotNull(), F.greatest(ts - start, F.lit(0).cast("long")))


def nt_timestamp(nt: Column) -> Column:
    """A timestamp from 100 ns units since 1601, rounded down to microseconds."""
    since = nt - F.lit(116444736000000000)
    return F.timestamp_micros(F.call_function("div", since - F.pmod(since, F.lit(10)), F.lit(10)))


def session_date(ts: Column) -> Column:
    """Date, hour and minute with the offset of the session's time zone, as 2024-01-31T12:30+0000."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mmZ")


#: Codes of processor architectures.
ARCHITECTURES = {0: "x86", 1: "MIPS", 2: "Alpha", 3: "PowerPC", 5: "ARM", 6: "ia64", 9: "x64", 12: "ARM64"}


def architecture(code: Column) -> Column:
    named = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in ARCHITECTURES.items()])
    return F.coalesce(named, F.lit("[unknown]"))


def equals_ascii(a: Column, b: Column) -> Column:
    """Whether texts are equal but for the case of A-Z."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def trimmed(text: Column) -> Column:
    """Without the white space at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def guid_text(raw: Column, hyphens: bool = True) -> Column:
    """The text of a GUID in 16 bytes as stored: the first three numbers little-endian."""
    byte = lambda i: F.lower(F.lpad(F.hex(F.substring(raw, i + 1, 1)), 2, "0"))
    parts = [F.concat(*[byte(i) for i in places]) for places in ((3, 2, 1, 0), (5, 4), (7, 6), (8, 9), (10, 11, 12, 13, 14, 15))]
    return F.concat_ws("-" if hyphens else "", *parts)


def hex_text(raw: Column) -> Column:
    """Lower-case hex digits of bytes, as of a build id."""
    return F.lower(F.hex(raw))


def utf16_text(raw: Column) -> Column:
    return F.decode(raw, "UTF-16LE")


def root_label(name: Column, pid: Column) -> Column:
    return F.format_string("%s (PID: %d)", name, pid)


def is_recorder(name: Column, command_line: Column) -> Column:
    """Whether a process looks like the one that started the recording."""
    line = F.coalesce(command_line, F.lit(""))
    vs = equals_ascii(name, F.lit("vsdiagnostics.exe")) & line.contains(" start ")
    return vs | (equals_ascii(name, F.lit("xperf.exe")) & (line.contains(" -start ") | line.contains(" -on ")))
