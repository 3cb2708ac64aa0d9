"""Sample filters: time range, processes, threads, modules, and path rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that keep their meaning only when escaped; a fixed value.
ESCAPED = set(r".^$|()[]{}+\ #~&-")


@dataclass(frozen=True)
class SampleFilter:
    """Inclusive times (null: open) and excluded ids; an immutable value, so nothing is ever invalidated."""

    min_time: int | None = None
    max_time: int | None = None
    excluded_processes: tuple[int, ...] = ()
    excluded_threads: tuple[int, ...] = ()


def filtered(samples: DataFrame, f: SampleFilter) -> DataFrame:
    """``samples(ts, process_id, thread_id, ...)`` that pass; all conditions reach the scan. A sample of unknown
    process or thread is of none that is excluded."""
    if f.min_time is not None:
        samples = samples.where(F.col("ts") >= f.min_time)
    if f.max_time is not None:
        samples = samples.where(F.col("ts") <= f.max_time)
    if f.excluded_processes:
        samples = samples.where(~F.coalesce(F.col("process_id").isin(*f.excluded_processes), F.lit(False)))
    if f.excluded_threads:
        samples = samples.where(~F.coalesce(F.col("thread_id").isin(*f.excluded_threads), F.lit(False)))
    return samples


def wildcard_to_regex(pattern: str) -> str:
    """``*`` runs match anything, ``?`` one character, all else itself; the whole string must match."""
    parts = []
    for token in re.findall(r"\*+|\?|.", pattern, re.DOTALL):
        parts.append(".*" if token[0] == "*" else "." if token == "?" else "\\" + token if token in ESCAPED else token)
    return f"^(?:{''.join(parts)})$"


def module_passes(module: Column, exclude: list[str] | None = None, include: list[str] | None = None) -> Column:
    """With ``include``: only modules that match one of its wildcards; else all but those that match one of ``exclude``."""
    patterns = include if include is not None else exclude or []
    hit = F.lit(False)
    for p in patterns:
        hit = hit | module.rlike(wildcard_to_regex(p))
    return hit if include is not None else ~hit


def map_path(path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Rules ``(prefix|regex, from, to)`` in order; the first that changes the path wins."""
    out = path
    for kind, old, new in reversed(rules):
        changed = F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path) if kind == "prefix" else F.regexp_replace(path, old, new)
        out = F.when(changed != path, changed).otherwise(out)
    return out
