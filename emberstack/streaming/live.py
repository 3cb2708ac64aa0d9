"""Profiles of event tables that grow: counts by window, running hits, and counter deltas kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberstack.operators import hits


def samples_by_window(samples: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Samples of each source in windows of ``samples(time, source_id)``; those later than ``late`` are left out."""
    times = F.window("time", width, slide) if slide else F.window("time", width)
    found = samples.withWatermark("time", late).groupBy(times.alias("w"), "source_id").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source_id", "n")


def bursts(samples: DataFrame, gap: str, late: str) -> DataFrame:
    """Samples of a thread without a gap between them, as sessions of ``samples(time, thread_id)``."""
    found = samples.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("w"), "thread_id").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "thread_id", "n")


def function_hits(frames: DataFrame) -> DataFrame:
    """Running hits of frames that carry ``is_leaf``; the state has a row for each function and source."""
    return hits.function_hits(frames)


def deltas(rows: DataFrame) -> DataFrame:
    """``rows(key, seq, value)`` to ``(key, seq, delta)``, as :func:`emberstack.operators.counters.deltas` gives over a finished table.
    The state of a key is its last value; rows of a key must arrive in the order of ``seq``, within a batch in any order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("seq")
        before = part["value"].shift(1)
        if state.exists and len(part):
            before.iloc[0] = state.get[0]
        delta = (part["value"] - before).where(~(before > part["value"]), part["value"])
        state.update((float(part["value"].iloc[-1]),))
        yield pd.DataFrame({"key": key[0], "seq": part["seq"], "delta": delta.where(before.notna(), None)})

    return rows.groupBy("key").applyInPandasWithState(run, "key long, seq long, delta double", "last double", "append", GroupStateTimeout.NoTimeout)
