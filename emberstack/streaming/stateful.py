"""Operators over event tables that grow and arrive out of order, with what they wait for kept in state.

Rows of a key are held until the watermark has passed their time and are then taken in the order of time and number, so rows that
are shuffled within the watermark's delay give what the batch operators give over the finished table. A row that comes after
its time was taken is not taken any more; it comes out marked ``late``. What is held is a list for each key, timers release it,
and what waits for a partner that never comes expires.

These need Spark's RocksDB state store: see :data:`PROVIDER`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key in the order of ``us`` (microseconds) and ``seq``, once the watermark has passed them.

    A subclass says which columns are held, what a row changes in the key's memory (JSON) and gives out (:meth:`step`), what
    a late row gives out (:meth:`late`), and when and how what waits in memory expires (:meth:`expired`).
    """

    columns: str
    out: str

    def _rows(self, values: Iterator[tuple]) -> Iterator[Row]:
        named = Row(*[c.split()[0] for c in self.out.split(", ")])
        return (named(*v) for v in values)

    def step(self, key: tuple, memory: dict, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def late(self, key: tuple, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def expiry(self, memory: dict) -> int | None:
        """When something in memory expires, in milliseconds."""
        return None

    def expired(self, key: tuple, memory: dict, watermark: int) -> Iterator[tuple]:
        yield from ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.columns)
        self.memory = handle.getValueState("memory", "value string")
        self.mark = handle.getValueState("mark", "released long, timer long")

    def _marked(self) -> tuple[int, int | None]:
        return tuple(self.mark.get()) if self.mark.exists() else (-(2**62), None)

    def _wake(self, at: int, timer: int | None) -> int:
        if timer is None or at < timer:
            self.handle.registerTimer(at)
            return at
        return timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        released, timer = self._marked()
        names, fresh = [c.split()[0] for c in self.columns.split(", ")], []
        for row in rows:
            own = tuple(row[n] for n in names)
            if own[0] // 1000 < released:
                yield from self._rows(self.late(key, own))
            else:
                fresh.append(own)
        if fresh:
            self.held.appendList(fresh)
            self.mark.update((released, self._wake(max(0, min(r[0] for r in fresh) // 1000 + 1), timer)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[:2]) if self.held.exists() else []
        due = [r for r in rows if r[0] // 1000 < watermark]
        rest = rows[len(due) :]
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        for row in due:
            yield from self._rows(self.step(key, memory, row))
        yield from self._rows(self.expired(key, memory, watermark))
        self.held.put(rest) if rest else self.held.clear()
        self.memory.update((json.dumps(memory),))
        times = [t for t in (rest[0][0] // 1000 + 1 if rest else None, self.expiry(memory)) if t is not None]
        self.mark.update((max(watermark, self._marked()[0]), self._wake(max(watermark + 1, min(times)), None) if times else None))


def _run(rows: DataFrame, late: str, processor: InOrder, mode: str = "Append") -> DataFrame:
    spark = rows.sparkSession
    if spark.conf.get(SETTING, "") != PROVIDER:
        raise ValueError(f"set {SETTING} to {PROVIDER}")
    # Without a column of event time Spark itself drops no late row, so they can be reported.
    timed = rows.withWatermark("time", late).withColumn("us", F.unix_micros("time")).drop("time")
    return timed.groupBy("key").transformWithState(processor, StructType.fromDDL(processor.out), mode, "EventTime")


class _Deltas(InOrder):
    columns = "us long, seq long, value double"
    out = "key long, seq long, delta double, late boolean"

    def step(self, key, memory, row):
        before, value = memory.get("last"), row[2]
        memory["last"] = value
        delta = None if before is None or value is None else value if before > value else value - before
        yield (*key, row[1], delta, False)

    def late(self, key, row):
        yield (*key, row[1], None, True)


def deltas(rows: DataFrame, late: str) -> DataFrame:
    """``rows(key, seq, time, value)`` to ``(key, seq, delta, late)``: as :func:`emberstack.operators.counters.deltas` by time and seq, for rows
    that come in any order within ``late``."""
    return _run(rows.select("key", "seq", "time", F.col("value").cast("double").alias("value")), late, _Deltas())


class _Following(InOrder):
    columns = "us long, seq long, sample_id long, ips array<long>"
    out = "key long, seq long, sample_id long, ips array<long>, late boolean"

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def step(self, key, memory, row):
        us, seq, sample, ips = row
        if ips is None:
            memory.setdefault("pending", []).append([us // 1000, seq, sample])
            return
        for _, own, sample in memory.pop("pending", []):
            yield (*key, own, sample, list(ips), False)

    def late(self, key, row):
        yield (*key, row[1], row[2], None, True)

    def expiry(self, memory):
        pending = memory.get("pending")
        return min(ms for ms, *_ in pending) + self.wait_ms + 1 if pending else None

    def expired(self, key, memory, watermark):
        old = [p for p in memory.get("pending", []) if p[0] + self.wait_ms < watermark]
        if old:
            memory["pending"] = [p for p in memory["pending"] if p[0] + self.wait_ms >= watermark]
            for _, seq, sample in old:
                yield (*key, seq, sample, None, False)


def keyed_stacks(references: DataFrame, bodies: DataFrame, late: str, wait_ms: int) -> DataFrame:
    """``(key, seq, sample_id, ips, late)``: for each of ``references(key, seq, time, sample_id)`` the addresses of the first of
    ``bodies(key, seq, time, ips)`` of its key after it, as :func:`emberstack.operators.temporal.following` finds it.

    A reference waits for a body for ``wait_ms`` of event time, then comes out with null ``ips``. A late body has a null sample_id.
    Both sides are of one stream or of two; the watermark is the slower one's.
    """
    none = F.lit(None)
    own = references.select("key", "seq", "time", "sample_id", none.cast("array<long>").alias("ips"))
    both = own.unionByName(bodies.select("key", "seq", "time", none.cast("long").alias("sample_id"), F.coalesce("ips", F.array().cast("array<long>")).alias("ips")))
    return _run(both, late, _Following(wait_ms))


class _Entries(InOrder):
    columns = "us long, seq long, kind string, payload string"
    out = "key long, start_us long, end_us long, payload string, final boolean, late boolean"

    def step(self, key, memory, row):
        us, _, kind, payload = row
        entry = memory.get("entry")
        if kind == "start":
            if entry is not None and entry["payload"] == payload:
                return
            if entry is not None:
                yield (*key, entry["start"], entry["end"], entry["payload"], True, False)
            memory["entry"] = entry = {"start": us, "end": None, "payload": payload}
        elif entry is None:
            return
        else:
            entry["end"] = us
        yield (*key, entry["start"], entry["end"], entry["payload"], False, False)

    def late(self, key, row):
        yield (*key, row[0] if row[2] == "start" else None, row[0] if row[2] == "end" else None, row[3], False, True)


def entries(events: DataFrame, late: str) -> DataFrame:
    """``(key, start_us, end_us, payload, final, late)``: lives from ``events(key, seq, time, kind, payload)`` of kinds start and end, as
    :func:`emberstack.operators.lifetimes.intervals` gives them.

    An entry comes out each time it changes, open ones with a null end, and is ``final`` once another has begun: the last row of a
    key and start is what is known of it. An end without a start is ignored. The state of a key is its last entry.
    """
    return _run(events.select("key", "seq", "time", "kind", "payload"), late, _Entries(), "Update")


def latest_entries(changes: DataFrame, order: Column) -> DataFrame:
    """What is known of each entry: of the rows that :func:`entries` gave out, in the ``order`` they came, the last of a key and start."""
    own = changes.where("not late")
    last = own.groupBy("key", "start_us").agg(F.max_by(F.struct("end_us", "payload", "final"), F.struct("final", order)).alias("e"))
    return last.select("key", "start_us", "e.end_us", "e.payload", "e.final")
