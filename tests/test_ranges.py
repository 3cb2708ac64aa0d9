"""Files read by ranges of bytes against the whole file read at once, with ranges that begin anywhere, and a file above 2 GB."""

from __future__ import annotations

import random
import struct

import pytest

from emberstack.sources import perf_data as perf

KIND = perf.IDENTIFIER | perf.IP | perf.TID | perf.TIME | perf.CALLCHAIN


def _record(kind: int, body: bytes, misc: int = 0) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<IHH", kind, misc, len(body) + 8) + body


def _sample(i: int, chain: list[int]) -> bytes:
    return _record(perf.SAMPLE, struct.pack("<qq2iq", 11, 7 * i, 5, 6 + i % 3, 100 + i) + struct.pack("<Q", len(chain)) + struct.pack(f"<{len(chain)}q", *chain))


def _comm(name: bytes) -> bytes:
    return _record(perf.COMM, struct.pack("<2i", 5, 6) + name + b"\0")


def _head(size: int, flags: int = 0) -> bytes:
    attr = struct.pack("<2I5Q", 0, 48, 0, 1, KIND, 0, flags) + struct.pack("<2Q", 168, 8)
    return b"PERFILE2" + struct.pack("<8Q", 104, 64, 104, 64, 176, size, 0, 0) + struct.pack("<4Q", 0, 0, 0, 0) + attr + struct.pack("<q", 11)


def _data(seed: int) -> bytes:
    rng = random.Random(seed)
    out = []
    for i in range(400):
        chain = [rng.randrange(1 << 20) for _ in range(rng.randrange(9))]
        if i % 40 == 7:
            # What looks like a chain of records, within a record, and leads past its end.
            out.append(_record(perf.SAMPLE, struct.pack("<qq2iq", 11, i, 5, 6, 100 + i) + struct.pack("<Q", 60) + struct.pack("<IHH", 3, 0, 24) * 60))
        elif i % 50 == 9:
            out.append(_record(perf.AUXTRACE, struct.pack("<Q", 3000)) + rng.randbytes(3000))
        elif i % 11 == 3:
            out.append(_comm(b"n" * rng.randrange(40)))
        elif i % 13 == 5:
            out.append(_record(68, b""))
        else:
            out.append(_sample(i, chain))
    return b"".join(out)


def _rows(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("size", [64, 200, 1000, 4096, 1 << 20])
def test_ranges_give_what_the_whole_file_gives(spark, tmp_path, size):
    for seed in (1, 2):
        data = _data(seed)
        (tmp_path / f"{seed}.data").write_bytes(_head(len(data)) + data + b"rest")
    path = str(tmp_path)
    want = _rows(perf._parsed(spark, path, perf.EVENTS, lambda r: r.events()))
    assert len(want) > 600 and _rows(perf.events(spark, path, size=size)) == want
    cut = perf.segments(spark, path, size)
    assert len(cut) > 2 * min(20, len(data) // size // 2) and len({c[1] for c in cut if "1.data" in c[0]}) == sum("1.data" in c[0] for c in cut)
    some = perf.events(spark, path, kinds=("comm",), columns=("seq", "name"), size=size)
    assert some.columns == ["path", "seq", "name"] and _rows(some) == [(r[0], r[1], r[-1]) for r in want if r[2] == "comm"]


def test_a_broken_record_ends_the_scan(spark, tmp_path):
    data = _sample(1, [1, 2]) * 30
    broken = data + struct.pack("<IHH", 9, 0, 4) + data
    (tmp_path / "a.data").write_bytes(_head(len(broken)) + broken)
    for size in (100, 1 << 20):
        assert perf.events(spark, str(tmp_path / "a.data"), size=size).count() == 30
    (tmp_path / "b.data").write_bytes(_head(0))
    assert perf.events(spark, str(tmp_path / "b.data")).count() == 0


def test_a_file_above_two_gigabytes(spark, tmp_path):
    first, last, hole = _data(3), _data(4), 5 << 29
    whole = len(first) + 16 + hole + len(last)
    with open(tmp_path / "large.data", "wb") as f:
        f.write(_head(whole) + first + _record(perf.AUXTRACE, struct.pack("<Q", hole)))
        f.seek(hole, 1)
        f.write(last)
    (tmp_path / "small.data").write_bytes(_head(len(first) + len(last)) + first + last)
    want = [r[2:] for r in _rows(perf._parsed(spark, str(tmp_path / "small.data"), perf.EVENTS, lambda r: r.events()))]
    got = perf.events(spark, str(tmp_path / "large.data"), size=1 << 28)
    assert [r[2:] for r in _rows(got)] == want
    assert perf.attributes(spark, str(tmp_path / "large.data")).count() == 1


def test_one_file_spreads_over_all_tasks(spark, tmp_path):
    data = _sample(1, [1, 2, 3]) * 4000
    (tmp_path / "a.data").write_bytes(_head(len(data)) + data)
    from pyspark.sql import functions as F

    read = perf.events(spark, str(tmp_path / "a.data"), size=len(data) // 16)
    parts = read.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= 8 and sum(r["count"] for r in parts) == 4000 and max(r["count"] for r in parts) <= 1000
