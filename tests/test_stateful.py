"""Streams whose rows are shuffled over micro-batches, against the batch operators over the finished table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberstack.operators import counters, lifetimes, temporal
from emberstack.streaming import stateful


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(stateful.SETTING, stateful.PROVIDER)
    yield
    spark.conf.unset(stateful.SETTING)


def _batches(spark, path, rows, schema, shuffle: float, parts: int, seed: int, late=()) -> None:
    """Files to be read one by one: rows move within ``shuffle`` seconds of their time, which is the third column."""
    rng = random.Random(seed)
    moved = sorted(rows, key=lambda r: r[2] + rng.uniform(0, shuffle))
    step = -(-len(moved) // parts)
    chunks = [moved[i : i + step] for i in range(0, len(moved), step)] + [list(late)]
    end = max(r[2] for r in rows)
    for far in (1000, 2000, 3000):  # another key's rows move the watermark past all others
        chunks.append([(-1, -far, end + far, *[None] * (len(rows[0]) - 3))])
    for n, chunk in enumerate(c for c in chunks if c):
        df = spark.createDataFrame(chunk, schema).withColumn("time", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).drop("t")
        df.coalesce(1).write.parquet(f"{path}/{n:03d}")


def _stream(spark, path, name, build, mode="append"):
    schema = spark.read.parquet(f"{path}/000").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    seen = []
    query = build(rows).writeStream.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).outputMode(mode).option("checkpointLocation", f"{path}-check").start()
    query.processAllAvailable()
    query.stop()
    return [r for r in seen if r[1] != -1]


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_of_shuffled_rows(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, i, 100.0 + i * 0.5, float(rng.randrange(100))) for i in range(120) for k in (rng.choice([1, 1, 2]),)]
    late = [(1, 900, 101.25, 5.0)]
    _batches(spark, str(tmp_path / "in"), rows, "key long, seq long, t double, value double", 8, 6, seed, late)
    got = _stream(spark, str(tmp_path / "in"), "d", lambda r: stateful.deltas(r, "10 seconds"))
    want = counters.deltas(spark.createDataFrame(rows, "key long, seq long, t double, value double"), "key", ["t", "seq"], "value")
    assert sorted((k, s, d) for _, k, s, d, is_late in got if not is_late) == sorted((r.key, r.seq, r.delta) for r in want.collect())
    assert [(k, s) for _, k, s, _, is_late in got if is_late] == [(1, 900)]
    order = [s for _, k, s, _, is_late in got if k == 1 and not is_late]
    assert order == sorted(order)


def test_references_whose_bodies_come_later(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        body = rng.random() < 0.3
        rows.append((rng.choice([7, 8, 9]), i, 50.0 + i * 0.4, None if body else 1000 + i, [i, i + 1] if body else None))
    rows.append((6, 500, 60.0, 1500, None))  # nothing ever follows it
    schema = "key long, seq long, t double, sample_id long, ips array<long>"
    _batches(spark, str(tmp_path / "in"), rows, schema, 6, 7, 4)
    build = lambda r: stateful.keyed_stacks(r.where("sample_id is not null or key = -1"), r.where("ips is not null"), "8 seconds", 400_000)
    got = _stream(spark, str(tmp_path / "in"), "k", build)
    table = spark.createDataFrame(rows, schema)
    want = temporal.following(table.where("ips is null").select("key", "seq", "sample_id"), table.where("ips is not null").select("key", "seq", "ips"), "key", "seq", "ips")
    text = lambda rows: sorted(map(str, rows))
    assert text((k, s, i, None if ips is None else list(ips)) for _, k, s, i, ips, _ in got) == text((r.key, r.seq, r.sample_id, r.ips) for r in want.collect())
    assert (6, 500, 1500) in {(k, s, i) for _, k, s, i, ips, _ in got if ips is None}


def test_lives_with_ends_before_starts_and_open_ends(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, i, 10.0 + i * 0.3, rng.choice(["start", "start", "end"]), f"p{rng.randrange(3)}") for i in range(160) for k in (rng.choice([1, 2, 3]),)]
    rows += [(4, 300, 12.0, "end", "x"), (5, 301, 13.0, "start", "y")]
    schema = "key long, seq long, t double, kind string, payload string"
    _batches(spark, str(tmp_path / "in"), rows, schema, 5, 6, 9)
    got = _stream(spark, str(tmp_path / "in"), "e", lambda r: stateful.entries(r, "7 seconds"), "update")
    changes = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(got)], "n long, key long, start_us long, end_us long, payload string, final boolean, late boolean")
    known = stateful.latest_entries(changes, F.col("n"))
    table = spark.createDataFrame(rows, schema).withColumn("ts", (F.col("t") * 1_000_000).cast("long"))
    want = lifetimes.intervals(table.select("seq", "ts", "kind", "key", "payload"), "key", ["payload"])
    text = lambda rows: sorted(map(str, rows))
    assert text((r.key, r.start_us, r.end_us, r.payload) for r in known.collect()) == text((r.key, r.start_ts, r.end_ts, r.payload) for r in want.collect())
    assert not changes.where("late").count()


def test_the_state_store_is_asked_for(spark):
    spark.conf.unset(stateful.SETTING)
    rows = spark.createDataFrame([], "key long, seq long, time timestamp, value double")
    with pytest.raises(ValueError, match="RocksDB"):
        stateful.deltas(rows, "1 second")
