"""What is shuffled and held by questions of the dictionary: numbers, not names, and no row for each stack's edge."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from emberstack.operators import calltree, dictionary, hits
from emberstack.plans import profile, stored

STACKS = [[("m", "f"), ("n", "g"), ("m", "f"), ("n", "g")], [("m", "f")], [(None, "f"), ("f", None)], [("n", "g"), (None, "f")], [("m", "f"), ("n", "g")]]


@pytest.fixture(scope="module")
def small(spark):
    """``(samples, frames)`` by sample: sample i has stack i % 5 and source i % 2."""
    samples = spark.createDataFrame([(i, i % 2, 10 * i, 1 + i % 3, 5) for i in range(20)], "sample_id long, source_id long, ts long, process_id long, thread_id long")
    rows = [(i, d, m, f, d == len(STACKS[i % 5])) for i in range(20) for d, (m, f) in enumerate(STACKS[i % 5], 1)]
    return samples, spark.createDataFrame(rows, "sample_id long, depth long, module string, symbol string, is_leaf boolean")


def _interned(samples, frames):
    stack = frames.groupBy(F.col("sample_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("depth", "module", "symbol", "is_leaf"))).alias("stack"))
    samples, distinct = dictionary.interned(samples.join(stack, F.col("sample_id") == F.col("of"), "left").drop("of"), ["stack"])
    return samples, distinct.select("stack_id", F.explode("stack").alias("f")).select("stack_id", "f.*")


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_keep_no_row_for_each_stack(small):
    samples, frames = small
    named, shared = _interned(samples, frames)
    found = dictionary.edges(shared, dictionary.weights(named))
    assert _rows(found) == _rows(hits.function_edges(frames.join(samples, "sample_id")))
    grouped = re.findall(r"Aggregate \[([^\]]*)\]", _plan(found))
    assert not [g for g in grouped if "stack_id" in g and "source_id" not in g]


@pytest.mark.parametrize("same", [4, None])
def test_stacks_of_one_hash_are_told_apart(small, monkeypatch, same):
    samples, frames = small
    if same is not None:
        monkeypatch.setattr(dictionary, "hashed", lambda *columns: F.lit(same).cast("long"))
    named, shared = _interned(samples, frames)
    assert shared.select("stack_id").distinct().count() == 5 and named.select("stack_id").distinct().count() == 5
    got = named.join(shared, "stack_id").select("sample_id", "depth", "module", "symbol", "is_leaf")
    assert _rows(got) == _rows(frames)
    assert _rows(dictionary.edges(shared, dictionary.weights(named))) == _rows(hits.function_edges(frames.join(samples, "sample_id")))


def test_samples_know_their_stack_without_a_join(small):
    named, _ = dictionary.interned(small[0], ["ts"])
    assert "Join" not in _plan(named)


def test_lines_are_shuffled_without_names(spark, monkeypatch):
    """What is put into stacks is numbers, and only lines' keys are sorted."""
    seen, intern = [], dictionary.interned
    monkeypatch.setattr(dictionary, "interned", lambda df, *a: seen.append(df) or intern(df, *a))
    stored._shared(spark, "/root/testdata/sf0.001")
    assert "string" not in seen[-1].schema["stack"].dataType.simpleString()
    assert "l_suppkey" not in _plan(profile.lines(spark, "/root/testdata/sf0.001")).split("Relation")[0]


def _keys(df, *among: str) -> list[str]:
    """The keys of aggregates that have all of ``among``."""
    return [g for g in re.findall(r"Aggregate \[([^\]]*)\]", _plan(df)) if all(a in g for a in among)]


def test_sliced_hits_are_summed_without_names(small, monkeypatch):
    samples, frames = small
    named, shared = _interned(samples, frames)
    written, save = [], dictionary.saved
    monkeypatch.setattr(dictionary, "saved", lambda df: written.append(df) or save(df))
    sliced = dictionary.SlicedHits(named, shared, 40)
    found = _keys(written[-1], "slice", "thread_id")
    assert found and not [g for g in found if "symbol" in g]
    assert _rows(sliced.function_hits(dictionary.filters.SampleFilter(30, 150))) == _rows(hits.function_hits(frames.join(samples.where("ts between 30 and 150"), "sample_id")))


def test_tree_nodes_are_shuffled_with_one_path(small):
    samples, frames = small
    named, shared = _interned(samples, frames)
    tree = calltree.nodes(shared, ("source_id",), dictionary.weights(named))
    assert not [g for g in _keys(tree, "symbol") if "path" in g] and not _keys(tree, "stack#")
    assert _rows(tree) == _rows(calltree.nodes(frames.join(samples, "sample_id"), ("source_id",)))
    paths = {(r.path, r.parent) for r in tree.collect()}
    assert {("m!f", ""), ("m!f>n!g", "m!f"), ("m!f>n!g>m!f", "m!f>n!g"), ("f", ""), ("f>f", "f")} <= paths


def test_function_hits_meet_stacks_without_names(spark, small):
    samples, frames = small
    named, shared = _interned(samples, frames)
    found = dictionary.function_hits(shared, dictionary.weights(named))
    assert _rows(found) == _rows(hits.function_hits(frames.join(samples, "sample_id")))
    plan = _plan(stored.dictionary_function_hits(spark, "/root/testdata/sf0.001"))
    assert not [g for g in re.findall(r"Aggregate \[([^\]]*)\]", plan) if "symbol" in g]
