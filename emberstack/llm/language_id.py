"""Language identification by Bayesian fusion of evidence.

The text's likelihood comes from byte trigrams, counted by language over a bounded sample of documents of known language. Its
log likelihoods are scaled so that a long text speaks as loud as ``loudness`` trigrams at most. From the posteriors of the
text alone, summed in grouped aggregations over all rows, come the probabilities of a declared markup language given the
language, and the languages of a host, smoothed towards those of its domain, these towards those of its address suffix,
these towards those of all: so the suffix is evidence once, as the top of that hierarchy. A row's own posterior is taken
out of every sum it meets. The evidence is then multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from emberstack.llm.hashing import LOWER, slices
from emberstack.llm.scratch import saved

SLOTS = 1 << 16


def _slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash slot and text number of every lower-cased byte trigram within a text."""
    from emberstack.llm.hashing import Words

    w = Words(texts)
    data = LOWER[w.data].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.n_docs
    doc = np.repeat(np.arange(w.n_docs), np.diff(w.offsets))
    slot = ((data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    own = doc[:-2] == doc[2:]
    return slot[own].astype(np.int64), doc[:-2][own], w.n_docs


class TextModel:
    """Log probabilities of trigram slots by language."""

    def __init__(self, counts: dict[str, np.ndarray], loudness: float):
        self.languages = sorted(counts)
        table = np.stack([counts[x] for x in self.languages]).astype(np.float64) + 0.5 if counts else np.zeros((0, SLOTS))
        self.table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        self.loudness = loudness

    def posterior(self, texts: pa.Array) -> np.ndarray:
        """Rows of probabilities, equal ones for a text without trigrams."""
        slot, doc, n = _slots(texts)
        size = np.bincount(doc, minlength=n)
        total = np.stack([np.bincount(doc, weights=t[slot], minlength=n) for t in self.table], axis=1)
        total = total * np.minimum(1.0, self.loudness / np.maximum(size, 1))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, most: int = 4000, loudness: float = 60.0) -> TextModel:
    """Learn from ``docs(doc_id, text, lang)``: the ``most`` rows of least hash that have a language and an id.

    Trigrams are counted by language in an aggregation, so what reaches the driver is a number for each slot and language of
    the sample. Rows that repeat a doc_id and language are all counted. Null texts count for nothing.
    """
    named = docs.where("lang is not null and doc_id is not null")
    chosen = named.select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang")).distinct().orderBy(F.xxhash64("c_id"), "c_id", "c_lang").limit(most)
    rows = named.join(F.broadcast(chosen), (F.col("doc_id") == F.col("c_id")) & (F.col("lang") == F.col("c_lang"))).select("lang", "text")  # bounded by ``most``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            slot, doc, _ = _slots(batch.column("text"))
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)[doc]
            for x in sorted(set(lang)):
                slots, n = np.unique(slot[lang == x], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(slots), pa.string()), pa.array(slots.astype(np.int32)), pa.array(n)], ["lang", "slot", "n"])

    found = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    lang, slot, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "slot", "n"))
    return TextModel({x: np.bincount(slot[lang == x], weights=n[lang == x], minlength=SLOTS) for x in set(lang.tolist())}, loudness)


def markup_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, lower-cased, else null."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """The text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def _sum_of(column: str, n: int) -> Column:
    """Element by element sums of arrays of ``n`` numbers."""
    return F.array(*[F.coalesce(F.sum(F.element_at(column, i + 1)), F.lit(0.0)) for i in range(n)])


def _mass(column: str | Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)


def identify(units: DataFrame, model: TextModel, keys: list[str], strength: float = 20.0) -> DataFrame:
    """``keys``, ``lang``, ``confidence`` and ``text_lang`` of each row of ``units(*keys, text, host, declared)``.

    Null or empty texts have no likelihood of their own; of a very long one all trigrams count. A null host has the prior of
    all, a null declaration says nothing. The address suffix is that of the host without dots at its end, where it has one.
    Of equally likely languages the first by name is taken. Hosts are aggregated before they are joined. Repeated rows count
    each time. Without any known language ``lang`` is null. Keys may have any names but ``lang``, ``confidence`` and
    ``text_lang``; other columns are ignored. An empty table gives an empty result.
    """
    langs = model.languages
    if not langs:
        return units.select(*keys, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    shared = units.sparkSession.sparkContext.broadcast(model)
    columns = [*(f"__k{i}" for i in range(len(keys))), "__host", "__declared"]
    rows = units.select(*[F.col(c).alias(n) for c, n in zip([*keys, "host", "declared"], columns)], F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = shared.value.posterior(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists], [*columns, "p"])

    schema = StructType([*(rows.schema[c] for c in columns), StructField("p", ArrayType(DoubleType()))])
    n = len(langs)
    read = saved(rows.mapInArrow(run, schema))
    name = F.rtrim("host", F.lit("."))
    has_suffix = name.contains(".")
    hosts = read.groupBy(F.col("__host").alias("host")).agg(_sum_of("p", n).alias("of_host"))
    hosts = saved(hosts.withColumns({"suffix": F.when(has_suffix, F.substring_index(name, ".", -1)), "domain": F.when(has_suffix, F.substring_index(name, ".", -2)).otherwise(name)}))
    domains = hosts.where("domain is not null").groupBy(F.col("domain").alias("d_domain"), F.col("suffix").alias("d_suffix")).agg(_sum_of("of_host", n).alias("of_domain"))
    suffixes = domains.where("d_suffix is not null").groupBy(F.col("d_suffix").alias("s_suffix")).agg(_sum_of("of_domain", n).alias("of_suffix"))
    levels = hosts.where("host is not null").join(domains, F.col("domain") == F.col("d_domain")).join(suffixes, F.col("suffix") == F.col("s_suffix"), "left")
    levels = levels.select(F.col("host").alias("l_host"), "of_host", "of_domain", "of_suffix")
    every = hosts.agg(_sum_of("of_host", n).alias("of_all"))
    said = read.where("__declared is not null").groupBy(F.col("__declared").alias("said")).agg(_sum_of("p", n).alias("of_said"))
    all_said = said.agg(_sum_of("of_said", n).alias("of_any"), F.count("*").alias("kinds"))

    fused = read.join(levels, F.col("__host") == F.col("l_host"), "left").join(said, F.col("__declared") == F.col("said"), "left")
    fused = fused.join(F.broadcast(every)).join(F.broadcast(all_said))  # one row each

    def shrunk(own: str, above: str) -> Column:
        """Shares of languages in ``own`` without the row itself, smoothed towards ``above`` by ``strength`` rows."""
        rest = F.greatest(_mass(own) - 1, F.lit(0.0)) + strength
        return F.when(F.col(own).isNull(), F.col(above)).otherwise(F.transform(F.arrays_zip(F.col(own).alias("s"), F.col("p").alias("p"), F.col(above).alias("q")), lambda x: (F.greatest(x["s"] - x["p"], F.lit(0.0)) + strength * x["q"]) / rest))

    first = F.transform(F.arrays_zip(F.col("of_all").alias("s"), F.col("p").alias("p")), lambda x: (F.greatest(x["s"] - x["p"], F.lit(0.0)) + 1) / (F.greatest(_mass("of_all") - 1, F.lit(0.0)) + n))
    fused = fused.withColumn("q0", first)
    for k, own in enumerate(("of_suffix", "of_domain", "of_host")):
        fused = fused.withColumn(f"q{k + 1}", shrunk(own, f"q{k}"))
    # P(declared | language), with one row's worth of smoothing for each declaration that occurs.
    given = F.transform(F.arrays_zip(F.col("of_said").alias("s"), F.col("of_any").alias("t"), F.col("p").alias("p")), lambda x: (F.greatest(x["s"] - x["p"], F.lit(0.0)) + 1) / (F.greatest(x["t"] - x["p"], F.lit(0.0)) + F.col("kinds")))
    fused = fused.withColumn("g", F.coalesce(given, F.array_repeat(F.lit(1.0), n)))
    fused = fused.withColumn("w", F.transform(F.arrays_zip(F.col("p").alias("p"), F.col("q3").alias("q"), F.col("g").alias("g")), lambda x: x["p"] * x["q"] * x["g"]))
    place = F.array(*[F.lit(-i) for i in range(n)])
    named = F.array(*[F.lit(x) for x in langs])
    best, alone = (F.array_max(F.arrays_zip(F.col(c).alias("w"), place.alias("i"))) for c in ("w", "p"))
    out = [F.col(c).alias(k) for c, k in zip(columns, keys)]
    return fused.select(*out, F.element_at(named, 1 - best["i"]).alias("lang"), (best["w"] / _mass("w")).alias("confidence"), F.element_at(named, 1 - alone["i"]).alias("text_lang"))
