"""Document fingerprints from spot signatures.

A spot is a common word (an anchor); its signature is the anchor with the chain of the next few content words, those that are
not anchors. A fingerprint is the set of a text's signatures, each as 32 bits. A text without any signature has the
chains of all its words instead. Likeness is the Jaccard similarity of two sets; sets whose sizes differ too much for a
threshold are never compared, and a comparison stops as soon as it can't be reached.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.llm.hashing import slices
from emberstack.llm.scratch import saved

WORD = re.compile(r"[^\W_]+")
# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the of and to in is was for on with as by that this it at be are from or an a not he she they we you his her their have had has but which were "
    "der die das und ist nicht zu den von mit ein eine im für auf des sich dem auch als an es war bei aus wird sind oder "
    "le la les des et un une du en est que qui dans pour pas par sur au aux ce il elle ne se plus avec sont "
    "el los las y un una del que es por con para se lo como más su al no sus o pero".split()
)
CHAIN = 3


def signatures(text: str, chain: int = CHAIN) -> frozenset[int]:
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    words = WORD.findall(text.lower())
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    found = {zlib.crc32(" ".join((a, *content[i : i + chain])).encode()) for a, i in spots if i <= last}
    if not found and (words or text.strip()):
        own = words or text.split()
        found = {zlib.crc32(" ".join(("", *own[i : i + chain])).encode()) for i in range(max(1, len(own) - chain + 1))}
    return frozenset(found)


def likeness(a: frozenset[int], b: frozenset[int], threshold: float = 0.0) -> float:
    """Jaccard similarity, or 0 where the sizes alone keep it below the threshold; two empty sets are alike."""
    if not a and not b:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < threshold * len(large):
        return 0.0
    common = len(small & large)
    return common / (len(a) + len(b) - common)


def fingerprint(found: frozenset[int]) -> str:
    """The signatures in ascending order, eight hex digits each."""
    return np.sort(np.fromiter(found, np.uint32, len(found))).astype(">u4").tobytes().hex()


def _ranges(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their order ``(k, h)`` and range ``p``, and for each range its first order and the range that ends before it.

    Ranges are cut at approximate quantiles of doc_id; an id that fills several of them (null, or one that very many rows
    have) is cut further by the hash of the text. At most ``n`` numbers reach the driver, once as cuts and once as firsts.
    """
    from pyspark.ml.feature import Bucketizer

    rows = docs.select("doc_id", "text").withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "h": F.xxhash64("text")})
    cuts = rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    times = Counter(cuts)
    splits = sorted({-math.inf, math.inf, *cuts, *(math.nextafter(c, math.inf) for c, m in times.items() if m > 1)})
    rows = Bucketizer(splits=splits, inputCol="x", outputCol="b").transform(rows.withColumn("x", F.col("k").cast("double"))) if len(splits) > 2 else rows.withColumns({"x": F.lit(0.0), "b": F.lit(0.0)})
    spread = [F.when(F.col("x") == c, F.floor((F.col("h") / 2.0**64 + 0.5) * (m + 1))) for c, m in times.items() if m > 1]
    rows = rows.withColumn("p", (F.col("b") * (n + 1) + F.coalesce(*spread, F.lit(0))).cast("long")).select("doc_id", "text", "k", "h", "p")
    found = sorted((r["p"], r["f"]["k"], r["f"]["h"]) for r in rows.groupBy("p").agg(F.min(F.struct("k", "h")).alias("f")).collect())
    firsts = [(p, k, h, found[i - 1][0]) for i, (p, k, h) in enumerate(found)]
    return rows, docs.sparkSession.createDataFrame(firsts, "f_p long, f_k long, f_h long, before long")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row for each of ``docs``.

    The edited text has its last half of code points replaced by as many first ones, or all, of the next document's, in
    ascending order of doc_id, then of the text's hash; null ids come first; after the last comes the first. Null texts are
    empty. Other columns are ignored. Documents are shuffled once, by range; the first document of a range is sent to the
    range before too.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or 8 * partitions  # several ranges for each partition even out how they fall
    rows, firsts = _ranges(docs, n)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    placed = rows.join(F.broadcast(firsts), F.col("p") == F.col("f_p"))  # a row for each range, about ``n``
    own = F.struct("p", F.lit(0).alias("tail"))
    places = F.when((F.col("k") == F.col("f_k")) & (F.col("h") == F.col("f_h")), F.array(own, F.struct(F.col("before").alias("p"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    dealt = placed.withColumn("place", F.explode(places)).select("doc_id", "text", "k", "h", F.col("place.p").alias("p"), F.col("place.tail").alias("tail"))
    dealt = dealt.repartition(partitions, "p").sortWithinPartitions("p", "tail", "k", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next: (range, id, text, signatures)
        for batch in slices(batches):
            made: list[tuple] = []
            for doc_id, text, p, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "p", "tail"))):
                text = text or ""
                waits = held is not None and held[0] == p
                if not waits and tail:
                    held = None
                    continue
                own = signatures(text)
                if waits:
                    _, id_, before, found = held
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    changed = signatures(edited)
                    made.append((id_, len(before), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(found), fingerprint(changed), likeness(found, changed), likeness(found, own)))
                held = None if tail else (p, doc_id, text, own)
            if made:
                types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, out)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, class_id, links)``, a row for each row of ``docs(doc_id, text)``.

    Rows with equal sets of signatures are a class, named by its least doc_id (null if all its ids are); ``links`` counts the
    other classes at ``threshold`` or more. Texts without signatures are one class, which links with nothing. Other
    columns are ignored.

    Classes are partitioned by set length into bands of ratio ``threshold``. Within a band and the next, sets that can be
    that alike share one of their ``(1 - threshold) * length + 1`` rarest signatures; sets whose lengths differ too much are
    not compared, and those that are, by how many signatures they share.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.sort(np.fromiter(s, np.uint32, len(s)).view(np.int32)) for s in (signatures(t or "") for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "sigs"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sigs array<int>")
    found = saved(found.withColumns({"h": F.xxhash64("sigs"), "n": F.size("sigs")}))
    sets = saved(found.groupBy("h", "n").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")))
    each = sets.where("n > 0").select("h", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy(F.col("sig").alias("o_sig")).agg(F.count("*").alias("often"))
    rarest = each.join(often, F.col("sig") == F.col("o_sig")).groupBy("h", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("in_order"))
    prefix = F.slice("in_order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold))
    probes = saved(rarest.select("h", "n", F.explode(F.array(band, band + 1)).alias("band"), prefix.alias("prefix")).select("h", "n", "band", F.explode("prefix.sig").alias("sig")))
    other = probes.select(F.col("h").alias("b"), F.col("n").alias("b_n"), F.col("band").alias("b_band"), F.col("sig").alias("b_sig"))
    alike = (F.col("band") == F.col("b_band")) & (F.col("sig") == F.col("b_sig")) & (F.col("a") < F.col("b")) & (F.least("n", "b_n") >= F.greatest("n", "b_n") * threshold)
    pairs = saved(probes.withColumnRenamed("h", "a").join(other, alike).select("a", "b").distinct())
    left, right = (sets.select(F.col("h").alias(f"{s}_h"), F.col("sigs").alias(f"{s}_sigs")) for s in ("l", "r"))
    both = pairs.join(left, F.col("a") == F.col("l_h")).join(right, F.col("b") == F.col("r_h"))
    common = F.size(F.array_intersect("l_sigs", "r_sigs"))
    linked = both.where(common >= threshold * (F.size("l_sigs") + F.size("r_sigs") - common)).select("a", "b")
    counts = linked.select(F.explode(F.array("a", "b")).alias("c_h")).groupBy("c_h").agg(F.count("*").alias("links"))
    named = sets.select(F.col("h").alias("s_h"), "class_id").join(counts, F.col("s_h") == F.col("c_h"), "left")
    return found.select("doc_id", "h").join(named, F.col("h") == F.col("s_h")).select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
