"""A corpus pipeline of five stages; each takes the documents that the one before it kept.

Quality rejects go, near copies go but one of each group, personal data is replaced, sources are mixed to their target weights
(a document taken twice is two rows), and what remains is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberstack.llm import fair_mix, ngram_join, packing, private_data, quality
from emberstack.llm.queries import public_tokenizer, table
from emberstack.llm.scratch import saved, with_row_names

KEEP_SCORE = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least KEEP_SCORE; without any labelled document all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not len(model.labels):
        return docs
    return quality.score(docs, model, docs.columns, "__score").where(F.col("__score") >= KEEP_SCORE).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return ngram_join.deduplicate(docs, k=5, percent=80)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return private_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. The mix tells rows apart by their place in the stored table; their order is
    that of their ids and texts, so reruns agree."""
    rows = with_row_names(docs).withColumn("__text", F.xxhash64("text"))
    taken = fair_mix.mix(rows, key=("doc_id", "__text"), keep=("__file", "__row")).where("copies > 0")
    taken = taken.select(F.col("__file").alias("__t_file"), F.col("__row").alias("__t_row"), F.col("copies").alias("__copies"))
    rows = rows.join(taken, (F.col("__file") == F.col("__t_file")) & (F.col("__row") == F.col("__t_row")))
    return rows.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, **public_tokenizer()))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("private_data", replace_private_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, the tokenizer and the transducers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
