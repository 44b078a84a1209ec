"""A training corpus from `documents`: language, near duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadewell.llm import decontaminate, language, packing, secrets, simhash
from fadewell.llm.queries import tokenizer_path
from fadewell.llm.shared import bounded_batches, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest centroid rejects go, those without a letter or with a null text too; the others keep all columns."""
    model = language.train(docs)
    return docs.where(~language.classified(model, F.col("text"))["rejected"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, 0.8) the least doc_id stays; null ids stay."""
    key = "gone_id"
    while key in map(str.lower, docs.columns):
        key += "_"
    gone = simhash.near_duplicates(spark, docs).select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"] == F.col(key), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows the text."""
    bounded_batches(spark)
    return docs.withColumn("text", secrets.redacted(F.col("text"))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens placed in sequences. Earlier stages leave more workers than an executor has cores; those that wait hold no words."""
    packed = packing.pack_documents(spark, docs, tokenizer_path(), keep_words=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned models, fingerprints and tokenizers have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(spark, stage(spark, docs, sf_dir), name)
    return docs
