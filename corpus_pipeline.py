"""A corpus from raw documents to training batches, in five stages.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last
one returns the batches. Stages read their input more than once, so it should be a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm import copies, langid, mixing, packing, pii
from costweave.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Label words by language; documents without letters or with words labelled at less than 0.4 in the mean go."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.keep_known(docs, model, min_score=0.4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8) the document with the smallest id stays."""
    return copies.without_near_copies(docs, min_similarity=0.8, shingle=5).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that their sources meet the target weights."""
    return mixing.mixed_documents(docs, max_rate=3)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches of one padded length each."""
    return packing.pack(docs, max_length=4096, n_buckets=16, token_budget=65_536)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("pii", redact_pii),
    ("source_mixing", mix_sources),
    ("length_buckets", pack_batches),
]

#: The stages learn models and iterate, which SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
