"""A corpus pipeline of five of the operators, each stage on what its predecessor kept.

Stages take (doc_id, text, ...) and, but for the last, keep all columns, whatever their names. They
treat rows, repeated ones too, as documents of their own unless a stage says otherwise; texts are taken
whole, however long; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import byte_bpe, decontaminate, exact_dedup, minhash_dedup, toxicity
from lexweave.llm.shared import saved, small_batches


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the stage's own documents, doesn't reject; null and empty texts stay."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id (null is smaller than any; of repeated rows one). Null and empty texts are equal."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5-word shingles, similarity 0.8), the smallest doc_id (of repeated rows one). Texts without words stay."""
    small_batches(spark)
    return minhash_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts stay."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its ids and of their decoding; null and empty texts have no tokens."""
    small_batches(spark)
    tokens = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return byte_bpe.round_trip(docs.select("doc_id", "text"), tokens).drop("text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL can't express the toxicity model, the MinHash components and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
