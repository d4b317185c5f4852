"""The corpus pipeline: documents in, token ids of the clean ones out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written as Parquet before the next
one reads it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from tidemark.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score 0.7 or more go. Learns from the labels that are not held out."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts, the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents that share 0.8 of their five-word shingles, one of each group stays."""
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids of what stayed, with the digests that prove the round trip."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), want=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: SQL cannot express training, fingerprints or merges; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
