"""The corpus pipeline, built from the operators of tidemark.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns what it
keeps; all but the last return the columns of documents.  Between stages the rows are written as Parquet and
read again.  Every row is judged for itself, by its text: null and repeated doc_ids make no difference, and of
rows with equal texts one stays.  A null text has no words: it isn't toxic, no copy and without benchmark passages
or secrets, and has no tokens.  An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import byte_bpe_round_trip
from tidemark.llm.decontaminate import benchmark_overlap
from tidemark.llm.jaccard import ngram_jaccard_classes
from tidemark.llm.secrets import ledger_path, redact_secrets
from tidemark.llm.shared import cut, numbered, settled, without
from tidemark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingles of similarity 0.8 or more."""
    rows, row = numbered(docs, "doc_id")
    texts = rows.select(F.col(row).alias("doc_id"), "text")
    copies = settled(spark, "copies", lambda: ngram_jaccard_classes(texts, words=5, percent=80).where("doc_id <> component_id").select(F.col("doc_id").alias(row)))
    return without(rows, copies, row).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, row = numbered(docs, "doc_id")
    texts, items = rows.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = settled(spark, "leaks", lambda: benchmark_overlap(texts, items).where("contaminated").select(F.col("doc_id").alias(row)))
    return without(rows, leaks, row).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return redact_secrets(docs, ledger_path(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): token ids, and the digests of a round trip."""
    return byte_bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: A trained network can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
