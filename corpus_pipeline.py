"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, token ids.

Each stage takes ``(spark, docs, sf_dir)``, reads all documents its predecessor kept and
returns the columns of ``documents`` (the last one adds ids).  Between stages the rows are
stored as Parquet in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm import decontamination, ngram_join, quality, secret_scan, transducer
from rubrica.session import scratch_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or leave their language's fertility band go."""
    return quality.quality(docs, MODEL).where("kept").select(*[f"`{c}`" for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    groups = ngram_join.jaccard_components(docs, words=5, percent=80)
    # Rows that repeat one id are in one group or in several; an id stays if it names a group of its rows.
    stays = groups.where((F.col("n_shingles") == 0) | F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))
    stays = stays.select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.select(*[f"`{c}`" for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.decontaminate(docs, items)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    pieces = transducer.encode(docs, MODEL)
    return pieces.withColumn("n_tokens", F.size("ids").cast("bigint")).drop("path_cost")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The forest and the transducer are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
