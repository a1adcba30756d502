"""Five stages from raw documents to token ids, each one of the library's training-data operators.

Every stage takes the documents that the one before kept and is written as Parquet before the next
one reads it, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheetloom.llm import bpe, line_dedup, mixing, quality_rules, simhash
from sheetloom.llm.common import drop, read, ready

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ready(spark)
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line."""
    ready(spark)
    return line_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ready(spark)
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights."""
    ready(spark)
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    ready(spark)
    return bpe.digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("mixing", mixture), ("byte-level bpe", tokens)]

#: Encoding and covering fingerprints can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared checkpoint folder and read again; a stage's input goes once its output is written."""
    docs = read(spark, sf_dir, "documents")
    top = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        if k:
            drop(docs)
        docs = spark.read.parquet(f"{top}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
