"""Corpus preparation in five stages; each takes what the one before it kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and read again as the docs of the
next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloft.llm import line_dedup, packing, simhash, suffix_dedup, toxicity
from sparkloft.llm.common import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose text scores 0.7 or more go. The model learns from a bounded sample of the labelled rows."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda fold: True)
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines that are on more than 5 % of a source's documents go from the texts."""
    return line_dedup.line_dedup(docs).select(*docs.columns)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages of 50 bytes or more that a document with a smaller doc_id holds too go from the texts."""
    return suffix_dedup.cut_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", keep_one_near_duplicate),
    ("suffix_array_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

# The toxicity model, fingerprints' hash and the vocabulary are beyond SQL: tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
