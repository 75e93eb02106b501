"""From documents to packed token sequences: five stages, each written to the
shared folder and read again before the next, so that no stage is computed
twice and a lost executor costs no more than its own stage."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attrition.llm import jaccard, language, line_dedup, packing, toxicity
from attrition.llm.common import table
from attrition.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier calls toxic go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too near to two languages, go."""
    return language.keep_identified(docs, language.learn(docs))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that 5 documents share stay in the last of them only."""
    return line_dedup.drop_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (the smallest doc_id) stays."""
    return jaccard.one_of_groups(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack(docs, packing.load(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard", drop_near_copies),
    ("packing", pack),
]

#: Classifiers, tokenizers and the curve can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
