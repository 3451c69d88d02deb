"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's documents.

Each stage works on all rows that its predecessor kept. All but the last return the columns of
documents. Null texts and texts without letters go with the first stage; an empty table gives no
rows in any stage; see the operators for ties, repeated rows and other columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from annals.llm.common import shared_dir, table
from annals.llm.decontaminate import keep_clean
from annals.llm.exact_dedup import dedup
from annals.llm.language_id import fit, keep_identified, training_part
from annals.llm.near_dedup import keep_one
from annals.llm.packing import pack_documents


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject."""
    return keep_identified(docs, fit(training_part(docs)))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return dedup(docs, keep="max")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return keep_one(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten consecutive words of a benchmark item occur."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, end_id=1, capacity=2048)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", unique),
    ("near_dedup", without_near_copies),
    ("decontaminate", decontaminated),
    ("pack", packed),
]

#: SQL can express neither the language models nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/annals/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
