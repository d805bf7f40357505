"""From raw documents to packed training sequences, one stage at a time.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns the
next stage's documents; all but the last return the columns of ``documents``.

1. quality: documents that the quality classifier rejects go (score below 0.3; texts without words).
2. language: documents without a letter, or without a language for at least 40 % of their words, go.
3. near copies: of each group of documents linked by n-gram Jaccard similarity, the one with the
   smallest id stays.
4. personal data: found spans are replaced by their kind, as ``<EMAIL>``.
5. packing: every piece of every document and its place in a sequence.

Null texts go in the first stage.  Repeated rows go in the third.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opatlas.llm import language_crf, ngram_join, packing, pii, quality_crf
from opatlas.llm.tables import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_crf.keep_one_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", pack),
]

# The learned stages can't be written in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
