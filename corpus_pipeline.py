"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage works on all documents that the one before kept and, but for the last, returns their columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, pii, quality_classifier, toxicity
from tidemark.llm.common import staged
from tidemark.session import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores under 0.3."""
    stats = staged(quality_classifier.statistics(docs), "quality_stats")
    return quality_classifier.keep_good(docs, quality_classifier.fit(stats, table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity field scores at 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of similar ones."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' ids into sequences of at most 4096."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("best-fit packing", pack)]

#: The stages learn, tokenize and join by similarity, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage_" + name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
