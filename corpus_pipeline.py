"""From raw documents to a training mix: five stages, each written and read again before the next.

Stages take and return tables with the columns of documents (the last one returns the mix) and work on whole texts. Null and empty texts are
empty documents: the quality rules reject them; handed to a later stage alone they are near-duplicates of each other, hold no benchmark item
and no personal data, and have size 0 in the mix. Rows with a null doc_id, source or language take part as the operators' docstrings say;
repeated rows are near-duplicates of each other. Extra columns of documents are carried; names that an operator adds don't clash with them.
Each stage gives an empty table for an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmeter.llm import decontaminate, mixing, pii, quality_rules, simhash
from postmeter.llm.common import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, finish."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("mix", mixture),
]
#: The stages train models and hash by rules that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
