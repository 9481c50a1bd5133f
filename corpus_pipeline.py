"""Corpus pipeline: quality rules, near duplicates, benchmark passages, personal
data and byte-level BPE, each stage written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kudoscope.llm import byte_pairs, decontaminate, near_duplicates, personal_data, quality_rules
from kudoscope.llm.common import forget, table, written
from kudoscope.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return personal_data.redact(docs, personal_data.fit(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of every document."""
    return byte_pairs.token_table(docs, vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", privacy),
    ("byte_pairs", tokens),
]

# The token merges cannot be said in the comparison SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir))
        if k:
            forget(before)  # the given table stays
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
