"""The corpus pipeline: quality rules, language ID, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents``, and returns a DataFrame of what it keeps.  ``run``
writes each stage's rows to the shared folder and gives them, read again, to the next.  The last stage returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rategrid.llm import decontam, langid, mixing, neardup, quality
from rategrid.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules reject and removes the lines above the limits from the rest."""
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language, and those clearly in another one than their row says."""
    return langid.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates."""
    return neardup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Language ID, near-dedup and decontamination have no SQL form; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
