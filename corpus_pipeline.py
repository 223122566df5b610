"""A training-corpus pipeline over ``documents``: each stage's result is written as Parquet and read by the next.

Language ID drops texts in no language; line dedup takes repeated lines out of
the texts; the n-gram Jaccard join keeps the least id of each group of near
copies; decontamination drops documents that hold a benchmark item; mixing says
how many words of each document that is left the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import decontaminate, jaccard_join, language, line_dedup, mixing
from panelwright.llm.support import settle, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_report(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
]

#: SQL cannot express the learned and the alignment stages; the operators' tests hold each against brute force where
#: one exists, and the pipeline's test checks what each stage must keep and drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
