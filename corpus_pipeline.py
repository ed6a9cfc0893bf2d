"""From raw documents to a training mix in five stages: quality, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to the documents of ``sf_dir``. Between
stages rows are written as Parquet and read again, so a stage that fails repeats alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verdict.llm import stages
from verdict.llm.common import table
from verdict.sources.checkpoint import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_quality(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.dedup_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: A learned classifier is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, name = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{shared_folder(spark)}/pipeline-{name}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
