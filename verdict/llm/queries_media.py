"""op6: not expressible in SQL; tests hold it against an exact round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.media import digest, store


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


QUERIES = {"op6_media": op6_media}
ORACLES: dict[str, str] = {}
