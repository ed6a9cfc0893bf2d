"""op3: not expressible in SQL; tests hold it to accuracy on held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.quality import classify


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
