"""op9: not expressible in SQL; tests hold it against hand-made pages with known articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.html_text import extract_column


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_column(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
ORACLES: dict[str, str] = {}
