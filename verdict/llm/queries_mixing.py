"""op10 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.mixing import mix


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at production parameters: weights 3, 1, 2, 150 % of all words, at most two epochs."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: {docs} is the relation to mix. The level of the targets is found by the same prefix sums.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM {docs}),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS ceiling FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER before, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM capped WINDOW before AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE weight * level <= ceiling ORDER BY ceiling / weight, level LIMIT 1),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.weight * c.level <= l.ceiling THEN l.weight * c.level ELSE l.ceiling END AS target
  FROM levels l, chosen c),
ordered AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
         CAST(epochs * size + greatest(0, least(CAST(floor(target) AS BIGINT) - epochs * source_size - ahead, size)) AS BIGINT) AS taken
  FROM ordered)
"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": "WITH " + MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"}
