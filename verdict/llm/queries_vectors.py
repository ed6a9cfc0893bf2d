"""op11 and its SQL, which compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.near_vectors import near_vectors


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, row_number() OVER () AS k, CAST(embedding AS DOUBLE[]) AS x,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS valid
  FROM embeddings),
links AS (
  SELECT a.k AS a, b.k AS b FROM unit a JOIN unit b ON a.valid AND b.valid AND a.k <> b.k AND len(a.x) = len(b.x)
  WHERE CASE WHEN a.valid AND b.valid AND len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= 0.95 ELSE false END),
reach(node, seen) AS (SELECT k, k FROM unit UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
roots AS (SELECT node, min(u.vec_id) AS component_id FROM reach r JOIN unit u ON u.k = r.seen GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM unit u JOIN roots r ON r.node = u.k LEFT JOIN counts c ON c.a = u.k"""

QUERIES = {"op11_near_vectors": op11_near_vectors}
ORACLES = {"op11_near_vectors": SQL}
