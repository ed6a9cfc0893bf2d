"""op5 and its SQL, which counts shared shingles of all pairs exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.jaccard import jaccard_components


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


#: {docs} is the relation of documents, {k} the words of a shingle, {t} the threshold in percent; {p} prefixes the names.
JACCARD_SQL = r"""
{p}worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM {docs}),
{p}shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < {k} THEN array_to_string(words, ' ') ELSE array_to_string(words[pos : pos + {k} - 1], ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {k} + 1) + 1)) AS pos FROM {p}worded WHERE len(words) > 0)),
{p}sizes AS (SELECT doc_id, count(*) AS n FROM {p}shingles GROUP BY doc_id),
{p}sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS set_id FROM {p}shingles GROUP BY doc_id),
{p}classes AS (SELECT set_id, min(doc_id) AS rep FROM {p}sets GROUP BY set_id),
{p}shared_by AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM {p}shingles a JOIN {p}shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM {p}classes) AND b.doc_id IN (SELECT rep FROM {p}classes) GROUP BY 1, 2),
{p}links AS (
  SELECT o.a, o.b FROM {p}shared_by o JOIN {p}sizes x ON x.doc_id = o.a JOIN {p}sizes y ON y.doc_id = o.b
  WHERE 100 * o.common >= {t} * (x.n + y.n - o.common)),
{p}edges AS (SELECT a, b FROM {p}links UNION SELECT b, a FROM {p}links),
{p}reach(node, seen) AS (
  SELECT rep, rep FROM {p}classes UNION SELECT r.node, e.b FROM {p}reach r JOIN {p}edges e ON e.a = r.seen),
{p}roots AS (SELECT node, min(seen) AS root FROM {p}reach GROUP BY node),
{p}joined AS (
  SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
  FROM {docs} d LEFT JOIN {p}sizes s USING (doc_id) LEFT JOIN {p}sets t USING (doc_id) LEFT JOIN {p}classes c USING (set_id) LEFT JOIN {p}roots r ON r.node = c.rep)
"""


def jaccard_sql(docs: str, size: int, percent: int, prefix: str = "") -> str:
    return JACCARD_SQL.replace("{docs}", docs).replace("{k}", str(size)).replace("{t}", str(percent)).replace("{p}", prefix)


QUERIES = {"op5_jaccard": op5_jaccard}
ORACLES = {"op5_jaccard": "WITH RECURSIVE " + jaccard_sql("documents", 4, 85) + "SELECT doc_id, n_shingles, component_id FROM joined"}
