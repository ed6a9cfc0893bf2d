"""op4 and its SQL, which joins whole variants instead of hashed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.line_dedup import line_decisions


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(table(spark, sf_dir, "documents")).select("doc_id", "line", "kept_doc_id", "kept_line", "distance")


#: Rounds of ``settled`` that are spelled out; a chain of lines that each depend on the one before may be as long.
ROUNDS = 10

#: {docs} is the relation of documents; ids are unique there.
LINE_SQL = r"""
split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM {docs}),
worded AS (SELECT doc_id, line, [w FOR w IN string_split_regex(lower(content), '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM split),
long_lines AS (SELECT doc_id, line, array_to_string(words, ' ') AS content, words FROM worded WHERE len(words) >= 3 OR length(array_to_string(words, ' ')) >= 30),
contents AS MATERIALIZED (SELECT content, any_value(words) AS words, min({'d': doc_id, 'l': line}) AS first FROM long_lines GROUP BY content),
variants AS MATERIALIZED (
  SELECT content, first, position, array_to_string(words[:position] || words[position + 2:], ' ') AS variant
  FROM (SELECT content, first, words, unnest(range(0, len(words))) AS position FROM contents WHERE len(words) >= 8)),
near_pairs AS (
  SELECT a.content AS x, a.first AS fx, b.content AS y, b.first AS fy FROM variants a JOIN variants b ON a.variant = b.variant AND a.position = b.position AND a.content <> b.content
  UNION SELECT v.content, v.first, c.content, c.first FROM variants v JOIN contents c ON c.content = v.variant AND len(c.words) >= 8
  UNION SELECT c.content, c.first, v.content, v.first FROM variants v JOIN contents c ON c.content = v.variant AND len(c.words) >= 8),
edges AS MATERIALIZED (SELECT DISTINCT x AS later, y AS earlier, fy AS earlier_first FROM near_pairs WHERE fy < fx),
{rounds}
near AS (SELECT e.later AS content, min(e.earlier_first) AS near_first FROM edges e LEFT JOIN round{last} s ON s.content = e.earlier WHERE coalesce(s.state, 1) = 1 GROUP BY e.later),
judged AS (
  SELECT l.doc_id, l.line, c.first, n.near_first, {'d': l.doc_id, 'l': l.line} AS place
  FROM long_lines l JOIN contents c USING (content) LEFT JOIN near n USING (content)),
dropped AS (
  SELECT doc_id, line, coalesce(near_first, first) AS kept, CASE WHEN near_first IS NOT NULL THEN 1 ELSE 0 END AS distance
  FROM judged WHERE place <> first OR near_first IS NOT NULL)
"""


def line_sql(docs: str, rounds: int = ROUNDS) -> str:
    """A line's state is 1 if it stays, 2 if it goes, 0 while that is open; lines without an earlier near one stay."""
    steps = ["round0 AS (SELECT DISTINCT later AS content, 0 AS state FROM edges)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"round{k} AS MATERIALIZED (SELECT e.later AS content, CASE WHEN bool_or(coalesce(s.state, 1) = 1) THEN 2 WHEN bool_and(coalesce(s.state, 1) = 2) THEN 1 ELSE 0 END AS state FROM edges e LEFT JOIN round{k - 1} s ON s.content = e.earlier GROUP BY e.later)"
        )
    return LINE_SQL.replace("{docs}", docs).replace("{rounds}", ",\n".join(steps) + ",").replace("{last}", str(rounds))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": "WITH " + line_sql("documents") + "SELECT doc_id, CAST(line AS INTEGER) AS line, kept.d AS kept_doc_id, CAST(kept.l AS INTEGER) AS kept_line, distance FROM dropped"}
