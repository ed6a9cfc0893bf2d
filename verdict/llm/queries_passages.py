"""op7 and op8 with their SQL, which compares every document with every passage exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.decontaminate import contaminated
from verdict.llm.licenses import TEMPLATES, scan, templates


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), templates(spark))


#: {items} yields key and words, {docs} doc_id and words. A window is judged where a shingle of it stands as in the item.
_SQL = r"""
items AS (SELECT key, words, len(words) AS n, least(5, len(words)) AS k FROM ({items}) WHERE len(words) > 0),
item_shingles AS (
  SELECT key, n, k, unnest(range(0, n - k + 1)) AS shift, words FROM items),
item_rows AS (SELECT key, n, k, shift, array_to_string(words[shift + 1 : shift + k], ' ') AS shingle FROM item_shingles),
item_sets AS (SELECT key, n, k, list(DISTINCT shingle) AS own, list_sum([length(s) FOR s IN list(DISTINCT shingle)]) AS total FROM item_rows GROUP BY key, n, k),
docs AS ({docs}),
doc_rows AS (
  SELECT doc_id, words, k, unnest(range(0, greatest(0, len(words) - k + 1))) AS at FROM docs, (SELECT DISTINCT k FROM items)),
hits AS (
  SELECT DISTINCT d.doc_id, d.words, i.n, i.k, greatest(d.at - i.shift, 0) AS start
  FROM doc_rows d JOIN (SELECT DISTINCT n, k, shift, shingle FROM item_rows) i ON d.k = i.k AND array_to_string(d.words[d.at + 1 : d.at + d.k], ' ') = i.shingle),
cut AS (SELECT DISTINCT doc_id, n, k, start, words[start + 1 : start + n] AS w FROM hits),
scored AS (
  SELECT c.doc_id, s.key, c.start,
         list_sum([length(s) FOR s IN s.own IF list_contains([array_to_string(c.w[p : p + c.k - 1], ' ') FOR p IN range(1, greatest(1, len(c.w) - c.k + 1) + 1)], s)]) / s.total AS sim
  FROM cut c JOIN item_sets s USING (n, k)),
best AS (SELECT doc_id, key, max(sim) AS sim, CAST(arg_max(start, {{'s': sim, 'p': -start}}) AS BIGINT) AS start FROM scored WHERE sim >= 0.8 GROUP BY doc_id, key)
"""
_GAP = r"[\x20\x09-\x0D]+"


def _split(text: str, gap: str) -> str:
    return f"[w FOR w IN string_split_regex(lower(coalesce({text}, '')), '{gap}') IF w <> '']"


def _passage_sql(items: str, gap: str, select: str) -> str:
    docs = f"SELECT doc_id, {_split('text', gap)} AS words FROM documents"
    return "WITH " + _SQL.replace("{{", "{").replace("}}", "}").replace("{items}", items).replace("{docs}", docs) + select


def _template_rows() -> str:
    rows = ", ".join("('" + f"{name}/{k}" + "', '" + text.replace("'", "''") + "')" for k, (name, text) in enumerate(TEMPLATES))
    return f"SELECT key, {_split('text', _LETTERS)} AS words FROM (VALUES {rows}) AS t(key, text)"


_LETTERS = r"[^\p{L}\p{N}]+"

QUERIES = {"op7_decontaminate": op7_decontaminate, "op8_licenses": op8_licenses}
ORACLES = {
    "op7_decontaminate": _passage_sql(f"SELECT item_id AS key, {_split('text', _GAP)} AS words FROM benchmark", _GAP, "SELECT doc_id, key AS item_id, round(sim, 6) AS similarity, start FROM best"),
    "op8_licenses": _passage_sql(_template_rows(), _LETTERS, r"SELECT doc_id, regexp_extract(key, '^(.*)/\d+$', 1) AS license, key AS template, round(sim, 6) AS containment, start FROM best"),
}
