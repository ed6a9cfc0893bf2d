"""op2 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdict.llm.common import table
from verdict.llm.url_filters import BLOCKED, Rule, judge

RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    fits = "\n    ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))
    globs = "\n    ".join(f"WHEN contains(host || path, '{g.strip('*')}') THEN '{g}'" for g in BLOCKED)
    actions = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in RULES)
    return rf"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE {fits} END AS rule,
    CASE {globs} END AS pattern
  FROM split)
SELECT *, CASE rule {actions} ELSE CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END END AS verdict FROM judged"""


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLES = {"op2_url_filters": _sql()}
