"""Raw problem rows that follow from the keys of a table, so that every stage has a result that SQL can tell.

A key's ``kind`` is its remainder by 8: 0 to 2 add a number to the input, 3 calls a function, 4 a method, 5 lacks a
statement, 6 has fewer outputs than inputs, 7 reads lines; of the latter every other lacks a program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.operators.convert import convert
from verdict.plans.tables import table

CLEAN, WARNED, WRONG, BROKEN = "print(sum(map(int, input().split())))", "x = input()\nif x is 1:\n    pass\nprint(sum(map(int, x.split())))", "print(0)", "x ="
ADD, PAIR, ECHO = "def add(a, b):\n    return a + b", "class Solution:\n    def pair(self, a, b):\n        return [a, b]", "print(input())"


def _json(value: Column) -> Column:
    return F.to_json(value)


def raw_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """(k, name, question, input_output, solutions, time_limit, memory_limit, constraints, source, url) per row of ``df``."""
    k = F.col("k")
    kind = k % 8
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(name).alias("name"))
    text = k.cast("string")
    count = (F.lit(3) + k % 2).cast("int")
    numbers = F.sequence(F.lit(1), count)
    sums = F.struct(F.transform(numbers, lambda i: F.concat(i.cast("string"), F.lit(" "), text, F.lit("  "))).alias("inputs"), F.transform(numbers, lambda i: (i + k).cast("string")).alias("outputs"))
    short = F.struct(F.transform(numbers, lambda i: i.cast("string")).alias("inputs"), F.array(F.lit("1")).alias("outputs"))
    three = F.sequence(F.lit(1), F.lit(3))
    added = F.struct(F.lit("add").alias("fn_name"), F.transform(three, lambda i: F.array(i.cast("long"), k)).alias("inputs"), F.transform(three, lambda i: F.array(i + k)).alias("outputs"))
    paired = F.struct(F.lit("pair").alias("fn_name"), F.array(F.array(F.lit(1).cast("long"), k)).alias("inputs"), F.array(F.array(F.lit(1).cast("long"), k)).alias("outputs"))
    lines = F.struct(F.array(*(F.array(F.concat(F.lit(f"{c} "), text), F.lit("end")) for c in "pq")).alias("inputs"), F.array(*(F.array(F.concat(F.lit(f"{c} "), text)) for c in "pq")).alias("outputs"))
    io = F.when(kind.isin(0, 1, 2, 5), _json(sums)).when(kind == 3, _json(added)).when(kind == 4, _json(paired)).when(kind == 6, _json(short)).otherwise(_json(lines))
    listed = lambda *codes: _json(F.array(*map(F.lit, codes)))
    by_key = F.when(k % 3 == 0, listed(WRONG, CLEAN)).when(k % 3 == 1, listed(WARNED, WRONG)).otherwise(listed(WRONG, BROKEN))
    codes = F.when(kind == 3, F.lit(ADD)).when(kind == 4, _json(F.struct(F.array(F.lit(PAIR), F.lit("  ")).alias("python")))).when(kind == 7, F.when(k % 16 == 7, F.lit("[]")).otherwise(listed(ECHO))).otherwise(by_key)
    question = F.when(kind == 5, F.lit(" \n ")).otherwise(F.concat(F.lit("  Add   "), F.floor(k / 24).cast("string"), F.lit(" numbers.\n")))
    limit = F.when(k % 2 == 0, F.lit("10.0 seconds"))
    memory = F.when(k % 3 == 0, F.lit(64.0)).when(k % 6 == 1, F.lit(12345678.0))
    return rows.select("k", "name", question.alias("question"), io.alias("input_output"), codes.alias("solutions"), limit.alias("time_limit"), memory.alias("memory_limit"), F.when(k % 4 == 1, listed("n > 0", "n < 9")).alias("constraints"), F.when(k % 5 == 0, F.lit("book")).alias("source"), F.lit(None).cast("string").alias("url"))


def converted(spark: SparkSession, sf_dir: str, name: str = "supplier", key: str = "s_suppkey", title: str = "s_name") -> DataFrame:
    """Rows of a table as converted problems, the skipped ones included; time limits leave room for a busy machine."""
    return convert(raw_rows(table(spark, sf_dir, name), key, title), F.col("k"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = converted(spark, sf_dir).where("status = 'written'").drop("status", "reason")
    return made.withColumn("time_limit_sec", F.greatest("time_limit_sec", F.lit(10.0)))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``problems`` with the solution marked that verification chooses."""
    kind, third = F.col("source_index") % 8, F.col("source_index") % 3
    chosen = F.when(kind >= 3, 0).when(third == 0, 1).when(third == 1, 0).otherwise(-1)
    oracle = F.col("oracle")
    solutions = F.transform(oracle["solutions"], lambda s, i: F.struct(s["language"].alias("language"), s["code"].alias("code"), (i == chosen).alias("verified")))
    return problems(spark, sf_dir).withColumn("oracle", F.struct(solutions.alias("solutions"), oracle["source"].alias("source"), oracle["url"].alias("url")))


def raw_sql(name: str = "supplier", key: str = "s_suppkey", title: str = "s_name") -> str:
    """Relations ``raw`` and ``made``: what conversion gives, told by kind, with cases as lists of structs."""
    return f"""
raw AS (SELECT {key}::BIGINT AS k, {key}::BIGINT % 8 AS kind, {title} AS name, CASE WHEN {key} % 2 = 0 THEN 3 ELSE 4 END AS cnt FROM {name}),
cased AS (
  SELECT *, CASE WHEN kind IN (0, 1, 2, 5) THEN [{{'i': x || ' ' || k || chr(10), 'o': (x + k)::VARCHAR}} FOR x IN range(1, cnt + 1)]
    WHEN kind = 3 THEN [{{'i': '[' || x || ', ' || k || ']', 'o': (x + k)::VARCHAR}} FOR x IN range(1, 4)]
    WHEN kind = 4 THEN [{{'i': '[1, ' || k || ']', 'o': '[1, ' || k || ']'}}]
    WHEN kind = 7 THEN [{{'i': x || ' ' || k || chr(10) || 'end' || chr(10), 'o': x || ' ' || k}} FOR x IN ['p', 'q']] ELSE [] END AS cases,
  CASE WHEN kind = 5 THEN 'missing statement' WHEN kind = 6 THEN 'invalid input_output pairs' WHEN k % 16 = 7 THEN 'missing Python solutions' END AS reason,
  CASE kind WHEN 3 THEN 'add' WHEN 4 THEN 'pair' ELSE '' END AS entry,
  CASE WHEN kind IN (3, 4, 7) THEN CASE WHEN k % 16 = 7 THEN 0 ELSE 1 END ELSE 2 END AS n_solutions
  FROM raw),
quota AS (SELECT *, len(cases) AS n, CASE WHEN len(cases) >= 3 THEN least(3, len(cases) - 2) WHEN len(cases) = 2 THEN 1 ELSE len(cases) END AS vis FROM cased),
made AS (
  SELECT *, CASE WHEN n - vis >= 2 THEN n - vis - least(20, greatest(1, (n - vis) // 3)) ELSE n - vis END AS rew,
    'taco_' || k || '_' || coalesce(nullif(substr(lower(trim(regexp_replace(name, '[^a-zA-Z0-9]+', '_', 'g'), '_')), 1, 80), ''), 'problem') AS id,
    CASE WHEN kind = 5 THEN '' ELSE 'Add   ' || k // 24 || ' numbers.' END AS statement, CASE WHEN entry = '' THEN 'stdin' ELSE 'callable' END AS io_mode,
    CASE WHEN k % 2 = 0 THEN 10.0::DOUBLE ELSE 2.0::DOUBLE END AS seconds, CASE WHEN k % 3 = 0 THEN 64 WHEN k % 6 = 1 THEN 12345678 ELSE 256 END AS memory,
    CASE WHEN kind >= 3 OR k % 3 <> 2 THEN true ELSE false END AS sound,
    CASE WHEN kind = 3 THEN '{_q(ADD)}' WHEN kind = 4 THEN '{_q(PAIR)}' WHEN kind = 7 THEN '{_q(ECHO)}' WHEN k % 3 = 0 THEN '{_q(CLEAN)}' WHEN k % 3 = 1 THEN '{_q(WARNED)}' ELSE '' END AS best
  FROM quota)
"""


def _q(code: str) -> str:
    return code.replace("'", "''")
