"""The driver's tables as reports, logs and problems (see the README for the mapping)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_of_line() -> Column:
    failed = F.col("l_returnflag") == "R"
    open_line, closed = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    return F.struct(
        F.concat(F.lit("t-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("test_id"), F.lit("visible").alias("suite"), (~failed).alias("passed"),
        F.lit("").alias("stdin"), F.lit("").alias("expected"), F.lit("").alias("actual"), F.lit("").alias("stderr"),
        F.when(failed & closed & (F.col("l_quantity") > 25), 1).otherwise(0).alias("returncode"),
        (failed & open_line & (F.col("l_quantity") > 40)).alias("timed_out"), (failed & open_line & (F.col("l_quantity") <= 10)).alias("output_truncated"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with ``report`` over all lines, ``visible`` over lines 1 and 2 and ``tested`` over the rest."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", run_of_line().alias("run"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "run")
    runs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(runs, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(runs.schema["lines"].dataType)))
    valid = F.col("o_orderpriority") != "5-LOW"

    def report(keep=None) -> Column:
        picked = F.col("lines") if keep is None else F.filter("lines", keep)
        return F.struct(valid.alias("syntax_valid"), F.when(valid, "").otherwise("bad syntax").alias("syntax_error"), F.transform(picked, lambda x: x["run"]).alias("runs"))

    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", report().alias("report"), report(lambda x: x["l_linenumber"] <= 2).alias("visible"), report(lambda x: x["l_linenumber"] > 2).alias("tested"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reports with the place of each order among those of its customer, from 0."""
    return reports(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)


def reward_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a reward log; a group is what one user did of one type on one day."""
    e = table(spark, sf_dir, "events")
    chars = F.get_json_object("props", "$.k").cast("int")
    value = F.col("value")
    reasons = F.filter(F.array(F.when(value < 20, "timeout"), F.when((value >= 20) & (value < 50), "runtime_error"), F.when(F.col("event_type").isin("click", "view"), "possible_sample_hardcode")), lambda r: r.isNotNull())
    return e.select(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("reward_call"), F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("problem_id"), value.alias("total"), chars.alias("code_chars"), F.sha2(F.get_json_object("props", "$.k"), 256).alias("code_hash"), reasons.alias("reasons"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): user turns that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


#: Per order: counts and flags of its lines, for SQL.
REPORT_SQL = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AS passed,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25 THEN 1 ELSE 0 END AS returncode,
    l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 40 AS timed_out,
    l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity <= 10 AS truncated
  FROM lineitem),
flags AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority <> '5-LOW' AS valid,
    count(l_orderkey) AS n, coalesce(sum(passed::INT), 0)::INT AS p,
    coalesce(bool_or(timed_out), false) AS t, coalesce(bool_or(returncode <> 0 AND NOT timed_out), false) AS r, coalesce(bool_or(truncated), false) AS c,
    count(CASE WHEN l_linenumber <= 2 THEN 1 END) AS vn, coalesce(sum(CASE WHEN l_linenumber <= 2 THEN passed::INT END), 0)::INT AS vp,
    coalesce(bool_or(l_linenumber <= 2 AND timed_out), false) AS vt, coalesce(bool_or(l_linenumber <= 2 AND returncode <> 0), false) AS vr,
    count(CASE WHEN l_linenumber > 2 THEN 1 END) AS rn, coalesce(sum(CASE WHEN l_linenumber > 2 THEN passed::INT END), 0)::INT AS rp
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY ALL),
rates AS (
  SELECT *, valid AND p = n AS all_passed, CASE WHEN n = 0 THEN valid::INT::DOUBLE ELSE p::DOUBLE / n END AS rate,
    valid AND vp = vn AS v_all, CASE WHEN vn = 0 THEN valid::INT::DOUBLE ELSE vp::DOUBLE / vn END AS v_rate,
    valid AND rp = rn AS r_all, CASE WHEN rn = 0 THEN valid::INT::DOUBLE ELSE rp::DOUBLE / rn END AS r_rate
  FROM flags),
scored AS (
  SELECT *, CASE WHEN NOT valid THEN -1.0::DOUBLE ELSE rate - (CASE WHEN t THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN r THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.5::DOUBLE ELSE 0 END) END AS score,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k
  FROM rates)
"""

LOG_SQL = """
log AS (
  SELECT datediff('day', DATE '1970-01-01', ts::DATE) AS reward_call, user_id::VARCHAR || '/' || event_type AS problem_id, value AS total,
    CAST(json_extract_string(props, '$.k') AS INT) AS code_chars, sha256(json_extract_string(props, '$.k')) AS code_hash,
    [x FOR x IN [CASE WHEN value < 20 THEN 'timeout' END, CASE WHEN value >= 20 AND value < 50 THEN 'runtime_error' END, CASE WHEN event_type IN ('click', 'view') THEN 'possible_sample_hardcode' END] IF x IS NOT NULL] AS reasons
  FROM events)
"""

EXCHANGE_SQL = """
turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS next_role, lead(coalesce(text, '')) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, ''))),
exchanges AS (SELECT conv_id, turn, text AS question, answer FROM turns WHERE role = 'user' AND next_role = 'assistant')
"""
