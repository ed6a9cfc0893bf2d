"""Schemas of all tables and the coercion of loosely typed input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE = "struct<stdin:string,expected_stdout:string,id:string,timeout_sec:double>"
RUN = "struct<test_id:string,suite:string,passed:boolean,stdin:string,expected:string,actual:string,stderr:string,returncode:int,timed_out:boolean,output_truncated:boolean>"
REPORT = f"struct<syntax_valid:boolean,syntax_error:string,runs:array<{RUN}>>"
SOLUTION = "struct<language:string,code:string,verified:boolean>"
CANDIDATE = f"struct<code:string,visible_result:{REPORT},score:double>"
RECORD = f"struct<turn:int,context_type:string,candidates:array<{CANDIDATE}>,selected_index:int,reward_result:{REPORT},eval_result:{REPORT}>"
PROBLEM = f"""id string, statement string, input_format string, output_format string, constraints array<string>, language string,
time_limit_sec double, memory_limit_mb int, io_mode string, entry_point string,
tests struct<visible_tests:array<{CASE}>,reward_tests:array<{CASE}>,eval_tests:array<{CASE}>>,
oracle struct<solutions:array<{SOLUTION}>,source:string,url:string>"""
#: As written to JSON files, with the specification in a field of its own.
PROBLEM_FILE = f"""problem struct<id:string,statement:string,input_format:string,output_format:string,constraints:array<string>,language:string,
time_limit_sec:double,memory_limit_mb:int,io_mode:string,entry_point:string>,
tests struct<visible_tests:array<{CASE}>,reward_tests:array<{CASE}>,eval_tests:array<{CASE}>>,
oracle struct<solutions:array<{SOLUTION}>,source:string,url:string>"""
RESULT = f"problem_id string, status string, attempts int, code string, failure_reason string, diagnostic_summary string, attempt_records array<{RECORD}>"
REWARD_LOG = """reward_call bigint, completion_index int, problem_id string, total double, syntax double, visible double, reward_tests double,
correctness_bonus double, penalties double, reasons array<string>, code_chars int, code_hash string"""
SFT = "instruction string, input string, output string"

STATUSES = ("VISIBLE_SOLVED", "VERIFIED_SOLVED", "FAILED")
FAILURES = ("NONE", "MISSING_CODE", "SYNTAX_ERROR", "WRONG_ANSWER", "RUNTIME_ERROR", "TIMEOUT", "OUTPUT_TOO_LONG", "INTERNAL_EVAL_FAILED")


def text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def cases(items: Column, prefix: str) -> Column:
    """Cases with defaults; a case without an id gets one by its place, counted from 1."""
    def fill(t: Column, k: Column) -> Column:
        ident = F.when(F.coalesce(t["id"], F.lit("")) != "", t["id"]).otherwise(F.format_string(f"{prefix}-%04d", (k + 1).cast("int")))
        return F.struct(text(t["stdin"]).alias("stdin"), text(t["expected_stdout"]).alias("expected_stdout"), ident.alias("id"), t["timeout_sec"].alias("timeout_sec"))

    return F.coalesce(F.transform(items, fill), F.array().cast(f"array<{CASE}>"))


def coerced(raw: DataFrame) -> DataFrame:
    """Rows of PROBLEM_FILE as rows of PROBLEM: empty strings for nulls, defaults for limits, no solutions without code."""
    p, t, o = F.col("problem"), F.col("tests"), F.col("oracle")
    solutions = F.transform(F.filter(o["solutions"], lambda s: F.coalesce(s["code"], F.lit("")) != ""), lambda s: F.struct(F.coalesce(s["language"], F.lit("python3")).alias("language"), s["code"].alias("code"), F.coalesce(s["verified"], F.lit(False)).alias("verified")))
    return raw.select(
        *(text(p[c]).alias(c) for c in ("id", "statement", "input_format", "output_format")),
        F.coalesce(p["constraints"], F.array().cast("array<string>")).alias("constraints"),
        F.coalesce(F.nullif(p["language"], F.lit("")), F.lit("python3")).alias("language"),
        F.coalesce(F.nullif(p["time_limit_sec"], F.lit(0.0)), F.lit(2.0)).alias("time_limit_sec"),
        F.coalesce(F.nullif(p["memory_limit_mb"], F.lit(0)), F.lit(256)).alias("memory_limit_mb"),
        F.coalesce(F.nullif(p["io_mode"], F.lit("")), F.lit("stdin")).alias("io_mode"),
        text(p["entry_point"]).alias("entry_point"),
        F.struct(*(cases(t[f"{n}_tests"], n).alias(f"{n}_tests") for n in ("visible", "reward", "eval"))).alias("tests"),
        F.struct(F.coalesce(solutions, F.array().cast(f"array<{SOLUTION}>")).alias("solutions"), text(o["source"]).alias("source"), text(o["url"]).alias("url")).alias("oracle"),
    )


def best_verified(oracle: Column) -> Column:
    """The first verified Python solution, or an empty text."""
    return F.coalesce(F.get(F.filter(oracle["solutions"], lambda s: (s["language"] == "python3") & s["verified"]), F.lit(0))["code"], F.lit(""))


def has_all_groups(tests: Column) -> Column:
    return (F.size(tests["visible_tests"]) > 0) & (F.size(tests["reward_tests"]) > 0) & (F.size(tests["eval_tests"]) > 0)


def case_count(tests: Column) -> Column:
    return F.size(tests["visible_tests"]) + F.size(tests["reward_tests"]) + F.size(tests["eval_tests"])
