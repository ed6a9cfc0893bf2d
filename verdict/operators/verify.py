"""Oracle verification: the first reference solution that passes all cases, preferring one that compiles silently.

Solutions are tried in rounds: the k-th solution of all problems that are still open runs as rows of one table, so that a
problem with slow solutions holds no task and later solutions do not run in vain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.python_code import has_syntax_warning
from verdict.functions.reports import all_passed, failure_kind, pass_rate
from verdict.operators.execute import ExecConfig, run_suites
from verdict.sources.checkpoint import checkpointed
from verdict.sources.schema import best_verified

ATTEMPT = "struct<solution_index:int,syntax_valid:boolean,syntax_warning:boolean,pass_rate:double,failed_test_id:string,failed_kind:string>"


def attempt(k: int, report: Column, warned: Column) -> Column:
    """What is kept of a solution's report."""
    first = F.get(F.filter(report["runs"], lambda r: ~r["passed"]), F.lit(0))
    kind = F.nullif(failure_kind(report), F.lit("NONE"))
    rate = F.when(F.size(report["runs"]) > 0, pass_rate(report)).otherwise(report["syntax_valid"].cast("double"))
    return F.struct(F.lit(k).alias("solution_index"), report["syntax_valid"].alias("syntax_valid"), warned.alias("syntax_warning"), rate.alias("pass_rate"), first["test_id"].alias("failed_test_id"), kind.alias("failed_kind")).cast(ATTEMPT)


def verify(problems: DataFrame, max_solutions: int = 3, config: ExecConfig = ExecConfig(), strict: bool = False) -> DataFrame:
    """Problems with ``verified`` set on the chosen solution alone, and ``verified``, ``outcome`` and ``attempts`` beside.

    A problem is open until a solution passes silently; a pass with a warning is kept for want of better. A problem
    without cases verifies vacuously unless ``strict``.
    """
    rows = checkpointed(problems.select(F.monotonically_increasing_id().alias("row"), F.struct(*problems.columns).alias("kept")))
    cases = F.concat("kept.tests.visible_tests", "kept.tests.reward_tests", "kept.tests.eval_tests")
    entry = F.when(F.col("kept.io_mode") == "callable", F.col("kept.entry_point")).otherwise("")
    open_ = rows.select("row", F.slice("kept.oracle.solutions", 1, max_solutions)["code"].alias("codes"), cases.alias("cases"), F.col("kept.time_limit_sec").alias("limit"), entry.alias("entry"))
    open_ = open_.where((F.size("codes") > 0) & (F.lit(not strict) | (F.size("cases") > 0)))
    rounds = []
    for k in range(max_solutions):
        code = F.coalesce(F.get("codes", F.lit(k)), F.lit(""))
        tried = run_suites(open_.withColumn("code", code), {"report": (F.col("code"), F.col("cases"), "oracle")}, F.col("limit"), F.col("entry"), config=config)
        tried = tried.withColumn("attempt", attempt(k, F.col("report"), has_syntax_warning("code"))).withColumn("passed", all_passed(F.col("report")))
        rounds.append(checkpointed(tried.select("row", "attempt", "passed")))
        decided = rounds[-1].where(F.col("passed") & ~F.col("attempt.syntax_warning")).select("row")
        open_ = checkpointed(open_.where(F.size("codes") > k + 1).join(decided, "row", "left_anti"))
        if open_.isEmpty():
            break
    # A silent pass is the last attempt; without one the first pass counts.
    found = reduce(DataFrame.unionByName, rounds).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("attempt", "passed"))).alias("tried"))
    passes = F.transform(F.filter("tried", lambda t: t["passed"]), lambda t: t["attempt"])
    silent = F.filter(passes, lambda a: ~a["syntax_warning"])
    chosen = F.coalesce(F.get(silent, F.lit(0))["solution_index"], F.get(passes, F.lit(0))["solution_index"])
    found = found.select("row", chosen.alias("chosen"), F.transform("tried", lambda t: t["attempt"]).alias("attempts"))

    out = rows.join(found, "row", "left")
    marked = F.transform("kept.oracle.solutions", lambda s, k: F.struct(s["language"].alias("language"), s["code"].alias("code"), (k == F.coalesce("chosen", F.lit(-1))).alias("verified")))
    oracle = F.struct(marked.alias("solutions"), F.col("kept.oracle.source").alias("source"), F.col("kept.oracle.url").alias("url"))
    attempts = F.coalesce("attempts", F.array().cast(f"array<{ATTEMPT}>")).alias("attempts")
    done = out.select(*(F.col(f"kept.{c}").alias(c) if c != "oracle" else oracle.alias("oracle") for c in problems.columns), F.col("chosen").isNotNull().alias("verified"), attempts)
    outcome = F.when(best_verified(F.col("oracle")) != "", "verified").when(F.size("oracle.solutions") == 0, "no_solution").otherwise("failed")
    return done.withColumn("outcome", outcome)


def counters(verified: DataFrame) -> DataFrame:
    return verified.agg(*(F.sum((F.col("outcome") == name).cast("long")).alias(name) for name in ("verified", "failed", "no_solution")))
