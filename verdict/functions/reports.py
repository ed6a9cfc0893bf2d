"""Execution reports as columns. A report is a struct (syntax_valid, syntax_error, runs); see ``sources.schema``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the parts of a reward weigh, what each fault costs, by the name that its reason has in the log, what a
# completion without code gets, and what faults cost a candidate's score.
WEIGHTS = {"syntax": 0.05, "visible": 0.15, "reward_tests": 0.60, "correctness_bonus": 0.20}
FAULTS = {"syntax_error": 0.2, "timeout": 0.6, "runtime_error": 0.3, "possible_sample_hardcode": 0.6, "output_too_long": 0.5}
NO_CODE_REWARD, NO_CODE_REASON = -1.0, "missing_python_code_block"
SCORE_COSTS = {"timeout": 0.5, "runtime_error": 0.25, "truncated": 0.5}
INVALID_SCORE = -1.0


def all_passed(report: Column) -> Column:
    """True for a valid program all of whose runs passed, and so for one without runs."""
    return F.coalesce(report["syntax_valid"], F.lit(False)) & F.coalesce(F.forall(report["runs"], lambda r: F.coalesce(r["passed"], F.lit(False))), F.lit(True))


def pass_rate(report: Column) -> Column:
    n = F.coalesce(F.size(report["runs"]), F.lit(0))
    passed = F.size(F.filter(report["runs"], lambda r: F.coalesce(r["passed"], F.lit(False))))
    return F.when(n <= 0, F.when(report["syntax_valid"], 1.0).otherwise(0.0)).otherwise(passed / F.greatest(n, F.lit(1)))


def any_run(report: Column, test) -> Column:
    return F.coalesce(F.exists(report["runs"], lambda r: F.coalesce(test(r), F.lit(False))), F.lit(False))


def failed_at_runtime(run: Column) -> Column:
    return (F.coalesce(run["returncode"], F.lit(0)) != 0) & ~F.coalesce(run["timed_out"], F.lit(False))


def any_timeout(report: Column) -> Column:
    return any_run(report, lambda r: r["timed_out"])


def any_runtime_error(report: Column) -> Column:
    return any_run(report, failed_at_runtime)


def any_truncated(report: Column) -> Column:
    return any_run(report, lambda r: r["output_truncated"])


def first_failed(report: Column) -> Column:
    return F.get(F.filter(report["runs"], lambda r: ~F.coalesce(r["passed"], F.lit(False))), F.lit(0))


def run_failure(run: Column) -> Column:
    """Why a run that did not pass failed: time comes first, then output, exit status, answer."""
    return (
        F.when(F.coalesce(run["timed_out"], F.lit(False)), "TIMEOUT")
        .when(F.coalesce(run["output_truncated"], F.lit(False)), "OUTPUT_TOO_LONG")
        .when(F.coalesce(run["returncode"], F.lit(0)) != 0, "RUNTIME_ERROR")
        .otherwise("WRONG_ANSWER")
    )


def failure_kind(report: Column) -> Column:
    run = first_failed(report)
    return F.when(~report["syntax_valid"], "SYNTAX_ERROR").when(run.isNull(), "NONE").otherwise(run_failure(run))


def failure_summary(report: Column, reveal: bool) -> Column:
    """(kind, message, test_id, stdin, expected, actual, stderr); the case itself only if it may be shown."""
    run, kind = first_failed(report), failure_kind(report)
    message = F.when(kind == "SYNTAX_ERROR", report["syntax_error"]).when(kind == "NONE", "All tests passed.").otherwise(F.concat(kind, F.lit(" on "), run["test_id"]))
    shown = [F.coalesce(run[c], F.lit("")).alias(c) if reveal else F.lit("").alias(c) for c in ("stdin", "expected", "actual", "stderr")]
    return F.struct(kind.alias("kind"), message.alias("message"), F.coalesce(run["test_id"], F.lit("")).alias("test_id"), *shown)


def first_failed_detail(report: Column, width: int = 500) -> Column:
    """The first failing run for a log, with its texts cut to ``width`` characters; null if all passed."""
    run = first_failed(report)
    cut = [F.substring(run[c], 1, width).alias(c) for c in ("expected", "actual", "stderr")]
    empty = [F.lit(None).cast("string").alias(c) for c in ("expected", "actual", "stderr")]
    invalid = F.struct(F.lit("SYNTAX_ERROR").alias("kind"), report["syntax_error"].alias("error"), F.lit(None).cast("string").alias("test_id"), F.lit(None).cast("boolean").alias("timed_out"), F.lit(None).cast("int").alias("returncode"), *empty)
    failed = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("error"), run["test_id"].alias("test_id"), run["timed_out"].alias("timed_out"), run["returncode"].alias("returncode"), *cut)
    return F.when(~report["syntax_valid"], invalid).when(run.isNotNull(), failed)


def candidate_score(report: Column) -> Column:
    """The rate of passed runs less what time-outs, crashes and cut outputs cost; -1 for an invalid program."""
    found = {"timeout": any_timeout(report), "runtime_error": any_runtime_error(report), "truncated": any_truncated(report)}
    cost = sum((F.when(found[name], price).otherwise(0.0) for name, price in SCORE_COSTS.items()), F.lit(0.0))
    return F.when(~report["syntax_valid"], INVALID_SCORE).otherwise(pass_rate(report) - cost)


def reward(visible: Column, tested: Column, hardcoded: Column) -> Column:
    """The reward of a completion from its reports on the visible and the reward suite.

    A struct (total, the parts of ``WEIGHTS``, penalties, reasons); ``total`` is not rounded.
    """
    ran = F.size(tested["runs"]) > 0
    share = {
        "syntax": F.when(visible["syntax_valid"], 1.0).otherwise(0.0),
        "visible": pass_rate(visible),
        "reward_tests": F.when(ran, pass_rate(tested)).otherwise(0.0),
        "correctness_bonus": F.when(all_passed(visible) & ran & all_passed(tested), 1.0).otherwise(0.0),
    }
    either = lambda told: told(visible) | told(tested)
    found = {"syntax_error": ~visible["syntax_valid"], "timeout": either(any_timeout), "runtime_error": either(any_runtime_error), "possible_sample_hardcode": hardcoded, "output_too_long": either(any_truncated)}
    parts = {name: F.lit(weight) * share[name] for name, weight in WEIGHTS.items()}
    penalties = sum((-F.when(found[name], cost).otherwise(0.0) for name, cost in FAULTS.items()), F.lit(0.0))
    reasons = F.filter(F.array(*(F.when(found[name], F.lit(name)) for name in FAULTS)), lambda r: r.isNotNull())
    total = sum(parts.values(), F.lit(0.0)) + penalties
    return F.struct(total.alias("total"), *(c.alias(n) for n, c in parts.items()), penalties.alias("penalties"), reasons.alias("reasons"))


def final_failure(records: Column) -> Column:
    """Why a run of attempts ended unsolved: the last record's evaluation, reward check, or visible failure."""
    last = F.try_element_at(records, F.lit(-1))
    chosen = F.get(last["candidates"], last["selected_index"])["visible_result"]
    return (
        F.when(F.size(records) == 0, "MISSING_CODE")
        .when(last["eval_result"].isNotNull() & ~all_passed(last["eval_result"]), "INTERNAL_EVAL_FAILED")
        .when(last["reward_result"].isNotNull() & ~all_passed(last["reward_result"]), "INTERNAL_REWARD_FAILED")
        .otherwise(failure_kind(chosen))
    )
