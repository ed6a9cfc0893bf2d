"""Executable rewards: completions scored on visible and reward suites, their log, audit and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.python_code import round6
from verdict.functions.reports import NO_CODE_REASON, NO_CODE_REWARD, reward
from verdict.functions.text import extract_python_code, looks_hardcoded, py_strip
from verdict.operators.execute import ExecConfig, run_suites
from verdict.operators.order_stats import float_stats
from verdict.operators.records import bad_completion, fenced, reward_log_row
from verdict.sources.schema import best_verified

PARTS = ("total", "syntax", "visible", "reward_tests", "correctness_bonus", "penalties", "reasons")


def score(completions: DataFrame, problems: DataFrame, config: ExecConfig = ExecConfig()) -> DataFrame:
    """Adds the code and the parts of the reward to (problem_id, completion, ...). Unknown problems raise.

    Only the columns that running needs are joined, by shuffle, as cases can be megabytes.
    """
    slim = problems.select(F.col("id").alias("__id"), "io_mode", "entry_point", "time_limit_sec", F.col("tests.visible_tests").alias("__visible"), F.col("tests.reward_tests").alias("__reward"))
    missing = completions.join(slim, completions.problem_id == slim["__id"], "left_anti")
    if not missing.isEmpty():
        raise ValueError("completions of unknown problems")
    rows = completions.join(slim, completions.problem_id == slim["__id"]).withColumn("code", extract_python_code(F.col("completion")))
    code = F.when(F.col("code") != "", F.col("code"))
    entry = F.when(F.col("io_mode") == "callable", F.col("entry_point")).otherwise("")
    ran = run_suites(rows, {"__v": (code, F.col("__visible"), "visible"), "__r": (code, F.col("__reward"), "reward")}, F.col("time_limit_sec"), entry, config=config)
    inputs = F.transform(F.concat("__visible", "__reward"), lambda t: t["stdin"])
    parts = reward(F.col("__v"), F.col("__r"), looks_hardcoded(F.col("code"), F.col("io_mode"), inputs))
    none = F.struct(F.lit(NO_CODE_REWARD).alias("total"), *(F.lit(0.0).alias(p) for p in PARTS[1:-1]), F.array(F.lit(NO_CODE_REASON)).alias("reasons"))
    scored = ran.withColumn("__p", F.when(code.isNull(), none).otherwise(parts))
    return scored.select(*completions.columns, "code", round6("__p.total").alias("total"), *(F.col(f"__p.{p}").alias(p) for p in PARTS[1:]))


def log_rows(scored: DataFrame, reward_call: int, run_id: str | None = None) -> DataFrame:
    """Rows of the reward log. ``run_id`` keeps calls of a resumed run apart from those before."""
    out = scored.select(F.lit(reward_call).cast("long").alias("reward_call"), "completion_index", "problem_id", *PARTS, *reward_log_row(F.col("code")))
    return out if run_id is None else out.withColumn("run_id", F.lit(run_id))


def stats(value: Column) -> Column:
    """min, median, mean and max over a bounded number of rows; zeros for none."""
    return F.struct(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in (("min", F.min(value)), ("median", F.median(value)), ("mean", F.avg(value)), ("max", F.max(value)))))


def groups(log: DataFrame, keys: tuple[str, ...] = ("reward_call", "problem_id")) -> DataFrame:
    """One row per group of completions of one call: its size and whether rewards vary."""
    total = F.coalesce("total", F.lit(0.0))
    return log.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(total) - F.min(total) > 1e-9).alias("varying"))


def group_variance(log: DataFrame, keys: tuple[str, ...] = ("reward_call", "problem_id")) -> DataFrame:
    """One row: groups, those whose rewards vary, and the share of the others."""
    counted = groups(log, keys).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("varying").cast("long")), F.lit(0)).alias("varying_reward_groups"))
    return counted.withColumn("zero_variance_group_rate", F.when(F.col("groups") > 0, 1 - F.col("varying_reward_groups") / F.greatest("groups", F.lit(1))).otherwise(0.0))


def reason_counts(log: DataFrame) -> DataFrame:
    return log.select(F.explode("reasons").alias("reason")).groupBy("reason").count()


def summarize(log: DataFrame, keys: tuple[str, ...] = ("reward_call", "problem_id")) -> DataFrame:
    """One row of figures over a reward log. Medians are exact; see ``order_stats``."""
    total = F.coalesce("total", F.lit(0.0))
    n = F.count("*")
    rate = lambda c: F.when(n > 0, c / F.greatest(n, F.lit(1))).otherwise(0.0)
    main = log.agg(
        n.alias("completions"),
        rate(F.sum((total >= 0.999).cast("int"))).alias("fully_correct_rate"),
        rate(F.countDistinct(F.nullif(F.col("code_hash"), F.lit("")))).alias("unique_code_hash_rate"),
    )
    for name, value in (("reward", total), ("code_chars", F.coalesce("code_chars", F.lit(0)))):
        main = main.crossJoin(float_stats(log, value).select(F.struct("min", "median", "mean", "max").alias(name)))
    reasons = reason_counts(log).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reason_counts"))
    return main.crossJoin(group_variance(log, keys)).crossJoin(reasons)  # one row each


def audit(problems: DataFrame, limit: int = 200, config: ExecConfig = ExecConfig()) -> DataFrame:
    """Per problem the rewards of its verified solution and of a known-bad completion; ``violation`` if the order is wrong.

    ``limit`` takes the first problems by id; 0 takes all.
    """
    rows = problems.where((best_verified(F.col("oracle")) != "") & (F.size("tests.reward_tests") > 0))
    rows = rows.orderBy("id").limit(limit) if limit > 0 else rows
    oracle = rows.select(F.col("id").alias("problem_id"), fenced(py_strip(best_verified(F.col("oracle")))).alias("completion"))
    bad = rows.select(F.col("id").alias("problem_id"), bad_completion().alias("completion"))
    both = score(oracle.withColumn("side", F.lit("oracle")).unionByName(bad.withColumn("side", F.lit("bad"))), rows, config)
    wide = both.groupBy("problem_id").agg(*(F.first(F.when(F.col("side") == side, F.struct(*PARTS)), True).alias(side) for side in ("oracle", "bad")))
    return wide.withColumn("margin", F.col("oracle.total") - F.col("bad.total")).withColumn("violation", F.col("oracle.total") <= F.col("bad.total"))


def audit_report(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("problems"), stats(F.col("oracle.total")).alias("oracle_reward"), stats(F.col("bad.total")).alias("bad_reward"), stats(F.col("margin")).alias("margin"), F.sum(F.col("violation").cast("long")).alias("ordering_violations"))


def first_violations(audited: DataFrame, limit: int = 10) -> DataFrame:
    """The first problems by id whose bad completion does at least as well as the verified solution."""
    return audited.where("violation").orderBy("problem_id").limit(limit)
