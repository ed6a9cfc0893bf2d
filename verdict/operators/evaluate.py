"""Metrics of solve results and the paired comparison of two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.reports import all_passed, any_runtime_error, any_timeout, pass_rate
from verdict.operators.order_stats import float_stats
from verdict.operators.seeded import indexed


def solved(status: Column) -> Column:
    return F.coalesce(status == "VERIFIED_SOLVED", F.lit(False))


def selected(record: Column) -> Column:
    """The selected candidate of an attempt; null where the index points at none."""
    return F.get(record["candidates"], record["selected_index"])


def last_record(records: Column) -> Column:
    return F.try_element_at(records, F.lit(-1))


def selected_code(records: Column) -> Column:
    return F.coalesce(selected(last_record(records))["code"], F.lit(""))


def selected_pass_rate(records: Column) -> Column:
    chosen = selected(last_record(records))
    return F.when(chosen.isNull(), 0.0).otherwise(pass_rate(chosen["visible_result"]))


def _share(flag: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("int")), F.lit(0.0))


def metrics(results: DataFrame) -> DataFrame:
    """One row of 14 figures, all over all results; no rows for no results."""
    first, last = F.get("attempt_records", F.lit(0)), last_record(F.col("attempt_records"))
    begun, ended = selected(first), selected(last)
    seen, none = ended["visible_result"], ended.isNull()
    rate = lambda report: F.avg(F.when(report.isNull(), 0.0).otherwise(pass_rate(report)))
    verified, initially = _share(solved(F.col("status"))), _share(F.when(first["eval_result"].isNotNull(), all_passed(first["eval_result"])))
    return results.agg(
        F.count("*").alias("num_problems"),
        _share(F.when(begun.isNotNull(), all_passed(begun["visible_result"]))).alias("initial_visible_success_rate"),
        _share(F.exists(first["candidates"], lambda c: all_passed(c["visible_result"]))).alias("initial_candidate_visible_pass_at_k"),
        initially.alias("initial_verified_success_rate"),
        _share(F.when(~none, all_passed(seen))).alias("final_visible_success_rate"),
        verified.alias("verified_success_rate"),
        rate(seen).alias("visible_test_pass_rate"), rate(last["reward_result"]).alias("reward_test_pass_rate"), rate(last["eval_result"]).alias("eval_test_pass_rate"),
        F.avg("attempts").alias("avg_attempts"),
        _share(none | ~seen["syntax_valid"]).alias("syntax_error_rate"),
        _share(~none & any_runtime_error(seen)).alias("runtime_error_rate"), _share(~none & any_timeout(seen)).alias("timeout_rate"),
        (verified - initially).alias("repair_gain"),
    ).where("num_problems > 0")


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last by ``order``, as where results name a problem twice. Partial maxima precede the shuffle."""
    found = rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(*order)).alias("__r"))
    return found.select("__r.*")


def in_report_order(results: DataFrame, problems: DataFrame, order: str = "id") -> DataFrame:
    """The results of ``problems``, with ``place``: where the problem stands among them by ``order``, counted from 0.
    Results of other problems do not count; of several for one problem the caller keeps one (``last_wins``)."""
    places = indexed(problems.select(order).distinct(), order, "place")
    named = problems.select("id", *([order] if order != "id" else [])).distinct().join(places, order).select(F.col("id").alias("problem_id"), "place")
    return results.join(named, "problem_id")


def paired(base: DataFrame, candidate: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """One row per problem of both reports: solved flags, transition, reasons, selected codes and the io mode.

    Reports have problem_id, status, failure_reason and attempt_records; ``modes`` has problem_id and io_mode.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        reason = F.coalesce(F.nullif("failure_reason", F.lit("")), F.lit("SOLVED"))
        return df.select("problem_id", solved(F.col("status")).alias(f"{name}_solved"), reason.alias(f"{name}_reason"), selected_code(F.col("attempt_records")).alias(f"{name}_code"), selected_pass_rate(F.col("attempt_records")).alias(f"{name}_visible_pass_rate"))

    rows = side(base, "base").join(side(candidate, "candidate"), "problem_id")
    rows = rows.join(modes.select("problem_id", "io_mode"), "problem_id", "left") if modes is not None else rows.withColumn("io_mode", F.lit(None).cast("string"))
    b, c = F.col("base_solved"), F.col("candidate_solved")
    transition = F.when(b & c, "both_solved").when(b, "base_only_solved").when(c, "candidate_only_solved").otherwise("neither_solved")
    return rows.withColumn("io_mode", F.coalesce("io_mode", F.lit("unknown"))).withColumn("transition", transition)


def missing(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(side, problem_id) of problems that only one report has."""
    ids = [df.select("problem_id").distinct() for df in (base, candidate)]
    one = ids[0].join(ids[1], "problem_id", "left_anti").select(F.lit("base_only").alias("side"), "problem_id")
    return one.unionByName(ids[1].join(ids[0], "problem_id", "left_anti").select(F.lit("candidate_only").alias("side"), "problem_id"))


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("transition").count()


def failure_reasons(pairs: DataFrame) -> DataFrame:
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_reason").alias("reason")) for s in ("base", "candidate"))))
    return pairs.select(sides.alias("x")).groupBy("x.side", "x.reason").count()


def by_io_mode(pairs: DataFrame) -> DataFrame:
    sums = pairs.groupBy("io_mode").agg(F.count("*").alias("problems"), *(F.sum(F.col(f"{s}_solved").cast("long")).alias(f"{s}_solved") for s in ("base", "candidate")))
    return sums.select("*", *((F.col(f"{s}_solved") / F.col("problems")).alias(f"{s}_verified_success_rate") for s in ("base", "candidate")))


def lengths(rows: DataFrame, side: str, value: str) -> DataFrame:
    """(side, median, mean, max) of a column, per side."""
    return float_stats(rows, F.col(value), side).select(side, "median", "mean", "max")


def code_lengths(pairs: DataFrame) -> DataFrame:
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.length(f"{s}_code").alias("n")) for s in ("base", "candidate"))))
    return lengths(pairs.select(sides.alias("x")).select("x.*"), "side", "n")


def regressions(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """The first problems, by id, that only the base solved."""
    lost = pairs.where(F.col("base_solved") & ~F.col("candidate_solved")).orderBy("problem_id").limit(limit)
    previews = [F.substring(f"{s}_code", 1, 500).alias(f"{s}_code_preview") for s in ("base", "candidate")]
    return lost.select("problem_id", "io_mode", F.col("candidate_reason").alias("candidate_failure_reason"), *(F.length(f"{s}_code").alias(f"{s}_code_chars") for s in ("base", "candidate")), "candidate_visible_pass_rate", *previews)
