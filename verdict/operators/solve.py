"""The solver: generate, run, select, repair, over all problems at once, a turn at a time.

Rows that are decided leave the active table, so turns shrink; ``turns`` hands them out as each turn ends, so that they can
be stored at once. Each turn is checkpointed before it is used, as generators need not be repeatable. The prompt of a turn is built from visible cases and reports only; reward and evaluation cases are never
columns of the table that the prompt builder sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions.reports import all_passed, candidate_score, failure_summary, final_failure, pass_rate
from verdict.functions.text import extract_python_code, problem_seed
from verdict.operators.execute import ExecConfig, run_suites
from verdict.operators.records import initial_prompt, problem_prompt, repair_prompt, review_prompt
from verdict.operators.resume import remaining
from verdict.sources import io
from verdict.sources.checkpoint import checkpointed
from verdict.sources.schema import CANDIDATE, RECORD, REPORT, RESULT


# What results and reports say.
NO_VISIBLE = "At least one visible test is required for candidate selection."
VISIBLE_PASSED = "Visible and reward tests passed; no held-out tests configured."
ALL_PASSED = "Visible and held-out tests passed."
HELD_OUT_FAILED = "Final held-out evaluation failed; no repair feedback was provided."
REWARD_FAILED = "Internal reward verification failed; cases are withheld."
NO_CODE = "Missing Python code block."
NO_CANDIDATES = "Model returned no candidates."


class Generator(Protocol):
    """Writes programs. One is made per task by the factory that ``solve`` is given."""

    def generate(self, prompts: list[str], seeds: list[int], n: int) -> list[list[str]]:
        """``n`` raw responses for each prompt."""


class RuleGenerator:
    """Deterministic stand-in for a model: the first rule whose key is in the prompt answers."""

    def __init__(self, rules: list[tuple[str, list[str]]], default: str = "print(0)") -> None:
        self.rules, self.default = rules, default

    def generate(self, prompts: list[str], seeds: list[int], n: int) -> list[list[str]]:
        found = (next((codes for key, codes in self.rules if key in p), [self.default]) for p in prompts)
        return [[f"```python\n{codes[k % len(codes)]}\n```" for k in range(n)] for codes in found]


@dataclass(frozen=True)
class SolveConfig:
    max_repair_turns: int = 3
    candidates_per_turn: int = 1
    rerank_with_reward_tests: bool = False
    seed: int = 42
    execution: ExecConfig = ExecConfig()


def generate(rows: DataFrame, factory: Callable[[], Generator], n: int) -> DataFrame:
    """Adds ``responses`` to rows with ``prompt`` and ``seed``."""
    packed = rows.select(F.struct(*rows.columns).alias("row"), "prompt", "seed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            answers = model.generate(batch.column(1).to_pylist(), batch.column(2).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.list_(pa.string()))], ["row", "responses"])

    return packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, responses array<string>").select("row.*", "responses")


def best_candidate(candidates: Column) -> Column:
    """The index of the highest score, the lowest of equals."""
    return -F.array_max(F.transform(candidates, lambda c, k: F.struct(c["score"].alias("s"), (-k).alias("k"))))["k"]


def rerank(candidates: Column, reports: Column, default: Column) -> Column:
    """Among candidates that pass all visible cases the one that does best on the reward suite; ``default`` without any.

    ``reports`` has a reward report per candidate, null where it was not run.
    """
    keys = F.transform(candidates, lambda c, k: F.when(all_passed(c["visible_result"]) & F.get(reports, k).isNotNull(), F.struct(all_passed(F.get(reports, k)).cast("int").alias("a"), pass_rate(F.get(reports, k)).alias("p"), c["score"].alias("s"), (-k).alias("k"))))
    return F.coalesce(-F.array_max(F.filter(keys, lambda x: x.isNotNull()))["k"], default)


def _no_report(text: str) -> Column:
    return F.struct(F.lit(False).alias("syntax_valid"), F.lit(text).alias("syntax_error"), F.array().alias("runs")).cast(REPORT)


def _result(status: str, reason: Column | None, summary: Column, code: Column | None) -> list[Column]:
    return [F.lit(status).alias("status"), F.col("turn").alias("attempts"), (code if code is not None else F.lit(None).cast("string")).alias("code"), (reason if reason is not None else F.lit(None).cast("string")).alias("failure_reason"), summary.alias("diagnostic_summary"), F.col("records").alias("attempt_records")]


def turns(problems: DataFrame, factory: Callable[[], Generator], config: SolveConfig = SolveConfig()) -> Iterator[DataFrame]:
    """Results (problem_id, status, attempts, code, failure_reason, diagnostic_summary, attempt_records) of the problems
    that each turn decides, as it does. A turn begins when the results before it have been taken."""
    entry = F.when(F.col("io_mode") == "callable", F.col("entry_point")).otherwise("")
    suites = problems.select("id", F.col("tests.reward_tests").alias("reward_tests"), F.col("tests.eval_tests").alias("eval_tests"))
    base = problems.select("id", problem_prompt(F.col("tests.visible_tests")).alias("base"), F.col("tests.visible_tests").alias("visible_tests"), "time_limit_sec", entry.alias("entry"), problem_seed(config.seed, F.col("id")).alias("seed"), F.lit(0).alias("turn"), F.array().cast(f"array<{RECORD}>").alias("records"))
    unfit = base.where(F.size("visible_tests") == 0)
    yield unfit.select(F.col("id").alias("problem_id"), *_result("FAILED", F.lit("MISSING_VISIBLE_TESTS"), F.lit(NO_VISIBLE), None))
    active = checkpointed(base.where(F.size("visible_tests") > 0).select("*", initial_prompt(F.col("base")).alias("prompt"), F.lit("INITIAL_SOLVE").alias("context_type"), F.lit("").alias("diagnostic")))
    run = lambda df, **s: run_suites(df, s, F.col("time_limit_sec"), F.col("entry"), config=config.execution)
    for turn in range(1, config.max_repair_turns + 2):
        if active.isEmpty():
            break
        # Candidates run as rows of their own, so that tasks share them out, and are gathered again by problem.
        written = checkpointed(generate(active, factory, config.candidates_per_turn))
        tried = written.select("id", "time_limit_sec", "entry", "visible_tests", F.posexplode("responses").alias("k", "response")).withColumn("code", extract_python_code(F.col("response")))
        tried = run(tried, report=(F.when(F.col("code") != "", F.col("code")), F.col("visible_tests"), "visible"))
        tried = tried.withColumn("report", F.coalesce("report", _no_report(NO_CODE)))
        tried = tried.withColumn("candidate", F.struct("code", F.col("report").alias("visible_result"), candidate_score(F.col("report")).alias("score")).cast(CANDIDATE))
        gathered = tried.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "candidate"))), lambda x: x["candidate"]).alias("candidates"))
        empty = F.array(F.struct(F.lit("").alias("code"), _no_report(NO_CANDIDATES).alias("visible_result"), F.lit(-1.0).alias("score")).cast(CANDIDATE))
        now = written.drop("responses").join(gathered, "id", "left").withColumn("candidates", F.coalesce("candidates", empty)).withColumn("turn", F.lit(turn)).withColumn("selected", best_candidate(F.col("candidates")))
        now = checkpointed(now.join(suites, "id"))

        # The reward suite runs for candidates that pass the visible one: all of them to rerank, else the selected.
        chosen = F.lit(True) if config.rerank_with_reward_tests else F.col("k") == F.col("selected")
        hidden = now.select("id", "time_limit_sec", "entry", "reward_tests", "selected", F.posexplode("candidates").alias("k", "c")).where((F.size("reward_tests") > 0) & chosen & all_passed(F.col("c.visible_result")))
        hidden = run(hidden.select("id", "time_limit_sec", "entry", "reward_tests", "k", F.col("c.code").alias("code")), report=(F.col("code"), F.col("reward_tests"), "reward"))
        reports = hidden.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "report"))).alias("__reports"))
        now = now.join(reports, "id", "left").withColumn("__list", F.transform("candidates", lambda c, k: F.try_element_at("__reports", k)))
        if config.rerank_with_reward_tests:
            now = now.withColumn("selected", F.when(F.size("reward_tests") > 0, rerank(F.col("candidates"), F.col("__list"), F.col("selected"))).otherwise(F.col("selected")))
        now = now.withColumn("reward_result", F.get("__list", F.col("selected"))).withColumn("pick", F.get("candidates", F.col("selected")))
        visible_ok = all_passed(F.col("pick.visible_result"))
        reward_ok = (F.size("reward_tests") == 0) | F.coalesce(all_passed(F.col("reward_result")), F.lit(False))

        # The evaluation suite runs once, for the program that passed everything before it.
        held = F.when(visible_ok & reward_ok & (F.size("eval_tests") > 0), F.col("pick.code"))
        now = run(now.drop("__reports", "__list"), eval_result=(held, F.col("eval_tests"), "eval"))
        record = F.struct("turn", "context_type", "candidates", F.col("selected").alias("selected_index"), "reward_result", "eval_result").cast(RECORD)
        now = now.withColumn("records", F.concat("records", F.array(record)))
        state = F.when(~visible_ok, "REPAIR").when(~reward_ok, "REVIEW").when(F.size("eval_tests") == 0, "VISIBLE_SOLVED").when(all_passed(F.col("eval_result")), "VERIFIED_SOLVED").otherwise("EVAL_FAILED")
        failure = failure_summary(F.col("pick.visible_result"), reveal=True)
        now = checkpointed(now.withColumn("state", state).withColumn("failure", failure).withColumn("diagnostic", F.when(F.col("state") == "REVIEW", REWARD_FAILED).when(F.col("state") == "REPAIR", F.col("failure.message")).otherwise("")))
        ended = lambda s, *a: now.where(F.col("state") == s).select(F.col("id").alias("problem_id"), *_result(*a))  # noqa: B023, E731
        yield (
            ended("VISIBLE_SOLVED", "VISIBLE_SOLVED", None, F.lit(VISIBLE_PASSED), F.col("pick.code"))
            .unionByName(ended("VERIFIED_SOLVED", "VERIFIED_SOLVED", None, F.lit(ALL_PASSED), F.col("pick.code")))
            .unionByName(ended("EVAL_FAILED", "FAILED", F.lit("INTERNAL_EVAL_FAILED"), F.lit(HELD_OUT_FAILED), None))
        )
        # What goes on carries no hidden case and no hidden report but in its records, which no prompt reads.
        again = now.where(F.col("state").isin("REPAIR", "REVIEW"))
        prompt = F.when(F.col("state") == "REPAIR", repair_prompt(F.col("base"), F.col("pick.code"), F.col("failure"), F.col("turn"))).otherwise(review_prompt(F.col("base"), F.col("pick.code"), F.col("turn")))
        active = checkpointed(again.select("id", "base", "visible_tests", "time_limit_sec", "entry", "seed", "turn", "records", prompt.alias("prompt"), F.when(F.col("state") == "REPAIR", "VISIBLE_REPAIR").otherwise("HIDDEN_REVIEW").alias("context_type"), "diagnostic"))
    yield active.select(F.col("id").alias("problem_id"), *_result("FAILED", final_failure(F.col("records")), F.col("diagnostic"), None))


def solve(problems: DataFrame, factory: Callable[[], Generator], config: SolveConfig = SolveConfig()) -> DataFrame:
    """The results of all ``turns`` as one table, a row per problem."""
    return reduce(DataFrame.unionByName, turns(problems, factory, config))


def empty_results(spark: SparkSession) -> DataFrame:
    """A table of results without rows."""
    return spark.createDataFrame([], RESULT)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The results at ``path``; a table without rows is made if there is none."""
    if not io.exists(spark, path):
        empty_results(spark).write.parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def solve_into(problems: DataFrame, factory: Callable[[], Generator], path: str, config: SolveConfig = SolveConfig()) -> None:
    """Solves those of ``problems`` that the table at ``path`` lacks and appends results as each turn decides them.

    A run that is killed leaves what its turns have decided; the next one solves the others only. Should it be killed in
    the middle of an append, files that have arrived hold whole results and count, others are not seen by readers.
    """
    rest = checkpointed(remaining(problems, stored(problems.sparkSession, path).select(F.col("problem_id").alias("id")), "id"))
    for decided in turns(rest, factory, config):
        decided.write.mode("append").parquet(path)


def resumed(problems: DataFrame, factory: Callable[[], Generator], path: str, config: SolveConfig = SolveConfig(), batches: int = 1) -> DataFrame:
    """Results of all ``problems``, kept in the table at ``path``: those that it has already are not solved again.

    The rest is solved in ``batches`` by a hash of the id, each with turns of its own, so that results are stored the
    sooner the more batches there are (``streaming.solving`` does the same for problems that arrive as files). Problems
    that the table has and ``problems`` lacks do not count.
    """
    for k in range(batches):
        solve_into(problems.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k) if batches > 1 else problems, factory, path, config)
    return stored(problems.sparkSession, path).join(problems.select(F.col("id").alias("problem_id")), "problem_id", "left_semi")
