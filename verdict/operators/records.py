"""Prompts and training records as column templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.json_text import general_number
from verdict.functions.text import BLANK, code_hash, message_text, py_strip
from verdict.operators.seeded import seeded_ranks
from verdict.operators.split import shuffle_key
from verdict.sources.schema import best_verified

# Texts of the prompts and records.
CODE_OUTPUT_RULE = "Return exactly one Python code block and no explanation:\n```python\n# complete solution\n```"
INSTRUCTION = "Solve the algorithm problem in Python 3. Return exactly one complete python code block and no explanation."
CALLABLE_HINT = "Implement this function directly. Do not read stdin unless the statement requires it.\n"
REPAIR_HINT = "Identify the root cause internally, then return a corrected complete program. Do not hardcode the visible examples."
REVIEW_HINT = (
    "Hidden test inputs and outputs are withheld. Re-check the algorithm against the full statement, boundary cases, input/output handling, "
    "numeric limits, duplicate values, empty or singleton cases, and time complexity. Do not hardcode visible examples. Return a revised complete program only."
)
# The system message is a parameter of chat_prompts; this is its default.
SYSTEM_PROMPT = "You are a competitive programming code generator. Return exactly one complete Python 3 code block and no explanation. The program must follow the requested input/output contract and fit the resource limits."


def _right_strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANK}+\z", "")


def problem_prompt(samples: Column | None = None) -> Column:
    """The prompt of a row of problems. Only statement, formats, limits and the samples given here appear in it."""
    c = F.col
    limits = F.array_join(F.transform("constraints", lambda x: F.concat(F.lit("- "), x)), "\n")
    limits = F.when(F.size("constraints") > 0, limits).otherwise("- Not specified")
    mode = F.when((c("io_mode") == "callable") & (c("entry_point") != ""), F.concat(F.lit("Callable entry point: "), "entry_point", F.lit("\n" + CALLABLE_HINT))).otherwise("")
    shown = F.lit("")
    if samples is not None:
        blocks = F.transform(samples, lambda t: F.concat(F.lit("Input:\n"), _right_strip(t["stdin"]), F.lit("\nExpected output:\n"), _right_strip(t["expected_stdout"])))
        shown = F.when(F.size(samples) > 0, F.concat(F.lit("\n\nVisible samples:\n"), F.array_join(blocks, "\n\n"))).otherwise("")
    return F.concat(
        F.lit("Problem statement:\n"), "statement", F.lit("\n\nInput format:\n"), "input_format", F.lit("\n\nOutput format:\n"), "output_format",
        F.lit("\n\nConstraints:\n"), limits, F.lit("\n\nLanguage: Python 3\nTime limit: "), general_number(c("time_limit_sec")),
        F.lit(" seconds\nMemory limit: "), c("memory_limit_mb").cast("string"), F.lit(" MB\n"), mode, shown,
    )


def initial_prompt(prompt: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n" + CODE_OUTPUT_RULE))


def _with_candidate(prompt: Column, code: Column) -> list[Column]:
    return [prompt, F.lit("\n\nPrevious candidate:\n```python\n"), code, F.lit("\n```\n\n")]


def repair_prompt(prompt: Column, code: Column, failure: Column, turn: Column) -> Column:
    """Shows the failing visible case. ``failure`` is a failure summary that may reveal it."""
    parts = [x for label, f in (("Failure type: ", "kind"), ("\nFailed test: ", "test_id"), ("\nInput:\n", "stdin"), ("\nExpected:\n", "expected"), ("\nActual:\n", "actual"), ("\nStderr:\n", "stderr")) for x in (F.lit(label), failure[f])]
    return F.concat(*_with_candidate(prompt, code), F.lit("Execution feedback for repair turn "), turn.cast("string"), F.lit(":\n"), *parts, F.lit(f"\n\n{REPAIR_HINT}\n\n{CODE_OUTPUT_RULE}"))


def review_prompt(prompt: Column, code: Column, turn: Column) -> Column:
    """Tells that hidden cases failed and nothing about them; no hidden case is an argument."""
    return F.concat(*_with_candidate(prompt, code), F.lit("Internal verification failed after turn "), turn.cast("string"), F.lit(f". {REVIEW_HINT}\n\n{CODE_OUTPUT_RULE}"))


def fenced(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), code, F.lit("\n```"))


def require_train(metadata: dict, allow_other: bool = False) -> None:
    """Training data come from the train split only."""
    role = metadata.get("role")
    if role is not None and role != "train" and not allow_other:
        raise ValueError(f"training records need the train split, not {role!r}")


def sft(problems: DataFrame, limit: int = 0, metadata: dict | None = None, allow_other: bool = False) -> DataFrame:
    """(id, instruction, input, output) of verified problems. ``limit`` counts problems before the filter."""
    require_train(metadata or {}, allow_other)
    rows = problems.orderBy("id").limit(limit) if limit > 0 else problems
    code = py_strip(best_verified(F.col("oracle")))
    rows = rows.where(best_verified(F.col("oracle")) != "")
    return rows.select("id", F.lit(INSTRUCTION).alias("instruction"), problem_prompt(F.col("tests.visible_tests")).alias("input"), fenced(code).alias("output"))


def chat_prompts(problems: DataFrame, limit: int = 0, min_reward_tests: int = 5, seed: int = 42, metadata: dict | None = None, allow_other: bool = False, system: str = SYSTEM_PROMPT, order: str = "hash") -> DataFrame:
    """(problem_id, prompt) with a system and a user message, of verified problems with enough reward cases. ``limit`` counts
    them in shuffled order: by hash, or "seeded" by Python's generator."""
    require_train(metadata or {}, allow_other)
    rows = problems.where((best_verified(F.col("oracle")) != "") & (F.size("tests.reward_tests") >= min_reward_tests))
    if limit > 0:
        rows = seeded_ranks(rows, "id", seed, "__place").orderBy("__place").limit(limit) if order == "seeded" else rows.orderBy(shuffle_key(F.col("id"), seed), "id").limit(limit)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select(F.col("id").alias("problem_id"), F.array(message("system", F.lit(system)), message("user", initial_prompt(problem_prompt(F.col("tests.visible_tests"))))).alias("prompt"))


def bad_completion() -> Column:
    """A completion that is known to be wrong, for a row of problems."""
    call = F.concat(F.lit("def "), F.col("entry_point"), F.lit("(*args, **kwargs):\n    return None"))
    return fenced(F.when((F.col("io_mode") == "callable") & (F.col("entry_point") != ""), call).otherwise("print(0)"))


def reward_log_row(code: Column) -> list[Column]:
    return [F.length(code).alias("code_chars"), code_hash(code).alias("code_hash")]


__all__ = ["bad_completion", "chat_prompts", "fenced", "initial_prompt", "message_text", "problem_prompt", "repair_prompt", "require_train", "review_prompt", "reward_log_row", "sft"]
