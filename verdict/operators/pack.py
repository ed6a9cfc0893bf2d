"""Token packing for supervised training, with the tokenizer as a parameter."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.python_code import has_syntax_warning
from verdict.functions.text import extract_python_code

MASK = -100


def pack(prompt: Column, completion: Column, max_length: int) -> Column:
    """(input_ids, attention_mask, labels): a long prompt keeps its first three quarters of what fits, and its end.

    Null where the completion is empty or leaves no room for a prompt. Prompt tokens are masked in the labels.
    """
    room = F.lit(max_length) - F.size(completion)
    head = F.greatest(F.lit(1), F.floor(room * F.lit(0.75)).cast("int"))
    tail = room - head
    cut = F.concat(F.slice(prompt, 1, head), F.when(tail > 0, F.slice(prompt, F.size(prompt) - tail + 1, F.greatest(tail, F.lit(0)))).otherwise(F.array().cast("array<int>")))
    kept = F.when(F.size(prompt) > room, cut).otherwise(prompt)
    ids = F.concat(kept, completion)
    packed = F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), F.concat(F.transform(kept, lambda _: F.lit(MASK)), completion).alias("labels"))
    return F.when((F.size(completion) > 0) & (F.size(completion) < max_length), packed)


def within_chars(value: Column, limit: int) -> Column:
    return F.lit(limit <= 0) | (F.length(F.coalesce(value, F.lit(""))) <= limit)


def tokenized(df: DataFrame, texts: dict[str, Column], factory: Callable[[], Callable[[str], list[int]]]) -> DataFrame:
    """Adds token ids of the texts. ``factory`` makes a tokenizer in each worker."""
    def encode(batches):
        encoder = factory()
        for batch in batches:
            yield pa.array([encoder(t or "") for t in batch.to_pylist()], pa.list_(pa.int32()))

    from collections.abc import Iterator

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(encode, "array<int>")
    for name, text in texts.items():
        df = df.withColumn(name, udf(text))
    return df


def flagged(records: DataFrame, factory: Callable[[], Callable[[str], list[int]]], eos: int | None, template: Callable[[Column, Column], Column], max_length: int = 4096, min_prompt: int = 512, max_prompt_chars: int = 100_000, max_completion_chars: int = 50_000) -> DataFrame:
    """Records with tokens and the first filter that each fails (null: kept), cheapest filters first."""
    if not 0 < min_prompt < max_length:
        raise ValueError("the prompt's least share must lie below the sequence's length")
    code = extract_python_code(F.col("output"))
    rows = records.withColumn("dropped", F.when((code != "") & has_syntax_warning(code), "syntax_warning"))
    long = ~(within_chars(F.col("input"), max_prompt_chars) & within_chars(F.col("output"), max_completion_chars))
    rows = rows.withColumn("dropped", F.coalesce("dropped", F.when(long, "character_outlier")))
    # Only rows that are left are tokenized: others are null to the tokenizer.
    alive = lambda c: F.when(F.col("dropped").isNull(), c)
    rows = tokenized(rows, {"prompt_ids": alive(template(F.col("instruction"), F.col("input"))), "completion_ids": alive(F.col("output"))}, factory)
    if eos is not None:
        rows = rows.withColumn("completion_ids", F.concat("completion_ids", F.array(F.lit(eos))))
    return rows.withColumn("dropped", F.coalesce("dropped", F.when(F.size("completion_ids") > max_length - min_prompt, "overlong_target")))


def preflight(rows: DataFrame) -> DataFrame:
    """One row: records in, kept, and dropped by each filter."""
    return rows.agg(F.count("*").alias("input_records"), F.sum(F.col("dropped").isNull().cast("long")).alias("training_records"), *(F.sum(F.coalesce(F.col("dropped") == k, F.lit(False)).cast("long")).alias(f"dropped_{k}s") for k in ("syntax_warning", "character_outlier", "overlong_target")))


def run(rows: DataFrame, max_length: int = 4096) -> DataFrame:
    return rows.where("dropped IS NULL").select(pack(F.col("prompt_ids"), F.col("completion_ids"), max_length).alias("p")).select("p.*")
