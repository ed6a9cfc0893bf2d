"""Audits of training problems and records before training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions.json_text import canonical_json
from verdict.functions.python_code import has_syntax_warning, syntax_valid
from verdict.functions.text import BLANK, fenced_code, py_strip
from verdict.operators.digest import digest
from verdict.operators.order_stats import whole_stats
from verdict.operators.split import fingerprint
from verdict.sources.checkpoint import checkpointed
from verdict.sources.schema import best_verified


def duplicates(value: Column) -> Column:
    """How many values are repetitions of others; nulls and empty texts do not count."""
    return F.count(F.when(value != "", 1)) - F.countDistinct(F.when(value != "", value))


def total(flag: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(flag, F.lit(False)).cast("long")), F.lit(0))


def problems(df: DataFrame) -> DataFrame:
    """One row of figures over training problems."""
    code = py_strip(best_verified(F.col("oracle")))
    rows = df.withColumn("__code", code)
    rows = rows.withColumn("__valid", syntax_valid("__code")).withColumn("__warns", has_syntax_warning("__code"))
    modes = rows.groupBy("io_mode").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("io_mode", "count")))).alias("io_modes"))
    has_code = F.col("__code") != ""
    figures = rows.agg(
        F.count("*").alias("records"), total(has_code).alias("verified_records"), (F.count("*") - F.countDistinct("id")).alias("duplicate_ids"),
        *(total(F.size(f"tests.{n}_tests") == 0).alias(f"missing_{n}_tests") for n in ("visible", "reward", "eval")),
        total(has_code & ~F.col("__valid")).alias("invalid_oracle_syntax"), total(has_code & F.col("__warns")).alias("syntax_warning_records"),
        duplicates(py_strip(F.col("statement"))).alias("duplicate_statements"), duplicates(F.col("__code")).alias("duplicate_oracle_codes"),
    )
    return figures.crossJoin(fingerprint(df, "id")).crossJoin(modes)  # one row each


def parsed_records(lines: DataFrame) -> DataFrame:
    """(malformed, valid, instruction, input, output) per non-blank line of a text table with column ``value``."""
    lines = lines.where(F.regexp_replace("value", rf"{BLANK}+", "") != "")
    rows = lines.withColumn("v", F.try_parse_json("value")).withColumn("r", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}))
    fields = ("instruction", "input", "output")
    typed = [F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")) == "STRING" for f in fields]
    blank = [py_strip(F.coalesce(F.try_variant_get("v", f"$.{f}", "string"), F.lit(""))) != "" for f in fields]
    sound = F.lit(True)
    for c in [*typed, *blank]:
        sound = sound & F.coalesce(c, F.lit(False))
    return rows.select(F.col("v").isNull().alias("malformed"), sound.alias("valid"), *(F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in fields))


def dataset(lines: DataFrame) -> DataFrame:
    """One row of figures over lines of training records."""
    rows = parsed_records(lines).withColumn("code", F.when(F.col("valid"), fenced_code(F.col("output"))))
    rows = checkpointed(rows.withColumn("ok", syntax_valid("code")).withColumn("warns", has_syntax_warning("code")))
    good, block = F.col("valid"), F.col("code").isNotNull()
    figures = rows.agg(
        F.count("*").alias("records"), total(F.col("malformed")).alias("malformed_json_records"), total(~F.col("malformed") & ~good).alias("invalid_schema_records"),
        total(block).alias("valid_code_block_records"), total(block & F.col("ok")).alias("syntax_valid_records"), total(block & F.col("warns")).alias("syntax_warning_records"),
        duplicates(F.when(good, F.col("input"))).alias("duplicate_inputs"), duplicates(F.when(good, F.col("output"))).alias("duplicate_outputs"),
    )
    for name, value in (("input_chars", F.when(good, F.length("input"))), ("code_chars", F.length("code"))):
        figures = figures.crossJoin(whole_stats(rows, value).agg(F.struct(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("min", "median", "p95", "max"))).alias(name)))
    return figures.crossJoin(fingerprint(rows.where(good), "output"))  # one row each


#: The codes of what may be wrong with training data, by the figures of both audits (p and d) that tell it.
FAILURES = {
    "duplicate_problem_ids": "p.duplicate_ids > 0",
    "unverified_train_problems": "p.verified_records < p.records",
    "invalid_oracle_syntax": "p.invalid_oracle_syntax > 0",
    "malformed_sft_json": "d.malformed_json_records > 0",
    "invalid_sft_schema": "d.invalid_schema_records > 0",
    "invalid_code_block_format": "d.valid_code_block_records <> d.records",
    "invalid_sft_python_syntax": "d.syntax_valid_records <> d.records",
    "problem_dataset_count_mismatch": "d.records <> p.records",
}


def audited(train: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: the figures ``p`` of problems and ``d`` of lines of records, and the sorted codes of what is wrong."""
    both = problems(train).select(F.struct("*").alias("p")).crossJoin(dataset(lines).select(F.struct("*").alias("d")))  # one row each
    found = F.array(*(F.when(F.expr(wrong), F.lit(code)) for code, wrong in FAILURES.items()))
    return both.withColumn("failures", F.array_sort(F.array_distinct(F.filter(found, lambda c: c.isNotNull()))))


def training_data(spark: SparkSession, train: DataFrame, path: str, strict: bool = False) -> dict:
    """Both audits and the codes of what is wrong; ``strict`` raises if anything is."""
    row = audited(train, spark.read.text(path)).first()
    if strict and row.failures:
        raise ValueError("audit failed: " + ", ".join(row.failures))
    return {"problems": row.p.asDict(True), "dataset": row.d.asDict(True), "failures": row.failures}


def length_stats(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Least, median (whole), 95th percentile by index and greatest of whole numbers, per group of ``by``."""
    return whole_stats(df, value, *by)


def bundle(df: DataFrame) -> Column:
    """A row of problems as one value in the layout of problem files."""
    spec = [c for c in df.columns if c not in ("tests", "oracle")]
    return F.struct(F.struct(*spec).alias("problem"), "tests", "oracle")


def dataset_fingerprint(df: DataFrame, ident: str = "id", value: Column | None = None) -> DataFrame:
    """One row with ``fingerprint``: sha256 over the JSON list of all bundles in order of their ids, with sorted keys and
    without blanks. ``value`` is what a row contributes; without it, the row's bundle."""
    rows = df.select(F.col(ident).alias("id"), (bundle(df) if value is None else value).alias("value"))
    found = digest(rows, F.col("id").cast("string"), canonical_json(F.col("value"), rows.schema["value"].dataType), ",", "[", "]")
    return df.sparkSession.createDataFrame([(found,)], "fingerprint string")
