"""Exact order statistics without gathering values: from counts of distinct values, in slices of the value range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.sources.checkpoint import checkpointed

#: The range of values is dealt into about as many slices; windows run within them.
SLICES = 256


def cumulated(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """(by, v, upto, n): each distinct value, how many values are at most as large, and how many there are, per group."""
    counts = checkpointed(df.select(*by, value.alias("v")).where("v IS NOT NULL").groupBy(*by, "v").count())
    bounds = counts.select(F.col("v").cast("double").alias("v")).approxQuantile("v", [k / SLICES for k in range(1, SLICES)], 0.25 / SLICES)
    cut = F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    sliced = counts.withColumn("slice", F.size(F.filter(cut, lambda b: b <= F.col("v"))))
    sizes = sliced.groupBy(*by, "slice").agg(F.sum("count").alias("c"))
    group = Window.partitionBy(*by)  # a row for each slice at most
    sizes = sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("slice").alias("__slice"), F.coalesce(F.sum("c").over(group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("c").over(group).alias("n"))
    inside = F.sum("count").over(Window.partitionBy(*by, "slice").orderBy("v"))
    same = F.col("slice") == F.col("__slice")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return sliced.withColumn("inside", inside).join(sizes, same).select(*by, "v", F.col("count"), (F.col("inside") + F.col("ahead")).alias("upto"), "n")


def at(index: Column) -> Column:
    """The value of a 0-based place in order, as an aggregate over ``cumulated``."""
    return F.min(F.when(F.col("upto") > index, F.col("v")))


def whole_stats(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """(by, records, min, median, p95, max) of whole numbers: the median is floored, the percentile taken by index."""
    n = F.col("n")
    picks = [F.min("v").alias("min"), at(F.floor((n - 1) / 2)).alias("low"), at(F.floor(n / 2)).alias("high"), at(F.floor(F.lit(0.95) * (n - 1))).alias("p95"), F.max("v").alias("max"), F.max("n").alias("records")]
    found = cumulated(df, value.cast("long"), *by).groupBy(*by).agg(*picks)
    return found.select(*by, "records", "min", F.floor((F.col("low") + F.col("high")) / 2).cast("long").alias("median"), "p95", "max")


def float_stats(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """(by, min, median, mean, max); without ``by`` one row, of zeros if there are no values."""
    n = F.col("n")
    rows = cumulated(df, value.cast("double"), *by)
    picks = [F.min("v"), (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, F.sum(F.col("v") * F.col("count")) / F.sum("count"), F.max("v")]
    return rows.groupBy(*by).agg(*(F.coalesce(p, F.lit(0.0)).alias(name) for p, name in zip(picks, ("min", "median", "mean", "max"))))
