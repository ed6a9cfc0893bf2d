"""Deduplication of equivalent problems, deterministic splits and their fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.functions.text import canonical_key, casefold
from verdict.operators.digest import digest
from verdict.operators.seeded import seeded_ranks
from verdict.sources.schema import best_verified, case_count, has_all_groups


def validate_ratios(train: float, dev: float, test: float) -> None:
    if min(train, dev, test) < 0:
        raise ValueError("split ratios must not be negative")
    if abs(train + dev + test - 1) > 1e-9:
        raise ValueError("split ratios must sum to 1")


def keep_best(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row per key: the greatest by ``order``. A partial maximum precedes the shuffle, so hot keys stay small."""
    packed = df.select(key.alias("__k"), F.struct(*order).alias("__o"), F.struct(*df.columns).alias("__r"))
    return packed.groupBy("__k").agg(F.max_by("__r", "__o").alias("r")).select("r.*")


def deduplicate(problems: DataFrame, fold: Callable[[Column], Column] = casefold) -> DataFrame:
    """Of equivalent problems the one with all suites, then most cases, then the greatest id."""
    key = canonical_key(F.col("statement"), F.col("io_mode"), F.col("entry_point"), F.col("id"), fold)
    return keep_best(problems, F.sha2(key, 256), has_all_groups(F.col("tests")).cast("int"), case_count(F.col("tests")), F.col("id"))


def shuffle_key(ident: Column, seed: int) -> Column:
    """A reproducible random order of ids that does not depend on partitions."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256)


def ranked(df: DataFrame, order: list[Column], out: str = "rank", slices: int = 4096) -> DataFrame:
    """Adds the 0-based place of every row in hash order: ranks within slices of the hash range plus the slices' offsets.

    ``order`` starts with a hash in hex, whose first digits name the slice. No task holds more than a slice.
    """
    width = max(1, (slices - 1).bit_length() // 4)
    sliced = df.withColumn("__s", F.substring(order[0], 1, width))
    sizes = sliced.groupBy("__s").count()
    # One row per slice of a fixed number of slices, so a single task is enough for their running sum.
    ahead = sizes.select("__s", F.coalesce(F.sum("count").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy("__s").orderBy(*order)) - 1
    return sliced.withColumn("__within", within).join(F.broadcast(ahead), "__s").withColumn(out, (F.col("__within") + F.col("__ahead")).cast("long")).drop("__s", "__within", "__ahead")


def in_order(df: DataFrame, ident: str, seed: int, order: str, out: str) -> DataFrame:
    """Adds a place by the ``order`` named: "hash", or "seeded" for that of Python's generator over the sorted ids."""
    if order not in ("hash", "seeded"):
        raise ValueError(f"order must be 'hash' or 'seeded', not {order!r}")
    return seeded_ranks(df, ident, seed, out) if order == "seeded" else ranked(df, [shuffle_key(F.col(ident), seed), F.col(ident)], out)


def assign(df: DataFrame, ident: str = "id", train: float = 0.8, dev: float = 0.1, test: float = 0.1, seed: int = 42, order: str = "hash") -> DataFrame:
    """Adds ``split``. Bounds are floors of the ratios' shares; the remainder goes to test."""
    validate_ratios(train, dev, test)
    total = df.count()
    first = int(total * train)
    second = first + int(total * dev)
    placed = in_order(df, ident, seed, order, "__rank")
    return placed.withColumn("split", F.when(F.col("__rank") < first, "train").when(F.col("__rank") < second, "dev").otherwise("test")).drop("__rank")


def fingerprint(df: DataFrame, ident: str = "id") -> DataFrame:
    """One row with ``fingerprint``: sha256 over all ids in sorted order, one to a line."""
    value = F.col(ident).cast("string")
    return df.sparkSession.createDataFrame([(digest(df, value, value),)], "fingerprint string")


def split(problems: DataFrame, train: float = 0.8, dev: float = 0.1, test: float = 0.1, seed: int = 42, include_unverified: bool = False, allow_missing_groups: bool = False, order: str = "hash") -> DataFrame:
    """Verified, deduplicated problems with their split. Problems that lack a suite go to train only."""
    eligible = problems if include_unverified else problems.where(best_verified(F.col("oracle")) != "")
    eligible = deduplicate(eligible)
    complete = eligible if allow_missing_groups else eligible.where(has_all_groups(F.col("tests")))
    placed = assign(complete, "id", train, dev, test, seed, order)
    if not allow_missing_groups:
        placed = placed.unionByName(eligible.where(~has_all_groups(F.col("tests"))).withColumn("split", F.lit("train")))
    return placed


def counts(placed: DataFrame, ident: str = "id") -> DataFrame:
    """Rows and distinct ids per split, and how many ids stand in several splits."""
    per_id = placed.groupBy(ident).agg(F.countDistinct("split").alias("n"))
    overlap = per_id.agg(F.sum((F.col("n") > 1).cast("long")).alias("overlap"))
    return placed.groupBy("split").agg(F.count("*").alias("problems"), F.countDistinct(ident).alias("ids")).crossJoin(F.broadcast(overlap))


def write(placed: DataFrame, path: str, seed: int) -> None:
    """Problems in one folder per split, with a table of metadata beside them. Refuses an empty or overlapping split."""
    found = {r.split: r for r in counts(placed).collect()}  # one row per split
    if not found:
        raise ValueError("no eligible problems")
    if any(r.overlap for r in found.values()):
        raise ValueError("splits overlap")
    placed.write.mode("overwrite").partitionBy("split").parquet(f"{path}/problems")
    counted = placed.groupBy("split").agg(F.count("*").alias("problem_count"), F.sum((~has_all_groups(F.col("tests"))).cast("long")).alias("training_only_count"))
    prints = [fingerprint(placed.where(F.col("split") == name)).select(F.lit(name).alias("split"), F.col("fingerprint").alias("problem_id_fingerprint")) for name in sorted(found)]
    metadata = counted.join(reduce(DataFrame.unionByName, prints), "split")
    metadata.select(F.col("split").alias("role"), F.lit(seed).alias("seed"), "problem_count", "problem_id_fingerprint", "training_only_count").write.mode("overwrite").json(f"{path}/_metadata")
