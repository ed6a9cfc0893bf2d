"""Mixing sources to target weights: hash order, distributed prefix sums, an exact cut at each source's budget.

Native DataFrame code only. Sizes are measured once and kept as slim rows; each source's hash range is dealt into
equal slices of about ``SLICE_ROWS`` rows, so a source that holds most of the corpus is spread over as many tasks as it has
slices. Tables with a row per source are ranked and summed in ranges as well, as sources may be many.

Defined results: a null text has size 0; a null source is one source, ordered last; rows that agree in ``doc_id``, text
and source are interchangeable, and each has a ``taken`` of its own; a source without words has target 0; an empty table
gives an empty result. Of the input only ``doc_id``, ``text`` and ``source`` are read. ``mixed`` keeps its other columns,
but for such as bear the name of one of its own measures, in any case, which give way to those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.llm.common import checkpointed, hinted, word_count

SEED = "mix-1"
#: A slice of a source's hash range holds about this many rows.
SLICE_ROWS = 2048
MEASURES = ("size", "source_size", "target", "taken")


def hash_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A hash-random key of 60 bits, the same in any engine that has md5. The text tells rows of one id, or of none, apart."""
    salt = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(salt.cast("binary")), 1, 15), 16, 10).cast("long")


def ahead(df: DataFrame, values: dict[str, Column], *order: Column) -> DataFrame:
    """Adds to each row the sums of ``values`` over all rows before it in ``order``: running sums within the ranges of a
    distributed sort, plus the sums of the ranges before, a row for each."""
    ranged = df.orderBy(*order).withColumn("__range", F.spark_partition_id()).withColumns({f"__{n}": v for n, v in values.items()})
    ranged = checkpointed(ranged)
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col("__range").alias("__r")).agg(*(F.sum(f"__{n}").alias(f"__s_{n}") for n in values))
    sums = sums.select("__r", *(F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in values))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({f"__i_{n}": F.sum(f"__{n}").over(inside) for n in values}).join(F.broadcast(sums), F.col("__range") == F.col("__r"))
    zero = F.lit(0)
    return found.select(*df.columns, *((F.coalesce(f"__b_{n}", zero) + F.coalesce(f"__i_{n}", zero)).alias(n) for n in values))


def targets(totals: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    The budget ``share * total`` is divided by weight; a source's target stops at ``cap`` times its size and the excess
    is shared again by weight. The fixed point of that is a common level: targets are ``min(weight * level, cap)``, and
    with the sources in ascending order of cap per weight the level follows from one prefix sum.
    """
    name = (F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1).cast("double")
    t = ahead(totals, {"place": F.lit(1)}, *name).withColumn("weight", weight).withColumn("ceiling", F.lit(float(cap)) * F.col("source_size"))
    t = t.drop("place").withColumn("step", F.col("ceiling") / F.col("weight"))
    t = ahead(t, {"spent": F.col("ceiling"), "weighed": F.col("weight")}, F.col("step"), *name)
    whole = t.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))  # one row
    t = t.crossJoin(F.broadcast(whole)).withColumn("level", (F.lit(float(share)) * F.col("all_words") - F.col("spent")) / (F.col("all_weight") - F.col("weighed")))
    fits = F.col("weight") * F.col("level") <= F.col("ceiling")
    found = t.agg(F.min(F.when(fits, F.struct("step", "level")))["level"].alias("at_level"))  # one row
    t = t.select("source", "source_size", "weight", "ceiling").crossJoin(F.broadcast(found))
    return t.select("source", "source_size", F.when(F.col("weight") * F.col("at_level") <= F.col("ceiling"), F.col("weight") * F.col("at_level")).otherwise(F.col("ceiling")).alias("target"))


def _measured(docs: DataFrame, seed: str, kept: list[Column]) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", "source", *kept, word_count(text).alias("size"), hash_key(F.col("doc_id"), text, seed).alias("h"))


def _taken(rows: DataFrame, plan: DataFrame, sums: DataFrame, kept: list[str]) -> DataFrame:
    """``taken`` counts whole epochs over the source plus the words of one more, partial epoch in hash order. That one is
    cut at the budget to the word, so each source's sum of ``taken`` is the whole part of its target."""
    rows = _sliced(rows, plan)
    inside = Window.partitionBy("source", "slice").orderBy("h", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(hinted(sums), F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("ahead") - F.col("within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.select("doc_id", "source", *kept, "size", "source_size", "target", taken.cast("long").alias("taken"))


def _sliced(rows: DataFrame, plan: DataFrame) -> DataFrame:
    # The table of sources has a row per source. It is broadcast when measured to be small, and else joined by shuffle,
    # where AQE splits the hot source.
    rows = rows.join(hinted(plan.withColumnRenamed("source", "p")), F.col("source").eqNullSafe(F.col("p"))).drop("p", "n")
    return rows.withColumn("slice", F.shiftright(F.shiftright("h", 28) * F.col("slices"), 32))


def _planned(slim: DataFrame, weights: Sequence[int], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, n, slices) per source, and (s, sl, ahead): the words before each slice of a source."""
    totals = checkpointed(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    plan = targets(totals.select("source", "source_size"), weights, share, cap)
    plan = plan.join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = checkpointed(plan.withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("long")))
    sums = _sliced(slim, plan).groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return plan, checkpointed(sums.select(F.col("source").alias("s"), F.col("slice").alias("sl"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead")))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    slim = checkpointed(_measured(docs, seed, []))
    return _taken(slim, *_planned(slim, weights, share, cap), [])


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """The documents of which the mix takes words, with their columns and the measures. Their texts are shuffled once, to
    the slices of their sources; nothing is joined back."""
    slim = checkpointed(_measured(docs, seed, []))
    plan, sums = _planned(slim, weights, share, cap)
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    rows = _measured(docs, seed, [F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row")])
    taken = _taken(rows, plan, sums, ["__row"]).where("taken > 0")
    return taken.select(*(F.col("__row")[c].alias(c) for c in kept), *MEASURES)
