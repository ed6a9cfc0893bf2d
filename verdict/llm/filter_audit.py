"""How filters interact: what each removes in every order of application, by a Walsh-Hadamard audit.

Every document has a mask with a bit per filter that it fails. Per part and label the masks enter as signed parity sums,
one for each subset S of the filters: the sum of (-1)^|S & mask| over the documents. These are plain sums, so they are
combined before the shuffle and a part that holds most documents is no hot key. The transform is its own inverse but for a
factor: the signed sums of the sums, divided by 2^filters, are the exact numbers of documents of each mask. All orders are
evaluated from those few cells. The Shapley value is closed-form: of all n! orders, a document that fails k filters is
removed by each of them in n!/k.

DataFrame code only. Texts are read once and never shuffled: repeats are found by 256-bit hashes of texts, with which only
the id and the mask go along; AQE splits a hash that a third of all rows may share.

Defined results: a null text is empty; a null source is the part of the empty string; rows that share an id are documents
of their own; a row without id repeats no smaller id and has no label; labels that are null count as 0, of several rows
for one id the largest holds; an empty table gives no rows. Of the input only ``doc_id``, ``text``, ``source`` and the
labels named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import SPACE, checkpointed, word_count

#: Stands for the condition that a smaller id has the same text, anywhere in the table.
REPEATED = "repeated"
Condition = Callable[[Column], Column]


def few_words(text: Column) -> Column:
    return word_count(text) < 200


def few_distinct(text: Column) -> Column:
    distinct = F.array_size(F.array_remove(F.array_distinct(F.split(text, SPACE)), ""))
    return 100 * distinct < 50 * word_count(text)


def many_capitals(text: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text)


def odd_signs(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Failure conditions by the letter of their filter.
FILTERS: dict[str, Condition | str] = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": odd_signs, "E": REPEATED}


def failures(docs: DataFrame, filters: Mapping[str, Condition | str] = FILTERS) -> DataFrame:
    """(doc_id, part, mask) per row of ``docs``: bit k of the mask is set if the k-th filter fails."""
    text, zero = F.coalesce("text", F.lit("")), F.lit(0)
    own = [F.when(condition(text), F.lit(1 << k)).otherwise(zero) for k, condition in enumerate(filters.values()) if condition != REPEATED]
    repeated = sum(1 << k for k, condition in enumerate(filters.values()) if condition == REPEATED)
    mask = sum(own, zero).alias("mask")
    slim = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash"), mask)
    if not repeated:
        return slim.select("doc_id", "part", "mask")
    slim = checkpointed(slim)
    # A table of its own, so that both sides of the join are plain shuffles, of which AQE splits the hot hash.
    least = checkpointed(slim.groupBy("hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("hash", "least"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return slim.join(least, "hash", "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, repeated).otherwise(zero)).alias("mask"))


def _sign(mask: Column, subset: Column) -> Column:
    """1 if ``mask`` and ``subset`` share an even number of bits, else -1."""
    return F.lit(1) - F.bit_count(mask.bitwiseAND(subset)).bitwiseAND(1) * 2


def cells(masked: DataFrame, n: int, groups: Mapping[str, Column]) -> DataFrame:
    """(part, and per group an array of the number of its documents of each mask) from signed parity sums."""
    subsets = range(1 << n)
    sums = [F.sum(_sign(F.col("mask"), F.lit(s)) * inside.cast("long")).alias(f"{name}_{s}") for name, inside in groups.items() for s in subsets]
    summed = masked.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{name}_{s}" for s in subsets)).alias(name) for name in groups))
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))

    def inverted(found: Column) -> Column:
        def cell(mask: Column) -> Column:
            total = F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.get(found, s) * _sign(mask, s))
            return F.shiftright(total, n)

        return F.transform(every, cell)

    return summed.select("part", *(inverted(F.col(name)).alias(name) for name in groups))


def orders(counted: DataFrame, letters: str, groups: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, with what the step keeps and removes; ``counted`` has ``cells``."""
    n = len(letters)
    every, zero = F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long")
    spread = counted.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(map("".join, permutations(letters)))), " ")))
    spread = spread.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def bit(step: Column) -> Column:
        place = F.instr(F.lit(letters), F.substring(F.col("filter_order"), step, F.lit(1)))
        return F.call_function("shiftleft", F.lit(1), place - 1)

    spread = spread.withColumn("own", bit(F.col("step")))
    spread = spread.withColumn("earlier", F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, k: F.when(k < F.col("step"), a + bit(k)).otherwise(a)))
    own, earlier = F.col("own"), F.col("earlier")

    def total(group: str, chosen: Callable[[Column], Column], times: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        return F.aggregate(every, zero, lambda a, m: F.when(chosen(m), a + F.get(F.col(group), m) * times(m)).otherwise(a))

    fails = lambda m: m.bitwiseAND(own) != 0
    removed = lambda m: fails(m) & (m.bitwiseAND(earlier) == 0)
    shares = F.array(*(F.lit(factorial(n) // max(1, k)) for k in range(n + 1)))
    return spread.select(
        "part", "filter_order", "step",
        total("all", lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: fails(m) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        total("all", lambda m: m == own).alias("unique_fails"),
        *(total(name, removed).alias(f"{name}_lost") for name in groups),
        total("all", fails, lambda m: F.get(shares, F.bit_count(m)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Condition | str] = FILTERS, marked: Mapping[str, str] | None = None) -> DataFrame:
    """The audit of ``filters`` (names of one letter) over ``docs`` (doc_id, text, source). ``marked`` names groups of
    documents by the column of ``labels`` that is 1 for them; ``<name>_lost`` counts those that a step removes."""
    marked = {"good": "quality", "toxic": "toxic"} if marked is None else marked
    named = [F.coalesce(F.max(F.when(F.col(f"`{column}`") == 1, 1).otherwise(0)), F.lit(0)).alias(f"is_{name}") for name, column in marked.items()]
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.lit(True).alias("known"), *named)
    rows = failures(docs, filters).join(known, F.col("doc_id") == F.col("labelled"), "left")
    groups = {"all": F.lit(1)} | {name: F.coalesce(f"is_{name}", F.lit(0)) for name in marked}
    return orders(cells(rows, len(filters), groups), "".join(filters), list(marked))
