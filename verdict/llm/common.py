"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from verdict.sources.checkpoint import checkpointed

__all__ = ["SPACE", "WORD", "checkpointed", "hinted", "let", "looked_up", "sieve", "sieved", "slices", "table", "word_count", "words"]

#: A word is a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, gap: str = SPACE) -> Column:
    """The words of a text between matches of ``gap``, as an array; empty for null or blank texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{gap}", "")
    found = F.split(trimmed, gap)
    # A gap at the end leaves one empty string there.
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, even where ``body`` uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A side of a join is hinted for broadcast up to this many bytes of values, measured before; beyond, joins shuffle.
BROADCAST_BYTES = 2_000_000


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes: texts and arrays by their contents, all else by eight bytes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType)), F.lit(16))
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 16
    return F.lit(8)


def hinted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values have been measured to take at most ``limit`` bytes."""
    total = df.agg(F.sum(sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0)).cast("long")).alias("n")).first().n
    return F.broadcast(df) if (total or 0) <= limit else df


#: Least and greatest size of a sieve, as powers of two of bits: 8 KB to 8 MB, whatever the size of the data.
SIEVE_BITS = 16, 26


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _spot(value: Column, words: Column) -> tuple[Column, Column]:
    """The word of a sieve for a 64-bit hash, by its low bits, and two bits of that word, by its high ones."""
    at = lambda k: F.shiftrightunsigned(value, k).cast("int").bitwiseAND(63)
    return F.pmod(value, words).cast("int"), _bit(at(58)).bitwiseOR(_bit(at(52)))


class Sieve(NamedTuple):
    """A scalar subquery of an array of 64-bit words, and their number."""

    marks: Column
    words: int


def sieve(hashes: DataFrame) -> Sieve:
    """64-bit words, one of which has two bits for every hash in the single column of ``hashes``, of some 64 bits a hash within
    ``SIEVE_BITS``, so that one in some five hundred others passes. They are a scalar subquery, computed once and no part of
    any row; ``sieved`` looks hashes up."""
    low, high = SIEVE_BITS
    count = 1 << (min(high, max(low, (64 * hashes.count()).bit_length())) - 6)
    word, bits = _spot(F.col(f"`{hashes.columns[0]}`"), F.lit(count).cast("long"))
    words = hashes.select(word.cast("long").alias("id"), bits.alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("word"))
    every = hashes.sparkSession.range(count).join(words, "id", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("w"))
    return Sieve(checkpointed(row.select(F.transform("w", lambda x: x["word"]).alias("marks"))).scalar(), count)


def sieved(marks: Sieve, value: Column) -> Column:
    """False only for hashes that lack a bit in ``marks``. Not within lambda functions, where subqueries can't stand. The words
    stand in it once: every mention of a subquery is a copy of its value in what the driver sends out for a stage."""
    word, bits = _spot(value, F.lit(marks.words).cast("long"))
    return F.element_at(marks.marks, word + 1).bitwiseAND(bits) == bits


def looked_up(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) whose id and hash of the text stand in ``wanted`` (d, h, ...), with its columns.

    Where ``wanted`` is too large to be broadcast, whole texts would be shuffled; a sieve keeps most others out of that.
    """
    marks = sieve(wanted.select(F.xxhash64("d", "h").alias("x")))
    rows = docs.withColumn("__h", F.xxhash64("text")).where(sieved(marks, F.xxhash64("doc_id", "__h")))
    return rows.join(hinted(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__h") == F.col("h"))).drop("__h", "d")


def slices(texts: Sequence, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` characters or bytes in all, one text at least."""
    start = 0
    while start < len(texts):
        stop, total = start, 0
        while stop < len(texts) and (stop == start or total + len(texts[stop] or "") <= limit):
            total += len(texts[stop] or "")
            stop += 1
        yield start, stop
        start = stop
