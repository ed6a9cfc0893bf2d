"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

A window's fingerprint has ``BITS`` bits over its words, each weighed by its length. Two fingerprints within ``RADIUS`` of
each other agree in at least one of ``RADIUS + 1`` blocks, so joining equal blocks finds all of them. No radius covers all
windows at the threshold, least of all of short items, so windows that share one of an item's telling shingles are
candidates at any distance. Telling are the heaviest ones that together weigh more than a window may lack: one without
any of them is below the threshold, so nothing is lost. Candidates are verified exactly: the weighed share of an item's
five-word shingles that the window holds must reach ``THRESHOLD``. Everything is native; text never leaves the JVM.

Defined results: null and empty texts hold nothing; items without words match nothing; items of fewer than five words are
one shingle and match as a whole; rows that agree in ``doc_id`` and text are one document in the result; only ``doc_id``
and ``text`` are read, so other columns cannot clash; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdict.llm.common import SPACE, checkpointed, hinted, let
from verdict.llm.windows import SHINGLE, anchored_windows, containment, located, passages, shingles

BITS, RADIUS, THRESHOLD = 64, 11, 0.8


def simhash(array: Column) -> Column:
    """64 bits: the sign, bit by bit, of the sum of the words' hashes weighed by the words' lengths."""
    pairs = F.transform(array, lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).alias("n")))

    def bit(p: Column, k: Column) -> Column:
        total = F.aggregate(p, F.lit(0), lambda s, x: s + F.when(F.getbit(x["h"], k) == 1, x["n"]).otherwise(-x["n"]))
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    return let(pairs, lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(bit(p, k))))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """``radius + 1`` blocks of bits, each with its number, packed into one long each."""
    parts, n = [], radius + 1
    for k in range(n):
        low, high = BITS * k // n, BITS * (k + 1) // n
        value = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        parts.append(value * n + k)
    return F.array(*parts)


def telling(targets: DataFrame, threshold: float) -> DataFrame:
    """(key, target, size, shingle): hashes of each item's heaviest shingles, one at least of which a window at ``threshold`` holds."""
    each = targets.select("key", "words", "size", "target", F.explode(shingles(F.col("words"))).alias("text")).withColumn("weight", F.length("text"))
    item = Window.partitionBy("key", "words")
    ahead = F.sum("weight").over(item.orderBy(F.desc("weight"), "text").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("ahead", F.coalesce(ahead, F.lit(0))).withColumn("total", F.sum("weight").over(item))
    # What may be lacking, with room for rounding.
    return each.where(F.col("ahead") <= (1 - threshold) * F.col("total") + 1e-6).select("key", "target", "size", F.xxhash64("text").alias("shingle"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start): the documents that hold an item, with the word at which its window starts."""
    own = passages(items, key, text, SPACE)
    windows = anchored_windows(docs, own, SPACE)
    prints = checkpointed(windows.contents.select("content_id", "size", "window", simhash(F.col("window")).alias("print")))
    targets = checkpointed(own.select("key", "words", F.size("words").alias("size"), simhash(F.col("words")).alias("target")))
    by_block = prints.select("content_id", "size", "print", F.explode(blocks(F.col("print"), radius)).alias("block"))
    pairs = by_block.join(hinted(targets.select("key", "size", "target", F.explode(blocks(F.col("target"), radius)).alias("block"))), ["size", "block"])
    near = pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("target"))) <= radius).select("content_id", "key", "target")
    held = prints.select("content_id", "size", F.explode(shingles(F.col("window"))).alias("text")).select("content_id", "size", F.xxhash64("text").alias("shingle"))
    sharing = held.join(hinted(checkpointed(telling(targets, threshold))), ["size", "shingle"]).select("content_id", "key", "target")
    near = near.unionByName(sharing).distinct()
    near = near.join(hinted(targets.select("key", "target", "words")), ["key", "target"]).join(prints.select("content_id", "window"), "content_id")
    scored = near.select("content_id", "key", containment(F.col("window"), F.col("words"), SHINGLE).alias("similarity"))
    return located(windows, scored.where(F.col("similarity") >= threshold), "similarity").withColumnRenamed("key", key)
