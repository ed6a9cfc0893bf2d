"""Windows of documents that may hold one of a small set of passages, as native DataFrame code.

``anchored_windows`` lists, for every document, each window of a passage's size in which at least one shingle stands where
the passage has it. A window that shares no shingle with a passage has similarity 0 to it, so nothing is lost by looking
at these only. Equal windows are one row of ``contents``, however many documents hold them, so copies are judged once.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpointed, hinted, let, looked_up, sieve, sieved, words

#: Words of a shingle; passages with fewer words are one shingle.
SHINGLE = 5


def shingles(array: Column, size: int = SHINGLE) -> Column:
    """The distinct shingles of an array of words, as strings; the whole array if it is shorter."""

    def cut(a: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - size + 1, F.lit(1))), lambda k: F.array_join(F.slice(a, k, size), " "))
        return F.when(F.size(a) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return let(array, cut)


def word_hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, size: int) -> Column:
    """The hash of the shingle at every position, from the hashes of the words; empty if they are fewer than a shingle."""

    def cut(a: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - size + 1, F.lit(1))), lambda k: F.xxhash64(F.slice(a, k, size)))
        return F.when(F.size(a) < size, F.array().cast("array<bigint>")).otherwise(many)

    return let(hashes, cut)


class Windows(NamedTuple):
    places: DataFrame  # doc_id, text_hash, start, content_id
    contents: DataFrame  # content_id, size (of the passage, which a window at a text's end may fall short of), window


def passages(items: DataFrame, key: str, text: str, gap: str) -> DataFrame:
    """(key, words) of the items that have words, one row per key and text."""
    rows = items.select(F.col(key).alias("key"), words(F.lower(F.col(text)), gap).alias("words"))
    return checkpointed(rows.where(F.size("words") > 0).distinct())


def anchored_windows(docs: DataFrame, items: DataFrame, gap: str, shingle: int = SHINGLE) -> Windows:
    """``items`` is the result of ``passages``; of ``docs`` only ``doc_id`` and ``text`` are read."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = items.withColumn("n", F.least(F.size("words"), F.lit(shingle)))
    sizes = sorted(r.n for r in items.select("n").distinct().collect())  # at most as many as a shingle has words
    own = [items.where(F.col("n") == n).select("n", F.size("words").alias("size"), F.posexplode(shingle_hashes(word_hashes(F.col("words")), n)).alias("shift", "hash")) for n in sizes]
    none = items.where(F.lit(False)).select("n", F.size("words").alias("size"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("hash"))
    anchors = checkpointed(reduce(DataFrame.unionByName, own, none).distinct())
    # A document's shingles are hashed in place, and only those that have a bit among the anchors' go on.
    marks = sieve(anchors.select("hash"))
    kinds = lambda w: F.array(*(F.struct(F.lit(n).alias("n"), shingle_hashes(w, n).alias("hashes")) for n in sizes or [shingle]))
    spread = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(let(word_hashes(words(F.lower("text"), gap)), kinds)))
    told = spread.select("doc_id", "text_hash", "n", F.posexplode("hashes").alias("at", "hash")).where(sieved(marks, F.col("hash")))
    hits = told.join(hinted(anchors), ["n", "hash"])
    hits = hits.select("doc_id", "text_hash", F.greatest(F.col("at") - F.col("shift"), F.lit(0)).alias("start"), "size")
    spans = checkpointed(hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("start", "size")).alias("spans")))
    cut = looked_up(docs, spans)
    cut = cut.select("doc_id", F.col("h").alias("text_hash"), words(F.lower("text"), gap).alias("words"), "spans")
    cut = cut.select("doc_id", "text_hash", let(F.col("words"), lambda w: F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.slice(w, s["start"] + 1, s["size"]).alias("window")))).alias("cut"))
    cut = cut.select("doc_id", "text_hash", F.explode("cut").alias("c")).select("doc_id", "text_hash", "c.start", "c.size", "c.window")
    placed = checkpointed(cut.withColumn("content_id", F.sha2(F.concat_ws(" ", F.col("size").cast("string"), F.array_join("window", " ")), 256)))
    contents = checkpointed(placed.groupBy("content_id").agg(F.first("size").alias("size"), F.first("window").alias("window")))
    return Windows(placed.select("doc_id", "text_hash", "start", "content_id"), contents)


def containment(window: Column, passage: Column, size: int = SHINGLE) -> Column:
    """The share of the passage's distinct shingles that the window holds, each weighed by its characters."""

    def weight(found: Column) -> Column:
        return F.aggregate(found, F.lit(0), lambda total, s: total + F.length(s))

    return let(shingles(passage, size), lambda own: weight(F.array_intersect(own, shingles(window, size))) / weight(own))


def located(windows: Windows, matched: DataFrame, similarity: str) -> DataFrame:
    """(doc_id, key, similarity, start): the best window of each document for each passage, the first of equals.

    ``matched`` has content_id, key and the similarity.
    """
    rows = windows.places.join(matched, "content_id").select("doc_id", "key", F.struct(F.col(similarity).alias("s"), (-F.col("start")).alias("p")).alias("best"))
    best = rows.groupBy("doc_id", "key").agg(F.max("best").alias("best"))
    return best.select("doc_id", "key", F.round("best.s", 6).alias(similarity), (-F.col("best.p")).cast("long").alias("start"))
