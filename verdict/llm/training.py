"""A bounded, deterministic sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most about this many labelled documents, and characters of text, are brought to the driver to fit a classifier.
MAX_ROWS, MAX_CHARS = 4_000, 24_000_000
#: What a row counts beside its characters.
ROW_CHARS = 32


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled(labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, label) of the training part, one row per id, thinned by a hash of the id to about ``max_rows``.

    Rows that are held out, or that lack an id or a label, do not count; of several labels for one id the largest holds.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = max(1, rows.count())
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / n)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """(text, label) of the sampled rows in order of their ids. Texts are whole. Ids are taken in order of a hash until the
    next would exceed ``max_chars`` in all, so long and short documents have the same chance and the driver's memory is
    bounded; an id whose texts exceed it by themselves is passed over."""
    sample = labelled(labels, label, max_rows)
    # The sample is bounded by max_rows, so it may be broadcast at any size of the corpus.
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").withColumn("order", F.xxhash64("doc_id", F.lit("order")))
    # A row counts ROW_CHARS at least, so that rows without text are bounded too.
    chars = F.sum(F.length("text") + ROW_CHARS)
    sizes = picked.groupBy("doc_id", "order").agg(chars.alias("n")).where(F.col("n") <= max_chars).collect()  # a row per sampled id
    total, allowed = 0, []
    for row in sorted(sizes, key=lambda r: (r.order, r.doc_id)):
        total += row.n
        if total > max_chars:
            break
        allowed.append((row.doc_id,))
    if not allowed:
        return []
    # Rows of allowed ids alone come to the driver, so their characters are bounded before they are collected.
    ids = docs.sparkSession.createDataFrame(allowed, picked.select("doc_id").schema)
    rows = picked.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "label").collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]
