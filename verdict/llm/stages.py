"""The operators as filters over a table of documents: every stage keeps the columns that it was given.

Columns of any name may come along: names that a stage needs in passing are made up so that they clash with none. Null ids,
sources and texts are values like others. Rows that agree in id and text are one document to the near-duplicate stage,
which keeps one of them; all other stages treat repeated rows alike and keep or drop each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm import line_dedup, quality
from verdict.llm.common import checkpointed
from verdict.llm.decontaminate import contaminated
from verdict.llm.jaccard import jaccard_components
from verdict.llm.mixing import mixed

__all__ = ["dedup_lines", "drop_contaminated", "keep_one_of_each", "keep_quality", "mixed"]


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def keep_quality(docs: DataFrame, reference: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that a classifier fitted on the labelled rows of ``reference`` accepts."""
    (score,) = _free(docs, "score")
    scored = quality.with_scores(docs, quality.fit(reference, labels), "text", score)
    return scored.where(F.col(score) >= threshold).select(*_columns(docs))


def dedup_lines(docs: DataFrame) -> DataFrame:
    return line_dedup.clean(docs)


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates: the one of least ``doc_id``, then of least hash of its text.

    Of rows that agree in both one is kept. Documents without words are groups of their own, by id and text.
    """
    found = jaccard_components(docs, size, percent)
    doc, kept_hash, own_hash = _free(docs, "kept_doc", "kept_hash", "own_hash")
    group = F.coalesce("root", F.concat(F.lit("-").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    kept = checkpointed(found.groupBy(group.alias("group")).agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias(doc), F.col("k.text_hash").alias(kept_hash)))
    joined = docs.withColumn(own_hash, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi")
    return joined.dropDuplicates(["doc_id", own_hash]).select(*_columns(docs))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item. Rows of one id go together."""
    (doc,) = _free(docs, "bad_doc")
    bad = checkpointed(contaminated(docs, benchmark).select(F.col("doc_id").alias(doc)).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")
