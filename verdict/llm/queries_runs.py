"""op12: texts with planted periods, their runs and what is left without repeats. SQL can't tell runs over whole texts;
tests hold the query against a comparison of every text with itself at every distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.llm.common import let, table, words
from verdict.llm.runs import periodic_runs


def planted(doc_id: Column, text: Column) -> Column:
    """The text of every tenth id by crc32 repeats, from one of its words on, a period that the id and its length tell;
    all else is as it was. Texts without words, and rows without id, are left alone."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        def body(at: Column) -> Column:
            a, p = at["a"], F.lit(1) + F.floor((at["n"] - at["a"]) / (F.lit(3) + g % 8)).cast("long")
            return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))

        return F.when(F.size(w) > 0, let(F.struct(F.size(w).alias("n"), (g % F.size(w)).alias("a")), body)).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("longest", longest).select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(rows, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_runs": op12_runs}
ORACLES: dict[str, str] = {}
