import time

from pyspark.sql import functions as F

from verdict.llm.common import looked_up, sieve, sieved


def test_sieve_keeps_all_and_is_no_part_of_a_row(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("x"))
    marks = sieve(hashes)
    rows = spark.range(100_000).select("id", F.xxhash64("id").alias("x")).where(sieved(marks, F.col("x")))
    kept = {r.id for r in rows.select("id").collect()}
    assert set(range(5000)) <= kept and len(kept) < 5_500
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sieve(hashes.limit(0)) is not None and spark.range(9).where(sieved(sieve(hashes.limit(0)), F.col("id"))).count() == 0


def test_look_up_costs_little_beside_the_scan(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    wanted = docs.where("doc_id % 1000 = 7").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.lit("x").alias("mark"))
    found = looked_up(docs, wanted)

    def seconds(df) -> float:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    assert sorted(r.doc_id for r in found.collect()) == list(range(7, 40_000, 1000))
    bare = docs.select("doc_id", F.xxhash64("text"))
    assert min(seconds(found) for _ in range(3)) < 2 * min(seconds(bare) for _ in range(3)) + 0.5


def test_a_sieve_is_sent_once_a_stage(spark):
    """Each mention of a scalar subquery is a copy of its value in a stage's closure, which the driver holds and sends."""
    rows = spark.range(1000).withColumn("x", F.xxhash64("id"))
    kept = rows.where(sieved(sieve(rows.where("id < 100").select("x")), F.col("x")))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery#") == 1
    assert {r.id for r in kept.collect()} >= set(range(100)) and kept.count() < 120
