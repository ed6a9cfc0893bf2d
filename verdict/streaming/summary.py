"""A running summary of a reward log: a stream of JSON files, kept up to date batch by batch.

Two streams, both native aggregations with keyed state in the state store, do it in turn. The first holds the figures of
each group of completions (one call, one problem), of the whole log and of each reason; a batch gives those that it
changes as they are now. The second reads the groups changed and holds which ones it has met and which of those varied: what
it has not met yet is counted. So a batch costs what it holds, whatever came before, and whether a group varies is exact,
however its rows are spread over batches. Everything a batch writes goes under its number: one that is repeated starts from
the same state and replaces itself, and groups that come again are not counted again.

Counts of reasons alone need no group: ``start_reasons`` adds what a batch holds to the counts stored for the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdict.sources import io
from verdict.sources.schema import REWARD_LOG

KEYS = ["kind", "reward_call", "problem_id", "reason"]
CHANGE = "kind string, reward_call long, problem_id string, reason string, n long, low double, high double, total double, fully_correct long"
MET = "figure string, count long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: From which spread on rewards vary, and from which reward on a completion is fully correct.
SPREAD, FULL = 1e-9, 0.999


def read(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(REWARD_LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def changed(log: DataFrame) -> DataFrame:
    """(of ``CHANGE``) figures of each group, of the whole log and of each reason."""
    none, text = F.lit(None), "string"
    key = lambda kind, call, problem, reason: F.struct(F.lit(kind).alias("kind"), call.cast("long").alias("reward_call"), problem.cast(text).alias("problem_id"), reason.cast(text).alias("reason"))
    reasons = F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: key("reason", none, none, r))
    keys = F.concat(F.array(key("group", F.col("reward_call"), F.col("problem_id"), none), key("whole", none, none, none)), reasons)
    rows = log.select(F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), F.explode(keys).alias("key")).select("key.*", "total")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("total").alias("low"), F.max("total").alias("high"), F.sum("total").alias("total"), F.sum((F.col("total") >= FULL).cast("long")).alias("fully_correct"))


def start(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Brings the summary at ``out`` up to date with all files there are, and ends: the first stream has ended when this
    returns the second."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # A commit stores what has changed; whole snapshots follow in the background.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(path)  # the state is advanced by this job alone
        now = batch.sparkSession.read.schema(CHANGE).parquet(path).where("kind <> 'group'")
        _store(now, f"{out}/summary", number, ["kind", "reason"])

    def count(batch: DataFrame, number: int) -> None:
        path = f"{out}/met/batch={number}"
        batch.groupBy("figure").count().write.mode("overwrite").parquet(path)
        now = batch.sparkSession.read.schema(MET).parquet(path)
        if io.exists(batch.sparkSession, f"{out}/groups/batch={number - 1}"):
            now = now.unionByName(batch.sparkSession.read.schema(MET).parquet(f"{out}/groups/batch={number - 1}")).groupBy("figure").agg(F.sum("count").alias("count"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{out}/groups/batch={number}")

    first = changed(log).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    first.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    groups = spark.readStream.schema(CHANGE).parquet(f"{out}/changes").where("kind = 'group'")
    figures = F.filter(F.array(F.lit("groups"), F.when(F.col("high") - F.col("low") > SPREAD, "varying_reward_groups")), lambda f: f.isNotNull())
    met = groups.select("reward_call", "problem_id", F.explode(figures).alias("figure")).dropDuplicates()
    second = met.writeStream.foreachBatch(count).option("checkpointLocation", f"{checkpoint}/met")
    return second.outputMode("append").trigger(availableNow=True).start()


def start_reasons(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Brings the counts of reasons alone at ``out``, a folder of their own, up to date with all files there are, and ends."""

    def write(batch: DataFrame, number: int) -> None:
        now = batch.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("reason").alias("kind"), "reason", "n")
        if io.exists(batch.sparkSession, f"{out}/summary/batch={number - 1}"):
            before = batch.sparkSession.read.schema(now.schema).parquet(f"{out}/summary/batch={number - 1}")
            now = now.unionByName(before).groupBy("kind", "reason").agg(F.sum("n").alias("n"))
        now.write.mode("overwrite").parquet(f"{out}/summary/batch={number}")

    given = log.select(F.explode("reasons").alias("reason"))
    return given.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _store(now: DataFrame, path: str, number: int, keys: list[str]) -> None:
    """Writes the rows of batch ``number``, and those of the batch before that it has not changed."""
    spark = now.sparkSession
    if io.exists(spark, f"{path}/batch={number - 1}"):
        before = spark.read.schema(now.schema).parquet(f"{path}/batch={number - 1}").alias("before")
        same = [F.col(f"before.{k}").eqNullSafe(F.col(f"now.{k}")) for k in keys]
        now = now.unionByName(before.join(now.alias("now"), same, "left_anti"))
    now.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")


def _last(spark: SparkSession, path: str) -> DataFrame:
    """The table of the last batch."""
    batches = spark.read.parquet(path)
    return batches.where(F.col("batch") == batches.agg(F.max("batch").alias("b")).first().b).drop("batch")


def merged(spark: SparkSession, out: str) -> DataFrame:
    """One row over all batches so far."""
    whole = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "whole", F.col(c))), F.lit(0)).alias(c)
    met = lambda f: F.coalesce(F.sum(F.when(F.col("figure") == f, F.col("count"))), F.lit(0)).alias(f)
    rows = _last(spark, f"{out}/summary").agg(whole("n"), whole("total"), whole("fully_correct"))
    rows = rows.crossJoin(_last(spark, f"{out}/groups").agg(met("groups"), met("varying_reward_groups")))
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return rows.select(F.col("n").alias("completions"), "groups", "varying_reward_groups", rate("total").alias("mean_reward"), rate("fully_correct").alias("fully_correct_rate"))


def merged_reasons(spark: SparkSession, out: str) -> DataFrame:
    """How often each reason was given, over all batches so far."""
    return _last(spark, f"{out}/summary").where("kind = 'reason'").select("reason", F.col("n").alias("count"))
