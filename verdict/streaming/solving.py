"""Solving problems that arrive as files, in micro-batches.

A batch is a few files. Its results are appended turn by turn; the stream's checkpoint is advanced when a batch is done. A
run that is killed in the middle of a batch gets the same batch again and solves what the results lack, so each problem is
solved and stored once. Files that arrive later are taken by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from verdict.operators.solve import Generator, SolveConfig, solve_into
from verdict.sources.schema import PROBLEM_FILE, coerced


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Problems as ``sources.io.save_problems`` writes them, ``files`` files to a batch."""
    return coerced(spark.readStream.schema(PROBLEM_FILE).option("maxFilesPerTrigger", files).json(path))


def start(problems: DataFrame, factory: Callable[[], Generator], results: str, checkpoint: str, config: SolveConfig = SolveConfig()) -> StreamingQuery:
    """Solves a stream of problems into the table at ``results`` and ends when all files there are have been taken."""

    def solved(batch: DataFrame, _: int) -> None:
        solve_into(batch, factory, results, config)

    return problems.writeStream.foreachBatch(solved).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
