"""Running untrusted programs against their cases, as a distributed operator.

What runs is a table of its own: a row per program, input and limits that differ, whatever the number of rows, suites and
cases that ask for it. So candidates that say the same run once, and a program's cases run side by side. Runs are dealt
over tasks by their time limits: each falls into a bucket by its hash, and buckets are dealt to tasks, the longest first to
the task that has least, so that no task may take much longer than others. Each task runs its programs in a ``Sandbox``.
Outcomes are checkpointed, as running code is not repeatable, and joined to what asked for them; verdicts and reports are
columns. A program that does not compile is not run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions.python_code import compile_error, syntax_error
from verdict.functions.text import normalize_output
from verdict.operators.sandbox import Sandbox
from verdict.sources.checkpoint import checkpointed
from verdict.sources.schema import REPORT, RUN


@dataclass(frozen=True)
class ExecConfig:
    max_output_bytes: int = 1_000_000
    memory_limit: bool = False  # enforce a problem's memory_limit_mb
    tasks: int | None = None  # tasks to spread the runs over; None or 0: two per core of the cluster

    def partitions(self, spark: SparkSession) -> int:
        return self.tasks or 2 * spark.sparkContext.defaultParallelism


#: Seconds of a problem without a time limit.
DEFAULT_SECONDS = 2.0
#: Buckets per task: their sums are what the driver sees of the runs.
BUCKETS = 16
OUTCOME = "run binary, stdout string, stderr string, returncode int, timed_out boolean, over boolean"


def dealt(runs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``runs`` (run, seconds, ...) with ``task``, and how many tasks there are: ``most``, but no more than runs, as starting
    an interpreter takes as long as some twenty runs do. Tasks have equal shares of the seconds, as far as runs allow."""
    count = BUCKETS * most
    bucketed = runs.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(count)).cast("int"))
    sums = bucketed.groupBy("bucket").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("runs")).collect()  # a row per bucket at most
    tasks = max(1, min(most, sum(r.runs for r in sums)))
    place, load = [0] * count, [(0.0, k) for k in range(tasks)]
    for row in sorted(sums, key=lambda r: (-r.seconds, r.bucket)):
        held, task = heapq.heappop(load)
        place[row.bucket] = task
        heapq.heappush(load, (held + row.seconds, task))
    return bucketed.withColumn("task", F.get(F.array(*map(F.lit, place)), F.col("bucket"))).drop("bucket"), tasks


def outcomes(runs: DataFrame, config: ExecConfig) -> DataFrame:
    """(of ``OUTCOME``) what each of ``runs`` (run, code, entry, stdin, seconds, memory) gives."""
    cap = config.max_output_bytes
    placed, tasks = dealt(runs, config.partitions(runs.sparkSession))
    shares = placed.repartitionById(tasks, F.col("task")).sortWithinPartitions("entry", "code")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "stdout", "stderr", "returncode", "timed_out", "over"]
        kinds = [pa.binary(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
        with Sandbox(cap) as sandbox:
            for batch in batches:
                for row in batch.to_pylist():
                    sandbox.load(row["code"], row["entry"])
                    done = sandbox.run(row["stdin"].encode("utf-8", "surrogatepass"), row["seconds"], row["memory"])
                    values = [row["run"], done.stdout.decode("utf-8", "replace"), done.stderr.decode("utf-8", "replace"), done.status, done.status is None, done.truncated]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return checkpointed(shares.select("run", "code", "entry", "stdin", "seconds", "memory").mapInArrow(work, OUTCOME))


def run_suites(df: DataFrame, suites: dict[str, tuple[Column, Column, str]], time_limit: Column, entry_point: Column, memory_mb: Column | None = None, config: ExecConfig = ExecConfig()) -> DataFrame:
    """Adds a report per suite: ``name -> (code, cases, suite label)``; null code gives a null report.

    The result is stable: programs have run, once each, when this returns.
    """
    names = list(suites)
    given = [F.struct(code.alias("code"), F.coalesce(tests, F.array()).alias("tests")).alias(f"s{k}") for k, (code, tests, _) in enumerate(suites.values())]
    memory = memory_mb.cast("int") if config.memory_limit and memory_mb is not None else F.lit(None).cast("int")
    seconds = F.coalesce(time_limit.cast("double"), F.lit(DEFAULT_SECONDS))
    base = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("kept"), seconds.alias("seconds"), F.coalesce(entry_point, F.lit("")).alias("entry"), memory.alias("memory"), *given)
    base = checkpointed(base.select("*", *(F.when(F.col(f"s{k}.code").isNotNull(), syntax_error(F.col(f"s{k}.code"))).alias(f"e{k}") for k in range(len(names)))))

    def cases(k: int) -> DataFrame:
        rows = base.where(F.col(f"s{k}.code").isNotNull() & F.col(f"e{k}").isNull())
        case = rows.select("row", F.lit(k).alias("suite"), F.col(f"s{k}.code").alias("code"), "entry", "memory", "seconds", F.posexplode(f"s{k}.tests").alias("place", "case"))
        limit = F.when(F.coalesce(F.col("case.timeout_sec"), F.lit(0.0)) > 0, F.col("case.timeout_sec")).otherwise(F.col("seconds"))
        return case.withColumn("seconds", limit).withColumn("stdin", F.coalesce("case.stdin", F.lit("")))

    asked = reduce(DataFrame.unionByName, map(cases, range(len(names))))
    wanted = [F.col(c) for c in ("code", "entry", "memory", "seconds", "stdin")]
    asked = asked.withColumn("run", F.unhex(F.sha2(F.to_json(F.struct(*wanted)), 256)))
    runs = asked.groupBy("run").agg(*(F.first(c).alias(name) for c, name in zip(wanted, ("code", "entry", "memory", "seconds", "stdin"))))
    done = outcomes(checkpointed(runs), config)

    labels = F.array(*(F.lit(label) for _, _, label in suites.values()))
    actual, expected = normalize_output(F.col("stdout")), normalize_output(F.col("case.expected_stdout"))
    told = F.struct(
        F.coalesce("case.id", F.lit("")).alias("test_id"), F.get(labels, F.col("suite")).alias("suite"), (F.col("returncode").eqNullSafe(0) & (actual == expected) & ~F.col("over")).alias("passed"), F.col("stdin"),
        expected.alias("expected"), actual.alias("actual"), normalize_output(F.col("stderr")).alias("stderr"), "returncode", "timed_out", (F.col("over") & ~F.col("timed_out")).alias("output_truncated"),
    )
    runs_of = asked.select("row", "suite", "place", "case", "stdin", "run").join(done, "run").select("row", "suite", F.struct("place", told.cast(RUN).alias("r")).alias("x"))
    listed = [F.transform(F.array_sort(F.collect_list(F.when(F.col("suite") == k, F.col("x")))), lambda x: x["r"]).alias(f"r{k}") for k in range(len(names))]
    joined = base.join(runs_of.groupBy("row").agg(*listed), "row", "left")
    reports = []
    for k, name in enumerate(names):
        report = F.struct(F.col(f"e{k}").isNull().alias("syntax_valid"), F.coalesce(f"e{k}", F.lit("")).alias("syntax_error"), F.coalesce(f"r{k}", F.array().cast(f"array<{RUN}>")).alias("runs"))
        reports.append(F.when(F.col(f"s{k}.code").isNotNull(), report.cast(REPORT)).alias(name))
    return joined.select("kept.*", *reports)


def normalized(raw: bytes | str | None) -> str:
    text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw or ""
    return "\n".join(line.strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip("\n")


def evaluate(code: str, tests: list[dict], seconds: float, suite: str, entry_point: str = "", config: ExecConfig = ExecConfig(), memory_mb: int | None = None) -> dict:
    """A report on one program, run here against every case, in order."""
    error = compile_error(code)
    runs = []
    with Sandbox(config.max_output_bytes) as sandbox:
        for case in tests if error is None else []:
            sandbox.load(code, entry_point)
            stdin, expected = case.get("stdin") or "", normalized(case.get("expected_stdout"))
            done = sandbox.run(stdin.encode("utf-8", "surrogatepass"), case.get("timeout_sec") or seconds, memory_mb if config.memory_limit else None)
            actual, slow = normalized(done.stdout), done.status is None
            runs.append({"test_id": case.get("id") or "", "suite": suite, "passed": done.status == 0 and actual == expected and not done.truncated, "stdin": stdin, "expected": expected, "actual": actual, "stderr": normalized(done.stderr), "returncode": done.status, "timed_out": slow, "output_truncated": done.truncated and not slow})
    return {"syntax_valid": error is None, "syntax_error": error or "", "runs": runs}
