"""Readers and writers. Spark does all bulk reading and writing; only small sidecars pass through the driver."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.sources.schema import PROBLEM_FILE, RESULT, coerced


def problems(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A problem file or a folder of them, one problem to a file, or with ``lines`` one to a line as ``save_problems``
    writes them. Files that start with ``_`` are metadata and are not read."""
    return coerced(spark.read.schema(PROBLEM_FILE).json(path, multiLine=not lines))


def save_problems(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Problems as JSON lines in the layout of problem files, with nulls spelled out."""
    spec = [c for c in df.columns if c not in ("tests", "oracle")]
    df.select(F.struct(*spec).alias("problem"), "tests", "oracle").write.mode(mode).option("ignoreNullFields", "false").json(path)


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines. ``strict`` fails on a malformed line, ``tolerant`` drops it, ``counting`` keeps it in ``_corrupt_record``."""
    spark_mode = {"strict": "FAILFAST", "tolerant": "DROPMALFORMED", "counting": "PERMISSIVE"}[mode]
    schema = f"{schema}, _corrupt_record string" if mode == "counting" else schema
    return spark.read.schema(schema).json(path, mode=spark_mode)


def save_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


#: Where a record stands among several files: the file's place in the list given, its name, the part of it that was read
#: at once, and the record within that.
ORDER = "struct<path:int,file:string,start:long,position:long>"
_RESULTS = f"results array<struct<{RESULT.replace('problem_id string', 'problem_id:string').replace(' string', ':string').replace(' int,', ':int,').replace('attempt_records array', 'attempt_records:array')}>>"


def _placed(rows: DataFrame, place: int, position: Column, columns: list[str]) -> DataFrame:
    order = F.struct(F.lit(place).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), position.alias("position"))
    return rows.select(order.cast(ORDER).alias("order"), *columns)


def partial_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Results from files of JSON lines, with their ``order``: later paths come after earlier ones, then files by name,
    then lines as they stand. Malformed lines and lines without a problem are passed over."""
    names = [f.split(" ")[0] for f in RESULT.split(", ") if "<" not in f.split(" ")[0] and ":" not in f.split(" ")[0]]

    def one(place: int, path: str) -> DataFrame:
        rows = spark.read.schema(RESULT).json(path, mode="DROPMALFORMED")
        return _placed(rows, place, F.monotonically_increasing_id(), names).where(F.coalesce("problem_id", F.lit("")) != "")

    return reduce(DataFrame.unionByName, [one(k, p) for k, p in enumerate(paths)])


def report(spark: SparkSession, *paths: str) -> DataFrame:
    """The results of report files, with their position within a file and their ``order`` over all of them."""

    def one(place: int, path: str) -> DataFrame:
        raw = spark.read.schema(_RESULTS).json(path, multiLine=True)
        rows = raw.select("_metadata", F.posexplode("results").alias("position", "r"))
        return _placed(rows, place, F.col("position").cast("long"), ["position", "r"]).select("order", "position", "r.*")

    return reduce(DataFrame.unionByName, [one(k, p) for k, p in enumerate(paths)])


def non_blank_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.regexp_replace("value", r"(?U)[\s\x1c-\x1f]+", "") != "").count()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def sidecar(spark: SparkSession, path: str) -> dict:
    """A small JSON document beside a table, from any file system that Spark reads; empty if it is absent.

    It is read through the file system, since Spark's readers skip names that start with ``_``.
    """
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def save_sidecar(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()


def copy_sidecars(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the JSON documents whose names start with ``_`` from a folder to that of the next stage; their names."""
    fs, folder = _fs(spark, source)
    out, to = _fs(spark, target)
    out.mkdirs(to)
    names = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if status.isFile() and name.startswith("_") and name.endswith(".json"):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, status.getPath(), out, spark._jvm.org.apache.hadoop.fs.Path(to, name), False, True, spark._jsc.hadoopConfiguration())
            names.append(name)
    return sorted(names)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job has written for its own use."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def split_by_status(df: DataFrame, status: str, paths: dict[str, str]) -> None:
    """Rows of each status to a folder of its own."""
    for value, path in paths.items():
        save_jsonl(df.where(F.col(status) == value), path)
