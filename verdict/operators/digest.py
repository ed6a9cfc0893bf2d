"""SHA-256 over all values of a table in order, as one hash.

A hash of a sequence can't be combined from parts, so its state is handed on: values are sorted into ranges, and a job per
range reads that range as a stream, in one task, and returns the state for the next. Memory is bounded by a block of rows,
a lost executor costs one range, and the result is that of hashing all values at once, whatever the partitions.
"""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.sources import io
from verdict.sources.checkpoint import shared_folder

#: Bytes of values in a range, about.
RANGE_BYTES = 64_000_000


class _Context(ctypes.Structure):
    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint8 * 64), ("held", ctypes.c_uint), ("size", ctypes.c_uint)]


@cache
def _library():
    for name in ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.so", "libcrypto.dylib"):
        try:
            return ctypes.CDLL(name)
        except OSError:
            continue
    return None


@cache
def _constants() -> tuple[list[int], list[int]]:
    """The first 32 bits of the fractions of cube and square roots of the first primes."""
    primes = list(islice((n for n in count(2) if all(n % d for d in range(2, int(n**0.5) + 1))), 64))

    def root(n: int, k: int) -> int:
        low, high = 0, 1 << 40
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if middle**k <= n << 32 * k else (low, middle)
        return low & 0xFFFFFFFF

    return [root(p, 3) for p in primes], [root(p, 2) for p in primes[:8]]


def _compressed(h: list[int], block: bytes) -> list[int]:
    """One step of FIPS 180-4, for machines without the library."""
    turn = lambda x, n: (x >> n | x << 32 - n) & 0xFFFFFFFF
    w = list(struct.unpack(">16I", block))
    for t in range(16, 64):
        s0 = turn(w[t - 15], 7) ^ turn(w[t - 15], 18) ^ w[t - 15] >> 3
        s1 = turn(w[t - 2], 17) ^ turn(w[t - 2], 19) ^ w[t - 2] >> 10
        w.append(w[t - 16] + s0 + w[t - 7] + s1 & 0xFFFFFFFF)
    a, b, c, d, e, f, g, z = h
    for k, x in zip(_constants()[0], w):
        t1 = z + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & g) + k + x
        t2 = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, z = t1 + t2 & 0xFFFFFFFF, a, b, c, d + t1 & 0xFFFFFFFF, e, f, g
    return [x + y & 0xFFFFFFFF for x, y in zip(h, (a, b, c, d, e, f, g, z))]


class Sha256:
    """SHA-256 whose state is bytes: eight words, the unfinished block and the length so far."""

    def __init__(self, state: bytes | None = None) -> None:
        state = struct.pack(">8IQ", *_constants()[1], 0) if state is None else state
        *self.h, self.length = struct.unpack(">8IQ", state[:40])
        self.rest = state[40:]

    def state(self) -> bytes:
        return struct.pack(">8IQ", *self.h, self.length) + self.rest

    def update(self, data: bytes) -> None:
        self.length += len(data)
        data = self.rest + data
        whole = len(data) & ~63
        self.rest = data[whole:]
        if whole and (library := _library()):
            context = _Context(h=(ctypes.c_uint32 * 8)(*self.h), size=32)
            library.SHA256_Update(ctypes.byref(context), data[:whole], ctypes.c_size_t(whole))
            self.h = list(context.h)
        else:
            for at in range(0, whole, 64):
                self.h = _compressed(self.h, data[at : at + 64])

    def hexdigest(self) -> str:
        end = Sha256(self.state())
        end.update(b"\x80" + bytes((55 - self.length) % 64) + struct.pack(">Q", 8 * self.length))
        return struct.pack(">8I", *end.h).hex()


def digest(df: DataFrame, order: Column, value: Column, between: str = "\n", before: str = "", after: str = "", range_bytes: int = RANGE_BYTES) -> str:
    """sha256 of ``before``, all texts ``value`` in order of ``order`` (then of the texts) with ``between``, and ``after``.
    Rows whose order or text is null do not count; equal rows all do."""
    rows = df.select(order.alias("o"), value.cast("string").alias("v")).where("o IS NOT NULL AND v IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("v").cast("long")), F.lit(0)).alias("n")).first().n
    ranges = -(-total // range_bytes) or 1
    spark, hasher = df.sparkSession, Sha256()
    hasher.update(before.encode())
    folder = None
    if ranges == 1:
        parts = [rows.repartition(1).sortWithinPartitions("o", "v")]
    else:
        # Written once, sorted, a folder for each range, so that each job reads its own and none is sorted twice over.
        folder = f"{shared_folder(spark)}/digest-{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(ranges, "o", "v").withColumn("range", F.spark_partition_id())
        ranged.write.partitionBy("range").parquet(folder)
        written = spark.read.parquet(folder)
        parts = [written.where(F.col("range") == k).select("o", "v").repartition(1).sortWithinPartitions("o", "v") for k in range(ranges)]
    started = False
    for part in parts:
        state, glue = hasher.state(), between.encode()

        def run(batches: Iterator[pa.RecordBatch], state: bytes = state, started: bool = started) -> Iterator[pa.RecordBatch]:
            own = Sha256(state)
            for batch in batches:
                if batch.num_rows:
                    own.update((glue if started else b"") + glue.join(v.encode() for v in batch.column(0).to_pylist()))
                    started = True
            yield pa.RecordBatch.from_arrays([pa.array([own.state()], pa.binary()), pa.array([started])], ["state", "started"])

        found = part.select("v").mapInArrow(run, "state binary, started boolean").collect()  # one row of some hundred bytes
        if found:
            hasher, started = Sha256(bytes(found[0].state)), found[0].started
    if folder is not None:
        io.remove(spark, folder)
    hasher.update(after.encode())
    return hasher.hexdigest()
