"""Sorted ids in the order that Python's seeded generator shuffles them into, as joins over any number of rows.

A shuffle walks places i from the last to the second and swaps i with a drawn place j <= i. The draws are one sequence, but
cheap: one task runs the generator through and keeps its state at every ``CHUNK`` swaps only; then chunks draw again, in
parallel. The swaps themselves are resolved as a permutation:

* What stands at i in the end is what stood at j before that swap. The last to write to j was the least step s > i that
  drew j as well; without one, j still held its own id.
* What a step s wrote to j is what stood at s before it, for which the same holds: the least step above s that drew s.

So steps point to later ones, in chains that grow with the logarithm of the rows, and pointer jumping finds their ends in
rounds whose number grows with the logarithm of that. Steps that drew one place are few, so no key is hot.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdict.sources.checkpoint import checkpointed

#: Swaps that a task draws at once, a fixed number whatever the rows.
CHUNK = 1 << 20
STATE = "high long, low long, key binary, pos int, skip long"


class Draws:
    """Words of 32 bits of Python's generator, read in blocks; ``state`` tells where the next unread word stands."""

    def __init__(self, key: np.ndarray, pos: int, skip: int = 0) -> None:
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": pos}}
        self.words, self.at, self.before = np.zeros(0, np.uint64), 0, (key, pos)
        while skip:
            step = min(skip, CHUNK)
            self.ahead(step)
            self.at += step
            skip -= step

    @classmethod
    def seeded(cls, seed: int) -> Draws:
        *key, pos = random.Random(seed).getstate()[1]
        return cls(np.array(key, np.uint32), pos)

    def ahead(self, n: int) -> np.ndarray:
        """The next ``n`` words, which stay unread."""
        if len(self.words) - self.at < n:
            # What is unread is drawn again, so that a state before all of the buffer is at hand.
            unread = self.state()
            self.bits.state = {"bit_generator": "MT19937", "state": {"key": unread[0], "pos": unread[1]}}
            if unread[2]:
                self.bits.random_raw(unread[2], output=False)
            now = self.bits.state["state"]
            self.before, self.at = (now["key"].copy(), now["pos"]), 0
            self.words = self.bits.random_raw(max(n, 4096)).astype(np.uint64)
        return self.words[self.at : self.at + n]

    def state(self) -> tuple[np.ndarray, int, int]:
        return *self.before, self.at

    def places(self, high: int, low: int) -> np.ndarray:
        """The places drawn for i = high down to low: each is below i + 1, by as many bits as that has; others are drawn again."""
        found = []
        while high >= low:
            bits = (high + 1).bit_length()
            last = max(low, (1 << (bits - 1)) - 1)  # down to here i + 1 has as many bits
            width, want = 1 + (bits > 32), high - last + 1
            words = self.ahead(width * min(2 * want + 8, max(16, (high + 1) // 8), CHUNK))
            drawn = words >> np.uint64(32 - bits) if width == 1 else words[::2] | words[1::2] >> np.uint64(64 - bits) << np.uint64(32)
            drawn = drawn.astype(np.int64)
            # Each that is taken lowers the bound of those behind it: rounds until nothing changes settle a prefix each.
            taken = drawn <= high
            while True:
                again = drawn <= high - (np.cumsum(taken) - taken)
                if np.array_equal(again, taken):
                    break
                taken = again
            at = np.flatnonzero(taken)[:want]
            found.append(drawn[at])
            self.at += width * (int(at[-1]) + 1 if len(at) == want else len(drawn))
            high -= len(at)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunks(spark: SparkSession, total: int, seed: int, size: int = CHUNK) -> DataFrame:
    """(of ``STATE``) the generator's state ahead of every ``size`` swaps of a shuffle of ``total`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            draws, high = Draws.seeded(seed), total - 1
            while high > 0:
                low = max(1, high - size + 1)
                key, pos, skip = draws.state()
                yield pa.RecordBatch.from_arrays([pa.array([high]), pa.array([low]), pa.array([key.tobytes()], pa.binary()), pa.array([pos], pa.int32()), pa.array([skip], pa.int64())], ["high", "low", "key", "pos", "skip"])
                draws.places(high, low)
                high = low - 1

    return spark.range(0, 1, 1, 1).mapInArrow(run, STATE)


def swaps(spark: SparkSession, total: int, seed: int, size: int = CHUNK) -> DataFrame:
    """(i, j): with which place each place is swapped; place 0 with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                drawn = Draws(np.frombuffer(row["key"], np.uint32), row["pos"], row["skip"]).places(row["high"], row["low"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row["high"], row["low"] - 1, -1)), pa.array(drawn)], ["i", "j"])

    parts = max(1, min(-(-total // size), 4 * spark.sparkContext.defaultParallelism))
    drawn = checkpointed(chunks(spark, total, seed, size)).repartition(parts).mapInArrow(run, "i long, j long")
    return drawn.unionByName(spark.range(min(total, 1)).select(F.col("id").alias("i"), F.col("id").alias("j")))


def permutation(spark: SparkSession, total: int, seed: int, size: int = CHUNK) -> DataFrame:
    """(origin, place): where each place of a list of ``total`` stands after the shuffle."""
    steps = checkpointed(swaps(spark, total, seed, size))
    links = checkpointed(steps.where("i > j").groupBy(F.col("j").alias("step")).agg(F.min("i").alias("up")))
    while True:
        beyond = links.select(F.col("step").alias("up"), F.col("up").alias("top"))
        jumped = checkpointed(links.join(beyond, "up", "left").select("step", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        links = jumped.select("step", "up")
        if jumped.where("moved").isEmpty():
            break
    later = F.lead("i").over(Window.partitionBy("j").orderBy("i"))
    steps = steps.select("i", "j", later.alias("step")).join(links, "step", "left")
    return steps.select(F.coalesce("up", "step", "j").alias("origin"), F.col("i").alias("place"))


def indexed(df: DataFrame, ident: str, out: str) -> DataFrame:
    """Distinct values with their 0-based place in sorted order: places within the ranges of a distributed sort plus the
    sizes of the ranges before, a row for each."""
    bits = 33  # of a monotonic id, the place within its partition
    sorted_ = checkpointed(df.select(ident).orderBy(ident).withColumn("__at", F.monotonically_increasing_id()))
    ranges = sorted_.groupBy(F.shiftright("__at", bits).alias("__range")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = ranges.select("__range", before.alias("__before"))
    placed = sorted_.withColumn("__range", F.shiftright("__at", bits)).join(F.broadcast(ahead), "__range")
    return placed.select(ident, (F.col("__at").bitwiseAND((1 << bits) - 1) + F.col("__before")).alias(out))


def seeded_ranks(df: DataFrame, ident: str = "id", seed: int = 42, out: str = "rank", size: int = CHUNK) -> DataFrame:
    """Adds the 0-based place of every id in a shuffle of the sorted ids by Python's generator, to repeat splits made by it.

    Ids must be unique and not null. Nothing but the generator's states, some 2.5 KB for every ``size`` rows, leaves the
    distributed tables.
    """
    counted = df.groupBy(ident).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.coalesce(F.sum(F.col(ident).isNull().cast("int")), F.lit(0)).alias("nulls")).first()
    if counted.rows is not None and (counted.most > 1 or counted.nulls):
        raise ValueError("a seeded order needs unique ids")
    places = permutation(df.sparkSession, counted.rows or 0, seed, size)
    named = indexed(df, ident, "__origin").join(places, F.col("__origin") == F.col("origin"))
    return df.join(named.select(F.col(ident).alias("__id"), F.col("place").alias(out)), F.col(ident) == F.col("__id")).drop("__id")
