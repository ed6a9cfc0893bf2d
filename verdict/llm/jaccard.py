"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A document's set holds the hashes of its distinct word shingles; equal sets are one class from the start. Sets are banded
by size, a band being a factor of two; a set that may have smaller partners in the band below is in that one as well. In a
band every set is cut, by ranges of hashes, into the same number of blocks, more than two linked sets of the band can
differ in elements. So linked sets agree in whole blocks, and the heaviest blocks, one more than the set may differ in,
hold one of these. The hash of a block's elements is its signature, and a tile holds the sets of a band that agree in one.

That is so for sets in bands of up to ``EXACT`` blocks, below 256 shingles at 0.85, 128 at 0.8: nothing is left to chance.
Larger sets are cut into fewer, heavier blocks, of which the first ``BLOCKS`` are looked at. Blocks hold different elements,
so the chance that a link at the very threshold shows in none of them is below 2e-7 for any sizes, and 1e-9 for most. A
passage that many documents share seldom fills a block of theirs, so it makes no large tile.

1. Each class is paired with the smallest class of its tile. Pairs are verified.
2. Verified links are contracted to components. Of the tiles that still hold several components, one of each membership
   is cut into parts of about ``PART_BYTES``. Each pair of parts meets in one task, where sizes and bit counts of hashed
   bitmaps rule out most pairs, sorted arrays decide on the rest, and pairs that are connected already are skipped. A task
   returns links that join components only, never all pairs.

The bound by bit counts: an overlap is at most (|A| + |B| - popcount(bits(A) xor bits(B))) / 2, where a bit is the parity
of the hashes that fall on it.

Defined results: null, empty and blank texts have no set, are linked with nothing and are their own component; a text of
fewer words than a shingle is one shingle; rows that agree in text are one class whatever their ids; a component's id is
the least ``doc_id`` in it (null only if all are); repeated rows stay repeated; only ``doc_id`` and ``text`` are read;
empty tables give an empty result. Sets are told apart by 128 bits of their contents. Short ids of 64 bits only bring
sets together: sets that share one by chance are compared besides, and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpointed, hinted, looked_up, slices
from verdict.llm.components import components, refined

EXACT, BLOCKS, LIGHT, PART_BYTES, SLICE = 64, 48, 3, 4_000_000, 2_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: Sequence[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the word shingles of each text, with A-Z lower-cased."""
    out: list[np.ndarray] = []
    for start, stop in slices(texts, SLICE):
        part = texts[start:stop]
        buffer = LOWER[np.frombuffer(b" ".join([b"", *part, b""]), np.uint8)]
        space = IS_SPACE[buffer]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(len(buffer), MULTIPLIER))])
        edge = np.flatnonzero(np.diff(space.astype(np.int8)))
        begin, end = edge[::2] + 1, edge[1::2] + 1
        word = mixed((sums[end] - sums[begin]) * powers(len(buffer) + 1, INVERSE)[begin])
        ends = np.cumsum(np.array([len(t) + 1 for t in part], np.int64))
        counts = np.diff(np.concatenate([[0], np.searchsorted(begin, ends, "right")]))
        rolled = word.copy()
        for k in range(1, size):
            rolled = rolled * np.uint64(0x100000001B3)
            rolled[: max(0, len(word) - k)] += word[k:]
        rolled = mixed(rolled)
        at = 0
        for n in counts.tolist():
            if n >= size:
                out.append(np.unique(rolled[at : at + n - size + 1]))
            elif n:
                whole = np.uint64(n)
                for w in word[at : at + n]:
                    whole = mixed(np.array([whole]) * np.uint64(0x100000001B3) + w)[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def parts(band: int, percent: int) -> tuple[int, int]:
    """Into how many blocks sets of a band are cut, and how many of them are looked at: up to EXACT more than linked sets
    of the band differ in elements; beyond, fewer and heavier ones, of which BLOCKS will do."""
    largest = (2 << band) - 1
    above = largest * 100 // percent
    differ = max(largest * (100 - percent) // percent, 2 * above * (100 - percent) // (100 + percent))
    exact = max(4, differ + 1 + differ // 7)
    return (exact, exact) if exact <= EXACT else (differ * 4 // 5, min(BLOCKS, differ * 4 // 5))


def tile_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set's tiles: band, number and contents of its heaviest blocks in each of its bands."""
    n = len(own)
    if not n:
        return np.zeros(0, np.int64)
    band = n.bit_length() - 1
    roles = [(band, n * (100 - percent) // percent)]
    if band and n * percent < 100 << band:
        roles.append((band - 1, 2 * n * (100 - percent) // (100 + percent)))
    out = []
    for at, differ in roles:
        total, k = parts(at, percent)
        cut = np.concatenate([[0], np.searchsorted(own, np.arange(1, k + 1, dtype=np.uint64) * np.uint64((1 << 64) // total - 1))])
        if k == total:
            cut[-1] = n
        weight = np.diff(cut)
        falling = -np.sort(-weight)
        # The heaviest blocks, one more than may differ; of large sets all but light ones.
        least = falling[differ] if differ < k == total else min(LIGHT, falling[2 * k // 3])
        pick = np.flatnonzero(weight >= least)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own[: cut[-1]]))])
        held = sums[cut[1:]] - sums[cut[:-1]] + weight.astype(np.uint64)
        out.append(mixed(mixed(held[pick]) + (pick.astype(np.uint64) + np.uint64(at << 32)) * np.uint64(MULTIPLIER)))
    return np.concatenate(out).view(np.int64)


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` (a power of two, 64 at least) parities of the hashes modulo ``bits``, packed into bytes."""
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Size bound, bitmap bound, then the exact intersection of two sorted arrays."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    bits = max(64, 1 << (small - 1).bit_length())
    differing = int(np.bitwise_count(bitmap(a, bits) ^ bitmap(b, bits)).sum())
    most = (small + large - differing) // 2
    if 100 * most < percent * (small + large - most):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="mergesort")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, keys) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for start, stop in slices(texts, SLICE):
                part, sets = batch.slice(start, stop - start), shingle_sets(texts[start:stop], size)
                # A set that no other can be linked with has no tiles.
                keys = [tile_keys(s, percent) if (len(s) + 1) * percent <= len(s) * 100 else np.zeros(0, np.int64) for s in sets]
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), flat], ["doc_id", "text_hash", "n_shingles", "set_id", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, keys array<bigint>")


def arrays(docs: DataFrame, size: int) -> DataFrame:
    """(set_id, elements): the sorted hashes of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
            for start, stop in slices(texts, SLICE):
                sets = shingle_sets(texts[start:stop], size)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], ["set_id", "elements"])

    return docs.select("text").mapInArrow(run, "set_id binary, elements binary")


def verified(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) of short ids that are links, as set ids. ``elements`` has cid, set_id and elements."""
    one = elements.select(F.col("cid").alias("a"), F.col("set_id").alias("u"), F.col("elements").alias("x"))
    two = elements.select(F.col("cid").alias("b"), F.col("set_id").alias("v"), F.col("elements").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [linked(np.frombuffer(x[k].as_py(), np.uint64), np.frombuffer(y[k].as_py(), np.uint64), percent) for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(one, "a").join(two, "b").where("u <> v")
    return joined.select("u", "v", "x", "y").mapInArrow(run, "u binary, v binary")


def part_links(rows: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """Links (u, v), as set ids, that join different components among classes of one tile.

    ``rows`` has key, cid, n and root: a class, a tile of it, and its component so far. A tile is dealt by hash into parts
    of about PART_BYTES of arrays, and each pair of parts, a part with itself included, meets in one task. There size and
    bit counts rule out, sorted arrays decide, and what is connected already is not tried. Only links that join components
    leave the task, fewer than it has classes.
    """
    counted = rows.groupBy("key").agg(F.ceil(F.sum("n") * 8 / PART_BYTES).cast("int").alias("parts"))
    dealt = rows.join(counted, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    sent = dealt.select("key", "cid", "root", F.explode(pair).alias("pair"))

    def compare(block: pa.Table) -> pa.Table:
        raw, ids, names = block.column("elements").to_pylist(), block.column("set_id").to_pylist(), block.column("root").to_pylist()
        order = sorted(range(len(raw)), key=lambda k: (len(raw[k]), ids[k]))
        sets = [np.frombuffer(raw[k], np.uint64) for k in order]
        n = np.array([len(s) for s in sets], np.int64)
        number: dict[bytes, int] = {}
        root = np.array([number.setdefault(names[k], len(number)) for k in order])
        bits = max(64, 1 << int(n[-1]).bit_length())
        maps = np.stack([bitmap(s, bits).view(np.uint64) for s in sets])
        label = list(range(len(number)))

        def find(k: int) -> int:
            while label[k] != k:
                label[k] = label[label[k]]
                k = label[k]
            return k

        one, two = [], []
        for k in range(len(sets) - 1):
            last = int(np.searchsorted(n, n[k] * 100 // percent, "right"))
            rest = np.flatnonzero(root[k + 1 : last] != root[k]) + k + 1
            if not len(rest):
                continue
            total = n[k] + n[rest]
            most = (total - np.bitwise_count(maps[k] ^ maps[rest]).sum(1, dtype=np.int64)) // 2
            for j in rest[100 * most >= percent * (total - most)].tolist():
                x, y = find(int(root[k])), find(int(root[j]))
                if x != y and linked(sets[k], sets[j], percent):
                    label[max(x, y)] = min(x, y)
                    one.append(ids[order[k]])
                    two.append(ids[order[j]])
        return pa.table({"u": pa.array(one, pa.binary()), "v": pa.array(two, pa.binary())})

    full = elements.select("cid", "set_id", "elements")
    return sent.join(full, "cid").groupBy("key", "pair").applyInArrow(compare, "u binary, v binary")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, component_id, root) for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = checkpointed(signed(docs, size, percent))
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("sample"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = checkpointed(classes.withColumn("cid", F.xxhash64("set_id")))
    # Dealt by key once: the tiles' ends and the join back read the same shuffle.
    members = classes.select(F.explode("keys").alias("key"), "cid", "n").repartition("key")
    at = F.struct("n", "cid")
    pivots = members.groupBy("key").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low.cid <> high.cid").select("key", "low")
    shared = checkpointed(members.join(pivots, "key"))

    needed = shared.select("cid").distinct()
    sample = checkpointed(classes.join(needed, "cid").select("cid", "set_id", F.col("sample.doc_id").alias("d"), F.col("sample.text_hash").alias("h")))
    texts = looked_up(docs, sample.select("d", "h").distinct()).select("text")
    elements = checkpointed(arrays(texts, size).dropDuplicates(["set_id"]).join(sample.select("set_id", "cid"), "set_id"))

    def fits(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    # Each class with the smallest of its tile.
    first = shared.where((F.col("cid") != F.col("low.cid")) & fits("n", "low.n")).select(F.least("cid", "low.cid").alias("a"), F.greatest("cid", "low.cid").alias("b"))
    roots = checkpointed(components(checkpointed(verified(first.distinct(), elements, percent))))

    # The tiles that hold several components, one of each membership.
    short = sample.select("set_id", "cid").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("cid", F.coalesce("root", "set_id").alias("root"))
    open_tiles = checkpointed(shared.select("key", "cid", "n").join(short, "cid"))
    held = [F.count("*").alias("classes"), *(F.bit_xor(F.xxhash64("cid", F.lit(salt))).alias(f"held{salt}") for salt in (1, 2))]
    tiles = open_tiles.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q"), *held).where("p <> q")
    tiles = checkpointed(tiles.groupBy("classes", "held1", "held2").agg(F.min("key").alias("key")).select("key"))
    more = checkpointed(part_links(open_tiles.join(hinted(tiles), "key"), elements, percent))
    roots = refined(roots, more)

    named = classes.select("set_id", "least_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "least_id", F.coalesce("root", "set_id").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, "root").select("set_id", "root", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "set_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")
