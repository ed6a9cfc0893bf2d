"""Periodic runs of words: maximal repetitions by the runs theorem, and texts without their repeats.

Each run holds a Lyndon word of its period that is, in one of the two orders of the words, the longest Lyndon word at its
place. That one ends where the next smaller value of the inverse suffix array stands. So per order every place gives one
root, and 2n roots hold all runs. The root at i, of period p, extends to the right by the longest common prefix of the
suffixes i and i + p, to the left by that of the reversed text; both are least values of an LCP array between two ranks,
told by a sparse table. A sparse table of the ranks tells next smaller values as well.

Suffix arrays come from prefix doubling that sorts only what is not told apart yet. The texts of a batch are ranked at once,
each in a range of ranks of its own, so numpy works on long arrays; a text is never cut, whatever its length. A run of at
least L words repeats half of them at a distance of its period, so texts in which no L/2 words recur have none and are
passed over before that (hashes tell; equal hashes cost work only).

A text of n words takes O(n log n) time and, at its worst (one period throughout), about 8 n log2(n) bytes of memory, in
the task that holds it. Rows are worked on by themselves, so a lost executor costs its tasks only and no key is hot.

Defined results: null, empty and blank texts have no run and collapse to the empty text; repeated rows give equal rows; an
empty table gives an empty result; columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import slices

#: Characters of the texts that are ranked at once; a longer text is a slice of its own.
SLICE = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Runs(NamedTuple):
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class Suffixes(NamedTuple):
    rank: np.ndarray  # the inverse suffix array
    levels: list[np.ndarray]  # ranks by the first 1, 2, 4, ... symbols; equal where those are


def ranked(symbols: np.ndarray, block: np.ndarray) -> Suffixes:
    """The suffixes' ranks. Symbols are positive; a 0 ends each block and is its least symbol. Blocks rank one after another."""
    n = len(symbols)
    width = int(symbols.max()) + 1
    keys, groups, rank, levels = block * width + symbols, np.arange(n), np.zeros(n, np.int64), []
    base, step = np.zeros(n, np.int64), 1
    while True:
        order = np.argsort(keys, kind="stable")
        groups, keys, base = groups[order], keys[order], base[order]
        at = np.arange(len(keys))
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        outer = np.concatenate([[True], base[1:] != base[:-1]])
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        now = base + first - np.maximum.accumulate(np.where(outer, at, 0))
        rank[groups] = now
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        open_ = ~(fresh & np.concatenate([fresh[1:], [True]]))
        if not open_.any():
            return Suffixes(levels[-1], levels)
        # What is open has no 0 among its first symbols, so the place behind them is in its block.
        groups, base = groups[open_], now[open_]
        keys = base * n + rank[groups + step]
        step *= 2


def common_prefixes(suffixes: Suffixes) -> np.ndarray:
    """The LCP array: how many symbols the suffix of each rank shares with that of the rank before."""
    rank, levels = suffixes
    n = len(rank)
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    found = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
    near = np.flatnonzero(levels[0][place[1:]] == levels[0][place[:-1]]) + 1
    one, two = place[near - 1], place[near]
    total = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][one] == levels[k][two]
        step = same.astype(np.int64) << k
        one, two, total = one + step, two + step, total + step
    found[near] = total
    return found


def sparse_table(values: np.ndarray, span: int) -> list[np.ndarray]:
    """Least values of the stretches of 1, 2, 4, ... up to ``span`` entries from each place on; -1 if they pass the end."""
    table = [values]
    while 1 << len(table) <= span:
        half = 1 << (len(table) - 1)
        wide = np.full(len(values), -1, values.dtype)
        if half < len(values):
            wide[:-half] = np.minimum(table[-1][:-half], table[-1][half:])
        table.append(wide)
    return table


def next_smaller(values: np.ndarray, places: np.ndarray, span: int) -> np.ndarray:
    """The next place with a smaller value, which is at most ``span`` away."""
    table, own, at = sparse_table(values, span), values[places], places + 1
    for k in range(len(table) - 1, -1, -1):
        at = at + ((table[k][np.minimum(at, len(values) - 1)] > own).astype(np.int64) << k)
    return at


def extensions(suffixes: Suffixes, one: np.ndarray, two: np.ndarray, span: int) -> np.ndarray:
    """How many symbols the suffixes at two places of a block share: the least of the LCP array between their ranks."""
    low, high = np.minimum(suffixes.rank[one], suffixes.rank[two]) + 1, np.maximum(suffixes.rank[one], suffixes.rank[two]) + 1
    table = sparse_table(common_prefixes(suffixes), span)
    level = (np.frexp((high - low).astype(np.float64))[1] - 1).astype(np.int64)
    out = np.zeros(len(one), np.int64)
    for k in range(len(table)):
        here = level == k
        out[here] = np.minimum(table[k][low[here]], table[k][high[here] - (1 << k)])
    return out


def repeating(symbols: np.ndarray, counts: np.ndarray, gram: int) -> np.ndarray:
    """Which texts may hold a stretch of ``gram`` words twice, told by hashes: never False where one does."""
    mixed = (symbols.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    rolled = mixed.copy()
    for k in range(1, gram):
        rolled = rolled * np.uint64(0x100000001B3)
        rolled[: max(0, len(mixed) - k)] += mixed[k:]
    bits = max(1, len(counts)).bit_length()
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    keys = ((text << np.uint64(64 - bits)) | ((rolled * MULTIPLIER) >> np.uint64(bits)))[np.arange(len(symbols)) + gram <= ends]
    keys.sort()
    twice = keys[1:][keys[1:] == keys[:-1]]
    out = np.zeros(len(counts), bool)
    out[(twice >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def runs_of(symbols: np.ndarray, counts: np.ndarray, least: int = 12) -> tuple[np.ndarray, Runs]:
    """The texts (numbers, ascending) and the runs of ``least`` words or more, by text, start and period.

    ``symbols`` are the words of all texts as positive numbers, ``counts`` how many each text has.
    """
    none = np.zeros(0, np.int64)
    wanted = repeating(symbols, counts, -(-least // 2))
    if not wanted.any():
        return none, Runs(none, none, none)
    symbols, own, texts = symbols[np.repeat(wanted, counts)], counts[wanted], np.flatnonzero(wanted)
    # A 0 before the first text and after each: forwards it ends the text before it, backwards the one behind it.
    n, span = len(symbols) + len(own) + 1, int(own.max()) + 1
    text = np.repeat(np.arange(1, len(own) + 1), own)
    places = np.arange(len(symbols)) + text
    line = np.zeros(n, np.int64)
    line[places] = symbols
    after, before = np.cumsum(np.concatenate([[0], own + 1])), np.arange(len(own) + 1)
    block = np.zeros(n, np.int64)
    block[places], block[after] = text, before
    ahead = ranked(line, block)
    other = ranked(np.where(line > 0, line.max() + 1 - line, 0), block).rank
    i = np.concatenate([places, places])
    j = np.concatenate([next_smaller(ahead.rank, places, span), next_smaller(other, places, span)])
    del other
    right = extensions(ahead, i, j, span)
    del ahead
    block[after] = before + 1
    left = extensions(ranked(line[::-1], (len(own) + 1 - block)[::-1]), n - i, n - j, span)
    period = j - i
    long = right + left + period >= np.maximum(least, 2 * period)
    start, end, period = (i - left)[long], (j + right)[long], period[long]
    _, pick = np.unique(start * (n + 1) + end, return_index=True)
    start, end, period = start[pick], end[pick], period[pick]
    order = np.lexsort((period, start))
    start, length, period = start[order], (end - start)[order], period[order]
    number = block[start] - 1
    return texts[number], Runs(start - after[number] - 1, length, period)


def numbered(words: Sequence[bytes]) -> np.ndarray:
    """Equal words get equal positive numbers."""
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(key, n_words, runs, collapsed) per row of ``docs``, whole texts.

    A run is a stretch of at least ``least`` words, and two periods, that no neighbour extends; ``runs`` lists start,
    length and smallest period in words, by start and period. ``collapsed`` joins by one space the words that no run holds
    behind its first period.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(texts: list[str | None]) -> tuple[list[int], pa.Array, pa.Array]:
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        at, runs = runs_of(numbered([w for s in split for w in s]), counts, least) if counts.any() else (np.zeros(0, np.int64), Runs(*3 * [np.zeros(0, np.int64)]))
        edges = np.searchsorted(at, np.arange(len(split) + 1))
        for k in np.unique(at).tolist():
            own = slice(edges[k], edges[k + 1])
            held = np.zeros(len(split[k]) + 1, np.int64)
            np.add.at(held, runs.start[own] + runs.period[own], 1)
            np.add.at(held, runs.start[own] + runs.length[own], -1)
            split[k] = list(compress(split[k], (np.cumsum(held)[:-1] == 0).tolist()))
        rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs], fields=list(kind.value_type))
        return counts.tolist(), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows), pa.array([b" ".join(s) for s in split], pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in slices(texts, SLICE):
                counts, found, collapsed = work(texts[start:stop])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(counts, pa.int64()), found, collapsed], ["key", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
