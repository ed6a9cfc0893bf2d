import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.oracle import DATA
from verdict.llm import registry
from verdict.llm.runs import periodic_runs, repeating, runs_of


def brute(symbols, least=12):
    """Every distance, every maximal stretch of agreement; the smallest period of those that are long enough."""
    s, found = np.asarray(symbols), {}
    for p in range(1, len(s) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], s[p:] == s[:-p], [0]]).astype(int)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = b - a + p
            # A stretch is a run of its smallest period only: that divides what overlaps by two periods or more.
            if length >= max(least, 2 * p) and not any(x <= a and y >= a + length and q < p for (x, y), q in found.items()):
                found[a, a + length] = p
    return sorted((a, b - a, p) for (a, b), p in found.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def numbers(words):
    seen = {}
    return [seen.setdefault(w, len(seen) + 1) for w in words]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = [[rng.randrange(1, rng.choice([2, 3, 4, 9])) for _ in range(rng.randrange(45))] for _ in range(rng.randrange(1, 6))]
        texts.append((texts[0][:7] * 9)[rng.randrange(5) :])
        least = rng.choice([2, 5, 12])
        at, runs = runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), least)
        got = [[] for _ in texts]
        for k, *run in zip(at.tolist(), *(x.tolist() for x in runs)):
            got[k].append(tuple(run))
        assert got == [brute(t, least) for t in texts]


def test_fibonacci_words_and_long_periods():
    a, b = [1], [1, 2]
    for _ in range(14):
        a, b = b, b + a
    tail = list(range(10, 3010)) + b + list(range(50, 1050)) * 4 + [7] * 900
    at, runs = runs_of(np.array(tail, np.int64), np.array([len(tail)]), 12)
    assert sorted(zip(*(x.tolist() for x in runs))) == brute(tail)


def test_texts_without_repeats_are_passed_over():
    s = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9], np.int64)
    assert repeating(s, np.array([12, 6]), 6).tolist() == [True, False]
    assert repeating(s, np.array([6, 6, 6]), 6).tolist() == [False] * 3
    assert repeating(s[:0], np.array([0, 0]), 6).tolist() == [False, False]


def test_rows_of_any_kind(spark):
    rng = random.Random(2)
    loop = "\tword é\n" * 30
    texts = [None, "", " \n ", "one", loop, "x " * 12, "x " * 11, loop + "end " + loop, "a\x0bb\x0cc d " * 9, " ".join(rng.choices("ab", k=3000)), "z " * 400_000]
    rows = [(k, t, k, "r") for k, t in enumerate(texts)] + [(None, loop, 1, "r"), (4, loop, 1, "r")]
    got = {}
    for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, key int, runs string").repartition(3)).collect():
        value = [tuple(x) for x in r.runs], r.collapsed, r.n_words
        assert got.setdefault(r.key, value) == value
    assert len(got) == len(texts) + 1
    for k, text, *_ in rows:
        words = words_of(text)
        runs = [(0, 400_000, 1)] if k == 10 else brute(numbers(words))
        assert got[k] == (runs, "z" if k == 10 else collapsed(words, runs), len(words))
    empty = periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["key", "n_words", "runs", "collapsed"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
def test_query_equals_brute_force(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    rows, seen = registry.QUERIES["op12_runs"](spark, DATA).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        words, h = words_of(texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(numbers(words))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5
