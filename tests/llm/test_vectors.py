import math
import random
import time

import numpy as np
import pytest

from verdict.llm import near_vectors as module
from verdict.llm.cover_tree import Links, build, distance, traverse
from verdict.llm.near_vectors import near_vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def components(near):
    """Of a matrix of links, or of lists: the least number that each reaches."""
    out = list(range(len(near)))
    for k in range(len(near)):
        if out[k] == k:
            waiting = [k]
            while waiting:
                for j in np.flatnonzero(near[waiting.pop()]).tolist():
                    if out[j] == j and j != k:
                        out[j] = k
                        waiting.append(j)
    return out


def clouds(rng, n, d):
    middle = unit(rng.normal(size=(max(1, n // int(rng.integers(1, 40))), d)))
    return unit(middle[rng.integers(0, len(middle), n)] + rng.normal(size=(n, d)) * rng.choice([1e-9, 1e-3, 0.02, 0.05, 0.3]))


def test_tree_covers_and_halves():
    rng = np.random.default_rng(1)
    for _ in range(20):
        points = clouds(rng, int(rng.integers(1, 400)), int(rng.choice([2, 3, 8, 64])))
        tree = build(points)
        assert sorted(tree.order.tolist()) == list(range(len(points))) and np.array_equal(tree.points, points[tree.order])
        for k in range(len(tree.start)):
            own = tree.points[tree.start[k] : tree.stop[k]]
            assert distance(own @ own[0]).max() <= tree.radius[k] + 1e-7
            kids = range(tree.first[k], tree.last[k])
            if kids:
                assert [tree.start[c] for c in kids] == [tree.start[k], *(tree.stop[c] for c in kids[:-1])] and tree.stop[kids[-1]] == tree.stop[k]
                scale = 2.0 ** (math.ceil(math.log2(tree.radius[k])) - 1)
                heads = tree.points[[tree.start[c] for c in kids]]
                apart = distance(heads @ heads.T) + 9 * np.eye(len(heads))
                assert apart.min() > scale - 1e-7 and max(tree.radius[c] for c in kids) <= scale + 1e-7


def test_traversals_equal_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, least = int(rng.integers(2, 500)), float(rng.choice([0.95, 0.8, 0.999]))
        points, weights, half = clouds(rng, n, int(rng.choice([1, 2, 3, 8, 64]))), rng.integers(1, 5, n), n // 2
        tree = build(points)
        own, links = weights[tree.order], Links(weights[tree.order])
        traverse(tree, None, least, links)
        near = tree.points @ tree.points.T >= least
        np.fill_diagonal(near, False)
        assert links.total().tolist() == (near * own).sum(1).tolist() and links.labels.tolist() == components(near)
        one, two = build(points[:half]), build(points[half:])
        own = np.concatenate([weights[:half][one.order], weights[half:][two.order]])
        links = Links(own)
        traverse(one, two, least, links)
        near = np.zeros((n, n), bool)
        near[:half, half:] = one.points @ two.points.T >= least
        near |= near.T
        assert links.total().tolist() == (near * own).sum(1).tolist() and links.labels.tolist() == components(near)


def brute(rows, least):
    """By plain Python in double precision: (n_links, component) per row."""

    def valid(v):
        return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)

    near = np.zeros((len(rows), len(rows)), bool)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and valid(a) and valid(b) and len(a) == len(b):
                s, t = max(map(abs, a)), max(map(abs, b))
                a_, b_ = [x / s for x in a], [x / t for x in b]
                near[i, j] = math.fsum(x * y for x, y in zip(a_, b_)) / math.sqrt(math.fsum(x * x for x in a_) * math.fsum(x * x for x in b_)) >= least
    group = components(near)
    names = {}
    for k, (vec_id, _) in enumerate(rows):
        names.setdefault(group[k], []).append(vec_id)
    named = {g: min((x for x in ids if x is not None), default=None) for g, ids in names.items()}
    return sorted([(vec_id, int(near[k].sum()), named[group[k]], vec_id == named[group[k]]) for k, (vec_id, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("cell_bytes", [4_000_000, 2_000])
def test_rows_of_any_kind(spark, monkeypatch, cell_bytes):
    """With small cells too, so that nodes are split in several rounds, one direction and copies among them."""
    monkeypatch.setattr(module, "CELL_BYTES", cell_bytes)
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 0.15) for x in rng.choice(base)]) for k in range(300)]
    rows += [(1000 + k, [x * (1 + k) / 7 for x in base[0]]) for k in range(150)]  # one direction
    rows += [(2000 + k, base[1]) for k in range(80)] + [(2000, base[1]), (None, base[2]), (None, [9.0, 0, 0, 0, 0, 0])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [1.0, None, 0, 0, 0, 0]), (3004, [math.nan] * 6), (3005, [math.inf, 1.0, 0, 0, 0, 0]), (3006, [-0.0, 0.0])]
    rows += [(3007, [1.0, 0.0]), (3008, [2.0, 0.0]), (3009, [-1.0, 0.0]), (3010, [1.0]), (3011, [5.0]), (3012, [1e300, 1e300]), (3013, [1e-300, 1e-300])]
    rng.shuffle(rows)
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in rows]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, h string, node int").repartition(5)
    assert sorted(map(tuple, near_vectors(df, 0.95).collect()), key=str) == brute(rows, 0.95)


def test_floats_and_empty_tables(spark):
    empty = near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(5, [1.0, 0.1]), (3, [1.0, 0.2]), (9, [1.0, 0.9]), (2, None)]
    assert sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())) == [(2, 0, 2, True), (3, 1, 3, True), (5, 1, 3, False), (9, 0, 9, True)]
    none = near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, none.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def shuffle_bytes(spark):
    files, total = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), 0
    while files.hasNext():
        file = files.next()
        total += file.length() if file.getName().startswith("shuffle_") else 0
    return total


def test_pairs_of_cells_leave_no_shuffle_files(spark, monkeypatch):
    """Many cells that no bound prunes: tiles of several rounds find what all pairs have, and their shuffle files go."""
    monkeypatch.setattr(module, "CELL_BYTES", 8_000)
    monkeypatch.setattr(module, "ROUND_BYTES", 1, raising=False)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 16))
    points[1000:] = points[:500] + rng.normal(size=(500, 16)) * 0.02
    df = spark.createDataFrame([(k, v) for k, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    before = shuffle_bytes(spark)
    result = near_vectors(df, 0.95)
    for _ in range(20):  # files are removed in the background
        if shuffle_bytes(spark) - before < points.nbytes:
            break
        time.sleep(0.5)
    assert shuffle_bytes(spark) - before < points.nbytes
    near = unit(points) @ unit(points).T >= 0.95
    np.fill_diagonal(near, False)
    least = components(near)
    assert sorted(map(tuple, result.collect())) == [(k, int(near[k].sum()), least[k], least[k] == k) for k in range(1500)]
