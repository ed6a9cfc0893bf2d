import random

import numpy as np

from verdict.llm import jaccard
from verdict.llm.components import components


def brute(docs, size, percent):
    sets = []
    for _, text in docs:
        w = [x for x in (text or "").translate({k: k + 32 for k in range(65, 91)}).split()]
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and common:
                parent[root(i)] = root(j)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(root(k), []).append(docs[k][0])
    return sorted((docs[k][0], len(sets[k]), min(groups[root(k)])) for k in range(len(docs)))


def corpus(seed, copies):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(80)]
    shared = [rng.choice(words) for _ in range(12)]
    docs, ident = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, copies])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own += shared
            docs.append((ident, " ".join(own)))
            ident += 1
    return docs


def test_against_brute_force(spark):
    for seed, size, percent in ((1, 4, 85), (2, 5, 80)):
        docs = corpus(seed, 12)
        df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, size, percent).collect())
        assert got == brute(docs, size, percent)


def edges_of_links(rng, percent, largest):
    """Two sets that are just linked: of one size or of sizes as different as they may be."""
    while True:
        small = int(rng.integers(6, largest))
        large = small if rng.random() < 0.5 else int(rng.integers(small, small * 100 // percent + 1))
        common = -(-percent * (small + large) // (100 + percent))
        if common <= small:
            pool = np.unique(rng.integers(0, 1 << 64, 2 * (small + large) + 8, np.uint64))
            rng.shuffle(pool)
            return np.sort(pool[:small]), np.sort(np.concatenate([pool[:common], pool[small : small + large - common]]))


def test_links_at_the_threshold_meet_in_a_tile():
    rng = np.random.default_rng(5)
    for percent in (85, 80):
        exact = next(1 << b for b in range(20) if jaccard.parts(b, percent)[0] != jaccard.parts(b, percent)[1])
        for largest, n in ((exact, 4000), (40 * exact, 600)):
            for _ in range(n):
                a, b = edges_of_links(rng, percent, largest)
                assert jaccard.linked(a, b, percent)
                assert set(jaccard.tile_keys(a, percent).tolist()) & set(jaccard.tile_keys(b, percent).tolist()), (len(a), len(b))


def test_unlike_sets_that_share_a_passage_rarely_meet():
    rng = np.random.default_rng(6)
    passage, met = rng.integers(0, 1 << 64, 50, np.uint64), 0
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 300, np.uint64)])) for _ in range(60)]
    keys = [set(jaccard.tile_keys(s, 85).tolist()) for s in sets]
    for i in range(60):
        met += sum(bool(keys[i] & keys[j]) for j in range(i))
    assert met < 36  # of 1770 pairs


def test_parts_of_a_large_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_BYTES", 2000)
    docs = corpus(5, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 4, 85).collect())
    assert got == brute(docs, 4, 85)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "x " * 60_000), (7, "x x x x"), (None, "one"), (8, "É a b c d"), (9, "é a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 4, 85).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (None, 1, 4), (8, 2, 8), (9, 2, 9)}
    assert jaccard.jaccard_components(df.limit(0), 4, 85).count() == 0


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 60, np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 60))) for _ in range(2))
        if rng.random() < 0.7:
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], b[: rng.integers(0, 3)]]))
        common = len(np.intersect1d(a, b))
        assert jaccard.linked(a, b, 85) == (len(a) and len(b) and 100 * common >= 85 * (len(a) + len(b) - common))


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sets_of_a_slice_with_fewer_words_than_a_shingle():
    longer = b"some longer text that fills the slice"
    for size, text in ((4, b"one two"), (5, b"one two"), (5, b"one two three"), (5, b"one"), (5, b"")):
        alone = jaccard.shingle_sets([text], size)
        assert len(alone) == 1 and len(alone[0]) == min(1, len(text))
        assert alone[0].tolist() == jaccard.shingle_sets([longer, text, longer], size)[1].tolist()
