import random

import pytest

from verdict.llm.mixing import mix, mixed, targets


def water_level(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Shares the budget by weight, fixes what exceeds its cap and shares the rest again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(w[s] for s in left)
        over = {s for s in left if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            budget -= out[s]
        left -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k:02d}": rng.choice([0, 1, 10, 1000, 100_000]) for k in range(rng.randrange(1, 12))} | ({None: 50} if seed % 2 else {})
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water_level(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["hot"] * 8 + ["a", "b", None]), 5) for k in range(3000)]
    rows += [(9000, None, "a", 5), (9001, "", "a", 5), (9002, "w " * 40_000, "b", 5), (None, "w w", "a", 5), (9003, "w w", "a", 5), (9003, "w w", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    for found in by.values():
        assert sum(r.taken for r in found) == int(found[0].target) and sum(r["size"] for r in found) == found[0].source_size
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mix(df.repartition(13)).collect()))
    assert mix(df.limit(0)).count() == 0


def test_stage_keeps_rows_and_columns(spark):
    rows = [(k % 40, " ".join(["w"] * (k % 23)), ["a", "b", None][k % 3], k, "mine", 1.5, 9, "x") for k in range(400)] + [(7, "w w w", "a", 1000 + k, "mine", 1.5, 9, "x") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, size string, target double, h int, slice string")
    got = mixed(df).collect()
    assert mixed(df).columns == ["doc_id", "text", "source", "row", "h", "slice", "size", "source_size", "target", "taken"]
    assert len({r.row for r in got}) == len(got) and all(r["size"] == len(r.text.split()) and 0 < r.taken <= 2 * r["size"] and (r.h, r.slice) == (9, "x") for r in got)
    budget = {r.source: (r.target, r.source_size) for r in got}
    assert all(sum(r.taken for r in got if r.source == s) == int(t) for s, (t, _) in budget.items())
    assert sorted((r.doc_id, r["size"], r.taken) for r in mix(df).collect() if r.taken) == sorted((r.doc_id, r["size"], r.taken) for r in got)
    assert mixed(df.limit(0)).count() == 0
    lonely = mixed(spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string"))
    assert lonely.count() == 0


def test_rows_of_one_id_are_spread(spark):
    df = spark.range(5000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('w ', id) AS text", "'a' AS source")
    got = mix(df).collect()
    assert sum(r.taken for r in got) == 15_000 and len({r.taken for r in got}) <= 3
