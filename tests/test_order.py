import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.operators import digest as module
from verdict.operators.digest import Sha256, digest
from verdict.operators.seeded import Draws, seeded_ranks


def shuffled(ids, seed):
    ids = sorted(ids)
    random.Random(seed).shuffle(ids)
    return ids


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 100, 4097, 40_000])
def test_draws_follow_the_generator(n):
    for seed in (0, 42):
        rng = random.Random(seed)
        wanted = [rng._randbelow(i + 1) for i in range(n - 1, 0, -1)]
        assert Draws.seeded(seed).places(n - 1, 1).tolist() == wanted
        draws, high, found = Draws.seeded(seed), n - 1, []
        while high > 0:
            low = max(1, high - 700)
            again = Draws(*draws.state())
            part = draws.places(high, low).tolist()
            assert again.places(high, low).tolist() == part
            found, high = found + part, low - 1
        assert found == wanted


def test_draws_of_more_than_32_bits():
    rng, high = random.Random(3), (1 << 33) + 5
    assert Draws.seeded(3).places(high, high - 999).tolist() == [rng._randbelow(i + 1) for i in range(high, high - 1000, -1)]
    assert np.array_equal(Draws(*Draws.seeded(1).state()).ahead(5), Draws.seeded(1).ahead(5))


@pytest.mark.parametrize("n,size", [(0, 100), (1, 100), (2, 100), (50, 7), (10_000, 1500)])
def test_seeded_order_is_the_generators(spark, n, size):
    ids = [f"p{k * 7919 % 100_003}-é" if k % 2 else f"P{k}" for k in range(n)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(ids)], "id string, k int").repartition(3)
    rows = seeded_ranks(df, "id", 42, "place", size).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == shuffled(ids, 42)
    assert {(r.id, r.k) for r in rows} == set(zip(ids, range(n)))


def test_seeded_order_wants_unique_ids(spark):
    for ids in (["a", "b", "a"], ["a", None]):
        with pytest.raises(ValueError):
            seeded_ranks(spark.createDataFrame([(v,) for v in ids], "id string"))


@pytest.mark.parametrize("library", [True, False])
def test_state_of_a_hash(monkeypatch, library):
    if not library:
        monkeypatch.setattr(module, "_library", lambda: None)
    rng = random.Random(1)
    for n in [*range(0, 200, 3), 5000]:
        data, own, at = rng.randbytes(n), Sha256(), 0
        while at < n:
            step = rng.randrange(1, 200)
            own.update(data[at : at + step])
            own, at = Sha256(own.state()), at + step
        assert own.hexdigest() == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("range_bytes", [64_000_000, 200])
def test_digest_of_ranges(spark, range_bytes):
    rng = random.Random(2)
    values = ["", "é", "\U0001f600", *("v" * rng.randrange(40) + str(rng.randrange(50)) for _ in range(120))]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string").repartition(5)
    assert digest(df, F.col("v"), F.col("v"), range_bytes=range_bytes) == hashlib.sha256("\n".join(sorted(values)).encode()).hexdigest()
    bundle = F.concat(F.lit("<"), "v", F.lit(">"))
    assert digest(df, F.col("v"), bundle, ",", "[", "]", range_bytes) == hashlib.sha256(("[" + ",".join(f"<{v}>" for v in sorted(values)) + "]").encode()).hexdigest()
    assert digest(df.limit(0), F.col("v"), F.col("v"), before="[", after="]") == hashlib.sha256(b"[]").hexdigest()
