"""Quality classifier: averaged vectors of hashed word and character n-grams with a softmax output.

Every whole text is a bag of hashed n-grams of characters (``NGRAMS`` long, within one word and its borders), words and pairs
of words. Each hash owns a learned vector; a document is the average of its vectors, and softmax over a linear layer gives
its class. numpy trains both by stochastic gradient descent on the driver, over a bounded sample (see ``training``).
As the output is linear in the average, scoring needs one number per hash and class difference; those numbers (a fixed
``2**BITS`` of them) go to the executors.

Defined results: null and empty texts have no n-grams and get the score of the bias alone; without training rows of both
classes every score is the share of label 1 (0.5 without any); repeated rows get equal scores; columns other than the id
and the text are not read, and the label's tables never reach a score other than through the trained vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import slices
from verdict.llm.training import MAX_ROWS, held_out, training_rows

BITS, DIM, NGRAMS, EPOCHS, RATE, SEED = 17, 8, (3, 4), 6, 0.5, 7
#: Characters of text that are hashed at once.
SLICE = 1_000_000

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B1)) * MIX
    return ((h ^ (h >> np.uint64(32))) * MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of ``texts`` and the number of the text that each is from."""
    buffer = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    n = len(buffer)
    space = (buffer == 32) | (buffer - np.uint32(9) < 5)
    letters = np.where(space, np.uint32(32), buffer).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * _powers(n, MULTIPLIER))])
    back = _powers(n + 1, INVERSE)
    hashes, where = [], []
    blanks = np.concatenate([np.zeros(1, np.int32), np.cumsum(space, dtype=np.int32)])
    for size in NGRAMS:
        if n < size:
            continue
        starts = np.arange(n - size + 1)
        inner = blanks[size - 1 : n] - blanks[1 : n - size + 2]  # blanks strictly between the first and the last character
        starts = starts[(inner == 0) & ~(space[: n - size + 1] & space[size - 1 :])]
        hashes.append(_mixed((sums[starts + size] - sums[starts]) * back[starts], size))
        where.append(starts)
    edge = np.flatnonzero(np.diff(space.astype(np.int8)))
    begin, end = edge[::2] + 1, edge[1::2] + 1
    word = (sums[end] - sums[begin]) * back[begin]
    hashes.append(_mixed(word, 101))
    where.append(begin)
    owner = np.searchsorted(ends, begin, "right")
    pair = owner[1:] == owner[:-1]
    hashes.append(_mixed(word[:-1] * np.uint64(3) + word[1:], 102)[pair])
    where.append(begin[1:][pair])
    # A word that repeats its neighbour is a pair of its own kind, whatever the word.
    again = pair & (word[1:] == word[:-1])
    hashes.append(np.full(int(again.sum()), int(_mixed(np.zeros(1, np.uint64), 103)[0])))
    where.append(begin[1:][again])
    spot = np.concatenate(where)
    return np.concatenate(hashes), np.minimum(np.searchsorted(ends, spot, "right"), len(texts) - 1)


class Model(NamedTuple):
    """``bias + mean of weights[hash]`` is the log odds of label 1."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for start, stop in slices(texts, SLICE):
            hashes, owner = features([t or "" for t in texts[start:stop]])
            n = stop - start
            counts = np.bincount(owner, minlength=n)
            out[start:stop] = np.bincount(owner, self.weights[hashes], n) / np.maximum(1, counts)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def train(rows: Sequence[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = SEED) -> Model:
    """Fits the vectors. Every document's gradient is taken alone; classes weigh alike, so that the rarer one counts."""
    labels = np.array([int(label == 1) for _, label in rows], np.int64)
    ones = int(labels.sum())
    if not ones or ones == len(rows):
        share = (ones / len(rows)) if rows else 0.5
        return Model(np.zeros(1 << BITS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    bags = []
    for text, _ in rows:
        hashes, _ = features([text])
        index, count = np.unique(hashes, return_counts=True)
        bags.append((index.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight = np.array([len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones)]) ** 0.5
    # Averages of thousands of vectors move little, so each bag's gradient is scaled by its effective number of n-grams.
    scale = [1 / max(1e-6, float((share**2).sum())) for _, share in bags]
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, share = bags[k]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(index):
                continue
            hidden = share @ vectors[index]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p = (p * weight[labels[k]]).astype(np.float32)
            pull = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            vectors[index] -= (lr * min(scale[k], 200.0)) * np.outer(share, pull)
    return Model(vectors.astype(np.float64) @ (layer[:, 1] - layer[:, 0]).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    return train(training_rows(docs, labels, label, max_rows))


def with_scores(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    """``docs`` with the score of every whole text in column ``out``; all other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = sent.value
        scorer = Model(weights.astype(np.float64), bias)
        for batch in batches:
            parts = [scorer.scores(batch.slice(k, 1024).to_pylist()) for k in range(0, len(batch), 1024)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = fit(docs, labels, label, max_rows)
    scored = with_scores(docs.select("doc_id", "text"), model, "text", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
