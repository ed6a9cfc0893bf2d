import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.llm import quality, toxicity
from verdict.llm.training import labelled, training_rows


def brute_features(text):
    """N-grams of characters within a word and its borders, as sets of strings per kind."""
    raw = " " + text + " "
    out = []
    for n in quality.NGRAMS:
        for k in range(len(raw) - n + 1):
            gram = raw[k : k + n]
            blank = [c in " \t\n\x0b\x0c\r" for c in gram]
            if not any(blank[1:-1]) and not (blank[0] and blank[-1]):
                out.append((n, "".join(" " if b else c for c, b in zip(gram, blank))))
    words = raw.split()
    out += [(101, w) for w in words] + [(102, p) for p in zip(words, words[1:])] + [(103,) for a, b in zip(words, words[1:]) if a == b]
    return out


@pytest.mark.parametrize("text", ["", "a", "ab ab ab", "the cat\tsat  on\nthe mat", "é ü ééé", "x" * 50, "\U0001f600\U0001f601 \u4f60\u597d\u4e16"])
def test_features_match_brute_force(text):
    hashes, owner = quality.features([text])
    want = brute_features(text)
    assert len(hashes) == len(want) and set(owner.tolist()) <= {0}
    assert len(set(hashes.tolist())) == len(set(want))


def test_features_do_not_depend_on_the_batch():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    hashes, owner = quality.features(texts)
    for k, t in enumerate(texts):
        assert sorted(hashes[owner == k].tolist()) == sorted(quality.features([t])[0].tolist())


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))]
        if not good:
            words = [w.upper() + "!!" for w in words] if k % 2 else [words[0]] * len(words)
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "scumbag", "pathetically"]))
        rows.append((k, " ".join(words), int(good), int(toxic)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = corpus(900, 2) + [(1000, None, 1, 0), (1001, "", 1, 0), (1002, "x " * 100_000, 1, 0), (None, "no id", 1, 0)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows if i is not None and i < 900] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got.values())
    held = [(got[i].predicted, q) for i, _, q, _ in rows if i is not None and i < 900 and got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(900, 3) + [(1000, None, 1, 0), (1001, "", 1, 0), (1002, "x " * 100_000, 1, 0), (None, "no id", 1, 0)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if i is not None and i < 900], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(got[i].predicted, q) for i, _, _, q in rows if i is not None and i < 900 and got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    swapped = len(a) == len(b) and any(a[:k] + a[k + 1] + a[k] + a[k + 2 :] == b for k in range(len(a) - 1))
    return min(row[-1], 1) if swapped else row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(4)
    terms = [toxicity.Term(t, False) for t in ("abcab", "abba", "bacabc", "cabcabc")]
    automaton = toxicity.Automaton(terms)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    text = " ".join(words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = ends - [len(w) for w in words]
    hit, term, d = automaton.scan(codes, begins, ends)
    found = dict(zip(hit.tolist(), zip(term.tolist(), d.tolist())))
    for k, w in enumerate(words):
        fits = [min(1, distance(w, t.text)) for t in terms if w[0] == t.text[0] and distance(w[1:], t.text[1:]) <= t.edits or t.edits and len(t.text) >= toxicity.FIRST_FROM and distance(w, t.text) <= 1]
        assert (k in found) == bool(fits), w
        if fits:
            assert found[k][1] == min(min(fits), found[k][1]) <= 1


def test_context_separates_quotation():
    model = toxicity.Model(toxicity.Automaton([toxicity.Term("idiot", False), toxicity.Term("grumbl", True)]), frozenset({"idiom"}), (0.0, 1.0, 1.0, 1.0, 1.0, 1.0))
    def hits(t):
        return [(h.distance, h.quoted) for _, found in model.hits([t]) for h in found]
    assert hits("You idiot!") == [(0, False)]
    assert hits('He used "idiot" there') == [(0, True)]
    assert hits("they quote idiot") == [(0, True)]
    assert hits("such an 1di0t and idiott") == [(0, False), (1, False)] and hits("id10t") == [(0, False)]
    assert hits("an idiom") == [] and hits("grumbling grumbl") == [(0, False)] * 2
    weight = {t: h.weight for t in ("idiot", "you idiot idiot") for _, f in model.hits([t]) for h in f}
    assert weight["you idiot idiot"] > weight["idiot"]


def test_misspelt_terms():
    automaton = toxicity.Automaton([toxicity.Term("scumbag", False), toxicity.Term("moron", False)])
    model = toxicity.Model(automaton, frozenset(), toxicity.PRIOR)
    for word in ("scumbag", "xcumbag", "cumbag", "scumabg", "sucmbag", "csumbag", "ascumbag", "scumbagg", "scumba", "scvmbag", "mroon", "moorn", "morxn"):
        assert [h.term for _, f in model.hits([f"a {word}!"]) for h in f] == [int(word[0] == "m" and word != "xcumbag")], word
    assert not list(model.hits(["oron boron scmbg xscumbagx ba"]))


def test_quotation_of_whole_passages():
    model = toxicity.Model(toxicity.Automaton([toxicity.Term("scumbag", False)]), frozenset(), toxicity.PRIOR)
    quoted = lambda t: [h.quoted for _, f in model.hits([t]) for h in f]
    assert quoted('He wrote to us: "what a scumbag he is" and left') == [True]
    assert quoted("«quel scumbag ici» et un scumbag") == [True, False]
    assert quoted("in other words he is a scumbag") == [False]
    assert quoted('a " mark and\na scumbag " there') == [False]


def test_chance_is_exact_at_all_sizes():
    from math import comb

    for ones, total, base in ((20, 60, 0.2), (20, 61, 0.2), (150, 400, 0.3), (0, 5, 0.1), (3, 3, 0.5), (90, 1000, 0.1), (5, 900, 0.1)):
        want = sum(comb(total, k) * base**k * (1 - base) ** (total - k) for k in range(ones, total + 1))
        assert toxicity.chance(ones, total, base) == pytest.approx(want, rel=1e-6)


def test_sample_does_not_prefer_short_texts(spark):
    docs = spark.createDataFrame([(k, "x" * (10 + 30 * k)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    lengths = [len(t) for t, _ in training_rows(docs, labels, "toxic", max_chars=15_000)]
    assert sum(lengths) <= 15_000 and max(lengths) > 1_000 and len(lengths) > 5
    assert training_rows(docs, labels, "toxic", max_chars=5) == []


def test_sample_is_bounded(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "1 AS toxic")
    assert 100 < labelled(labels, "toxic", 200).count() < 300


def test_sample_is_bounded_in_rows_and_characters(spark):
    """An id of many rows, with or without text, counts as a whole, and does not reach the driver if it is too large."""
    docs = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text")).unionByName(spark.range(400).select(F.lit(2).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    docs = docs.unionByName(spark.range(4, 30, 3).select(F.col("id").alias("doc_id"), F.lit("y").alias("text")))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    rows = training_rows(docs, labels, "toxic", max_chars=5_000)
    assert rows and {t for t, _ in rows} == {"y"}
    assert len(training_rows(docs, labels, "toxic", max_chars=10**6)) > 400
