import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from verdict.llm.filter_audit import REPEATED, audit, cells, failures

DOCS = "doc_id long, text string, source string, mask int, part string, all int"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows, k):
    doc_id, text, *_ = rows[k]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    out += "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows))


def brute(rows, labels):
    out, share = {}, {}
    masks = [fails(rows, k) for k in range(len(rows))]
    named = [[any(x[0] == r[0] and r[0] is not None and x[c] == 1 for x in labels) for c in (1, 2)] for r in rows]
    for part in {r[2] or "" for r in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(own)
            for step, letter in enumerate(order, 1):
                hit = {k for k in own if letter in masks[k]}
                gone = left & hit
                out[part, order, step] = [len(left - gone), len(gone), len(hit - gone), sum(masks[k] == letter for k in own), sum(named[k][0] for k in gone), sum(named[k][1] for k in gone)]
                share[part, letter] = share.get((part, letter), 0) + len(gone)
                left -= gone
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, rows, labels):
    out = audit(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS), spark.createDataFrame(labels, LABELS)).collect()
    named = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(named) == len(out)
    return named


def test_audit_equals_walking_all_orders(spark):
    rng = random.Random(3)
    pool = ["a", "B", "CC", "d#", "é", "w w", *(f"w{k}" for k in range(300))]
    texts = [" ".join(rng.choices(pool[: rng.choice([4, 40, 300])], k=rng.choice([0, 1, 5, 199, 200, 201, 400]))) for _ in range(40)]
    rows = [(rng.randrange(60), rng.choice(texts), rng.choice(["s", "s", "t", "", None])) for _ in range(120)]
    rows += [(None, texts[0], "s"), (None, None, None), (7, None, "s"), (8, "", "s"), (9, " \t\n", "t"), (7, None, "s"), (10, "A" * 5000 + " b" * 3000, "long")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 60, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_empty(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "x", "s")], [])["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_transform_is_exact_and_filters_are_a_parameter(spark):
    masked = spark.range(5000).select((F.col("id") % 3).cast("string").alias("part"), (F.col("id") * F.col("id") % 8).cast("int").alias("mask"))
    direct = {(r.part, r["mask"]): r["count"] for r in masked.groupBy("part", "mask").count().collect()}
    for r in cells(masked, 3, {"all": F.lit(1)}).collect():
        assert r["all"] == [direct.get((r.part, m), 0) for m in range(8)]
    docs = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "yy", "s")], "doc_id long, text string, source string")
    only = {"S": lambda t: F.length(t) < 2, "R": REPEATED}
    assert {(r.doc_id, r["mask"]) for r in failures(docs, only).collect()} == {(1, 1), (2, 3), (3, 0)}
    rows = audit(docs, spark.createDataFrame([], LABELS), only, {}).collect()
    assert sorted((r.part, r.filter_order, r.step, r.removed, r.shapley) for r in rows if r.part == "") == [("", "RS", 1, 1, 1), ("", "RS", 2, 1, 3), ("", "SR", 1, 2, 3), ("", "SR", 2, 0, 1)]


def test_copies(spark):
    rows = [(k, "same text", "s") for k in range(50)]
    assert found(spark, rows, [])["s", "EABCD", 1] == (1, 49, 0, 0, 0, 0, 49 * 60)
