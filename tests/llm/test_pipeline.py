import random

import pytest

import corpus_pipeline
from verdict.llm import stages
from verdict.llm.quality import train


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(40)
    docs, labels = [], []
    for k in range(240):
        bad = k % 6 == 0
        body = "\n".join(text(rng.randrange(10, 40)) for _ in range(rng.randrange(1, 4)))
        docs.append((k, body.upper().replace(" ", "!! ") if bad else body, "en", f"s{k % 3}"))
        labels.append((k, int(not bad), 0))
    near = docs[1][1].split(" ")
    near[5] = near[20] = near[-1] = "changed"
    docs += [(1000, docs[1][1], "en", "s0"), (1001, " ".join(near), "en", "s1"), (1002, text(30) + " " + item + " " + text(9), "en", "s2"), (1003, None, "en", None), (1004, "", None, "s0"), (1005, docs[7][1] + "\n" + text(30), "en", "s2")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_stages(spark, folder, tmp_path):
    path, given = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "mixing" or docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    quality = {d[0] for d in given if d[0] < 240 and d[0] % 6}
    assert quality <= set(kept[names[0]]) and not {k for k in range(0, 240, 6)} & set(kept[names[0]])
    assert 1000 not in kept[names[1]]  # an exact copy has no line of its own
    assert kept[names[1]][1005] == given[-1][1].split("\n")[-1]
    assert 1002 in kept[names[2]] and 1002 not in kept[names[3]]
    assert set(kept[names[4]]) <= set(kept[names[3]])
    total = sum(len((t or "").split()) for t in kept[names[3]].values())
    assert 1.45 * total < docs.agg({"taken": "sum"}).first()[0] <= 1.5 * total


def test_run_agrees_with_stages(spark, folder, tmp_path):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert len(rows) > 100 and all(0 < r.taken <= 2 * r["size"] for r in rows)


def test_near_duplicates_leave_one(spark):
    body = " ".join(f"w{k}" for k in range(100))
    docs = [(3, body, 1), (2, body + " more", 1), (2, body + " more", 1), (9, "other words stand here now", 1), (None, None, 1), (5, "", 1), (5, "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, root int")
    assert sorted(((r.doc_id, r.text) for r in stages.keep_one_of_each(df).collect()), key=str) == sorted([(2, body + " more"), (9, docs[3][1]), (None, None), (5, "")], key=str)
    assert stages.keep_one_of_each(df).columns == df.columns


def test_classifier_without_both_classes():
    assert set(train([("a", 1)]).scores(["a", None, ""]).round(3)) == {1.0}


def test_columns_of_any_name_come_through_every_stage(spark):
    body = " ".join(f"w{k}" for k in range(60))
    schema = "doc_id long, text string, score double, bad_doc int, kept_doc int, kept_hash int, own_hash int, gone int, left int, line int, words int, content int, content_id int, marks int, `a.b` int, __h int, __hash_of_lines int, __doc_of_lines int, hash_of_lines int, doc_of_lines int"
    rows = [(k, text, 0.5, *range(k, k + 17)) for k, text in enumerate([body, body + " end", None, "", "other words stand here now and then again", body + "\n" + "line " * 9])] + [(None, "no id here at all", 0.1, *range(17))]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20, 50))), (2, None), (3, "")], "item_id long, text string")
    for out in (stages.keep_quality(df, df, labels, threshold=0.0), stages.dedup_lines(df), stages.keep_one_of_each(df), stages.drop_contaminated(df, items)):
        found = {r.doc_id: r for r in out.collect()}
        assert out.columns == df.columns and None in found
        assert all(tuple(found[k])[2:] == rows[k][2:] for k in found if k is not None)
    assert set(found) == {2, 3, 4, None}
    for stage in (lambda d: stages.keep_quality(d, df, labels), stages.dedup_lines, stages.keep_one_of_each, lambda d: stages.drop_contaminated(d, items)):
        assert stage(df.limit(0)).count() == 0


def test_measures_give_way_in_any_case(spark, tmp_path):
    """Columns that bear a measure's name, however it is written, are replaced by it, so that the mix can be written."""
    df = spark.createDataFrame([(1, "a b c", "s", 7, 8), (2, "d", None, 7, 8)], "doc_id long, text string, source string, Size int, TAKEN int")
    out = stages.mixed(df)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    out.write.parquet(str(tmp_path / "mix"))
    assert {r["size"] for r in spark.read.parquet(str(tmp_path / "mix")).collect()} <= {1, 3}
