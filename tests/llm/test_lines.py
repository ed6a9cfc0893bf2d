import random

from verdict.llm import line_dedup
from verdict.llm.line_dedup import clean, line_decisions


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(docs):
    """(doc, line, doc and line kept for it) of every line that has an equal or near line before it that stays."""
    lines = [((d, k), line.lower().split()) for d, t in docs for k, line in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if len(x[1]) >= 3 or len(" ".join(x[1])) >= 30), key=lambda x: x[0])
    stays, out = [], set()
    for place, own in lines:
        near = [p for p, other in stays if own == other or min(len(own), len(other)) >= 8 and abs(len(own) - len(other)) <= 1 and edit(own, other) <= 1]
        if near:
            out.add((*place, *near[0]))
        else:
            stays.append((place, own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(line))
                line[k : k + 1] = rng.choice([[], ["new"], [line[k], line[k]], [rng.choice("xyz")]])
                line = line or ["w"]
            lines.append(rng.choice([" ", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in line))
        docs.append((d, "\n".join(lines)))
    return docs


def test_against_brute_force(spark):
    for seed in (1, 2, 3, 4):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, line int")
        got = [(r.doc_id, r.line, r.kept_doc_id, r.kept_line) for r in line_decisions(df).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs)


def test_chain_keeps_what_is_beyond_the_bound(spark):
    a = [f"w{k}" for k in range(12)]
    b, c = [*a[:4], "x", *a[5:]], [*a[:4], "x", *a[5:9], "y", *a[10:]]
    e = [*c[:11], "z"]
    docs = [(k, " ".join(w)) for k, w in enumerate((a, b, c, e))]
    got = {(r.doc_id, r.kept_doc_id) for r in line_decisions(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (3, 2)}
    assert {r.doc_id for r in clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0, 2}


def test_lines_without_blanks(spark):
    one = "\u4f60\u597d" * 20
    docs = [(1, one), (2, f"{one}\nshort"), (3, "short\n" + one[:29])]
    got = {(r.doc_id, r.line, r.kept_doc_id) for r in line_decisions(spark.createDataFrame([*docs, (4, one[:29])], "doc_id long, text string")).collect()}
    assert got == {(2, 0, 1)}


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    docs = [(1, None, 9), (2, "", 9), (3, "a b c\na b c\n\nx", 9), (4, "A  b c", 9), (4, "A  b c", 9), (5, long, 9), (6, long.replace("w7 ", ""), 9), (None, "p q r s", 9), (7, "p q r s", 9), (8, "one two\none two", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, content int")
    got = {(r.doc_id, r.line, r.kept_doc_id, r.distance) for r in line_decisions(df).collect()}
    assert got == {(3, 1, 3, 0), (4, 0, 3, 0), (6, 0, 5, 1), (7, 0, None, 0)}
    left = {(r.doc_id, r.text) for r in clean(df).collect()}
    assert left == {(1, None), (2, ""), (3, "a b c\n\nx"), (5, long), (None, "p q r s"), (8, "one two\none two")}
    assert clean(df).columns == df.columns and clean(df.limit(0)).count() == 0


def shuffled_records(spark):
    store, done = spark.sparkContext._jsc.sc().statusStore(), 0
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    while stages.hasNext():
        done += stages.next().shuffleWriteRecords()
    return done


def test_variants_are_shuffled_once_and_rows_given_twice_count_once(spark, monkeypatch):
    """Variants go through one shuffle of keys alone, even where no side is small enough to be broadcast."""
    monkeypatch.setattr(line_dedup, "hinted", lambda df: df.hint("merge"))
    tail = " ".join(f"w{k}" for k in range(30))
    rows = [(d, "\n".join(" ".join(f"x{d}y{n}z{k}" for k in range(29)) + f" v{d} " + tail for n in range(20))) for d in range(40)]
    near = rows[3][1].split("\n")[5].replace("v3", "other")
    rows += [(99, near), (99, near)]
    before = shuffled_records(spark)
    got = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.line, r.kept_doc_id, r.kept_line, r.distance) for r in got] == [(99, 0, 3, 5, 1)]
    variants = 60 * 20 * 40
    assert shuffled_records(spark) - before < 1.5 * variants
