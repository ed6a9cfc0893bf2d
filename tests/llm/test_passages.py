import random

from pyspark.sql import functions as F

from verdict.llm import decontaminate, licenses
from verdict.llm.common import SPACE, words
from verdict.llm.windows import shingles


def test_words(spark):
    values = ["", " ", None, "a", "  a\tb\n", "a b"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    assert [r.w for r in df.select("k", words(F.col("t")).alias("w")).orderBy("k").collect()] == [[], [], [], ["a"], ["a", "b"], ["a", "b"]]


def plain_similarity(window, item):
    def grams(w):
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    own = grams(item)
    return sum(len(s) for s in own & grams(window)) / sum(len(s) for s in own)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: text(rng.randrange(30, 60)) for k in range(12)} | {100: ["tiny", "item"], 101: []}
    docs = []
    for k in range(60):
        body = text(rng.randrange(0, 120))
        if k % 3 == 0:
            held = list(items[k % 12])
            if k % 2:
                held[0] = "changed"
            cut = rng.randrange(len(body) + 1)
            body = body[:cut] + [w.upper() if k % 4 == 0 else w for w in held] + body[cut:]
        docs.append((k, " ".join(body), "c"))
    docs += [(900, None, "c"), (901, "", "c"), (902, " ".join(["common"] * 50_000), "c"), (903, "a tiny item here", "c"), (None, " ".join(items[3]), "c"), (904, " ".join(items[3]), "c"), (904, " ".join(items[3]), "c")]
    want = set()
    for ident, body, _ in docs:
        found = (body or "").lower().split()
        for key, item in items.items():
            if item and len(found) < 20_000:
                best = max((plain_similarity(found[k : k + len(item)], item) for k in range(max(1, len(found) - len(item) + 1))), default=0) if found else 0
                if best >= 0.8:
                    want.add((ident, key, round(best, 6)))
    df = spark.createDataFrame(docs, "doc_id long, text string, start string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want and len(got) > 15
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_short_items_edited_at_both_ends(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: text(rng.randrange(15, 26)) for k in range(60)}
    docs, want = [], set()
    for key, item in items.items():
        for edit, changed in enumerate(({0, -1}, {0, 1}, {-1}, {0, 1, -1})):
            held = ["changed" if k in changed or k - len(item) in changed else w for k, w in enumerate(item)]
            body = text(7) + held + text(7)
            docs.append((key * 10 + edit, " ".join(body)))
            best = max(plain_similarity(body[k : k + len(item)], item) for k in range(len(body) - len(item) + 1))
            if best >= 0.8:
                want.add((key * 10 + edit, key, round(best, 6)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(df, bench).collect()}
    assert len(want) > 100 and got == want, (len(got & want), len(want))


def test_blocks_find_all_within_radius(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.select(F.arrays_overlap(decontaminate.blocks(F.col("a")), decontaminate.blocks(F.col("b"))).alias("x")).where("not x").count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    docs = [(1, "x y\nReleased under the MIT License."), (2, "released UNDER the mit license"), (3, "under the license"), (4, None), (5, ""), (6, "é " * 3000 + mit.replace("hereby", "now") + " z"), (7, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(df, licenses.templates(spark)).collect()}
    assert {(1, "MIT"), (2, "MIT"), (6, "MIT"), (7, "CC-BY-NC-4.0")} == got
    assert licenses.scan(df.limit(0), licenses.templates(spark)).count() == 0


def test_published_notices(spark):
    gpl = "This {4} is free software{0} you can redistribute it and/or modify\nit under the terms of the GNU {3}General Public License as published by\nthe Free Software Foundation{1} either version {2} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,"
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell'
    isc = "Permission to use, copy, modify, {} distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    notices = {1: ("MIT", mit), 2: ("GPL-2.0", gpl.format(";", ";", 2, "", "program")), 3: ("GPL-3.0", gpl.format(":", ",", 3, "", "program")), 4: ("ISC", isc.format("and/or")), 5: ("ISC", isc.format("and")), 6: ("AGPL-3.0", gpl.format(":", ",", 3, "Affero ", "program")), 7: ("LGPL-2.1", gpl.format(";", ";", "2.1", "Lesser ", "library"))}
    df = spark.createDataFrame([(k, f"Copyright (c) 2020 A. Person\n\n{text}\nmore text") for k, (_, text) in notices.items()], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(df, licenses.templates(spark)).collect()} == {(k, name) for k, (name, _) in notices.items()}


def test_shingles(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["a"] * 4,)], "w array<string>")
    assert [sorted(r.s) for r in df.select(shingles(F.col("w"), 2).alias("s")).collect()] == [["a b", "b c"], [], ["a a"]]
    assert SPACE
