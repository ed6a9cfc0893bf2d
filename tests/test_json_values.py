import json
import random

from pyspark.sql import functions as F

from verdict.functions import json_values as J
from verdict.functions.text import let
from verdict.operators import convert


def anything(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 7)
    if kind == 7:
        return [anything(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 8:
        return {word(rng): anything(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [None, True, False, rng.randrange(-10**6, 10**12), round(rng.uniform(-1e6, 1e6), rng.randrange(6)), rng.choice([0, 0.0, 1.0, 1e16, 1e22, 2.5e-7, 10**25]), word(rng)][kind]


def word(rng):
    return "".join(rng.choice(["a", "B", "'", '"', "\\", "\n", "\x1b", "é", "\U0001f600", " ", "1", ",", "{", "]"]) for _ in range(rng.randrange(6)))


def test_values_as_python_spells_them(spark):
    rng = random.Random(3)
    values = [anything(rng) for _ in range(1200)] + [[], {}, "", [[]], {"b": {"d": 1.0, "c": [2.50]}, "a": -0}]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")])) for v in values]
    df = spark.createDataFrame([(k, '{"x": ' + t + "}") for k, t in enumerate(texts)], "k int, t string")
    x = lambda body: let(J.field(J.value(F.col("t")), "x"), body)
    rows = df.select("k", x(J.as_json).alias("plain"), x(lambda v: J.as_json(v, True)).alias("sorted"), x(J.as_text).alias("text"), x(J.truthy).alias("truthy"), x(lambda v: F.transform(J.items(v), lambda i: J.as_text(i))).alias("items")).collect()
    for r in rows:
        v = json.loads(texts[r.k])
        assert (r.plain, r.sorted) == (json.dumps(v, ensure_ascii=False), json.dumps(v, ensure_ascii=False, sort_keys=True)), texts[r.k]
        assert r.text == str(v) and r.truthy == bool(v), texts[r.k]
        assert r["items"] == ([str(i) for i in v] if isinstance(v, list) else None)


def test_payloads_of_every_kind(spark):
    """(input_output, solutions, constraints) and what they give: entry point, cases, programs, constraints."""
    ok = '{"inputs": ["1"], "outputs": ["1"]}'
    told = [
        ('{"inputs": ["1 2 \\n", "3"], "outputs": ["a\\n", 5]}', '["p ", " ", 3, "q"]', '["n > 0", 3, 1.50, null]', ("", [("1 2\n", "a\n"), ("3\n", "5")], ["p", "q"], ["n > 0", "3", "1.5", "None"])),
        ('{"inputs": [["a", 1, [true, "x"]], []], "outputs": [["b", null], {"k": 1.0}]}', "print(1)", "n > 0", ("", [("a\n1\n[True, 'x']\n", "b\nNone"), ("\n", "{'k': 1.0}")], ["print(1)"], ["n > 0"])),
        ('{"fn_name": "f", "inputs": [[1, 2.50, {"b": 1, "a": [2]}], "s\\u00e9", null], "outputs": [[{"b": 1.0, "a": 1e5}], [1, 0], [[]]]}', '{"python": ["p"], "solutions": ["q"]}', "5",
         ("f", [('[1, 2.5, {"b": 1, "a": [2]}]', '{"a": 100000.0, "b": 1.0}'), ('"sé"', "[1, 0]"), ("null", "[]")], ["p"], ["5"])),
        ('{"fn_name": "", "entry_point": "g", "inputs": [[]], "outputs": ["x"]}', '{"python": [], "solutions": "q\\n"}', "0", ("g", [("[]", '"x"')], ["q"], [])),
        ('{"fn_name": 12, "inputs": [1], "outputs": [2]}', '"quoted"', "", ("12", [("1", "2")], ["quoted"], [])),
        (ok, "123", "null", ("", [("1\n", "1")], [], [])),
        (ok, "null", '{"a": 1}', ("", [("1\n", "1")], [], ["{'a': 1}"])),
        (ok, None, "true", ("", [("1\n", "1")], [], ["True"])),
        ('{"inputs": "ab", "outputs": {"x": 1, "y": 2}}', "[]", '""', ("", [("a\n", "x"), ("b\n", "y")], [], [])),
        ('{"inputs": [1], "outputs": []}', "p", "[]", ("", [], ["p"], [])),
        ('{"inputs": 5, "outputs": 5}', "p", "[]", ("", [], ["p"], [])),
        ("[1, 2]", "p", "[]", ("", [], ["p"], [])),
        ("not json", "p", "{", ("", [], ["p"], ["{"])),
        ("", "p", None, ("", [], ["p"], [])),
        (None, "p", None, ("", [], ["p"], [])),
    ]
    df = spark.createDataFrame([(k, *t[:3], "q") for k, t in enumerate(told)], "k int, input_output string, solutions string, constraints string, question string")
    for r in convert.convert(df, F.col("k"), 9, 0, 0).collect():
        entry, cases, programs, constraints = told[r.source_index][3]
        got = (r.entry_point, [(c.stdin, c.expected_stdout) for c in r.tests.visible_tests], [s.code for s in r.oracle.solutions], r.constraints)
        assert got == (entry, cases, programs, constraints), told[r.source_index][:3]
        assert r.io_mode == ("callable" if entry else "stdin")
        assert r.reason == ("invalid input_output pairs" if not cases else None if programs else "missing Python solutions")


def test_limits_of_any_type(spark):
    for kind, value, wanted in (("double", 268435456.0, 268435456), ("int", 64, 64), ("string", "about 12.5 MB", 12), ("string", "", 256), ("double", None, 256), ("string", "much", 256)):
        df = spark.createDataFrame([(0, value, value)], f"k int, memory_limit {kind}, time_limit {kind}")
        r = convert.convert(df, F.col("k")).first()
        assert r.memory_limit_mb == wanted and (wanted in (256, 12) or r.time_limit_sec == value)
