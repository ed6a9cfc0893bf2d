import json
import random
import struct

from pyspark.sql import functions as F

from verdict.functions.json_text import canonical_json, general_number, json_string, python_float


def numbers():
    rng = random.Random(1)
    given = [0.0, -0.0, 1.0, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 2e23, 1e-4, 1e-5, 2**-44, -1.6130484589462314e17, 1e100, float("inf"), float("-inf"), 2.2250738585072014e-308, 1e6, 1e7, 123456.5, 1234567.0, 1234565.0, 999999.5, 99999.95, 69826.85, 1.0000005]
    given += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(1500)] + [round(rng.uniform(0, 1e5), rng.randrange(8)) for _ in range(1500)]
    return [x for x in given if x == x]


def test_numbers_as_python_spells_them(spark):
    rows = spark.createDataFrame([(x,) for x in numbers()], "x double").select("x", python_float(F.col("x")).alias("p"), general_number(F.col("x")).alias("g")).collect()
    assert [(r.p, r.g) for r in rows] == [(json.dumps(r.x), f"{r.x:g}") for r in rows]
    none = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y").select(python_float(F.col("x")), general_number(F.col("x")), python_float(F.col("y")))
    assert tuple(none.first()) == ("NaN", "nan", None)


def test_strings_as_python_spells_them(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([*range(40), 34, 92, 92, 47, 98, 117, 127, 233, 0x2028, 0x1F600])) for _ in range(rng.randrange(12))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", json_string(F.col("x")).alias("p")).collect()
    assert [r.p for r in rows] == [json.dumps(r.x, ensure_ascii=False) for r in rows]


def test_canonical_values(spark):
    schema = "z string, a struct<y:array<double>,b:array<struct<k:string,c:boolean>>>, m int, l bigint, n string"
    values = [("é\n", ([1.0, None, 2.5e-7], [("q", True), None]), 3, 4, None), ("", None, None, 0, "x"), (None, ([], []), 1, None, '"')]
    df = spark.createDataFrame(values, schema)
    got = [r.j for r in df.select(canonical_json(F.struct(*df.columns), df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType).alias("j")).collect()]

    def plain(v):
        z, a, m, n, x = v
        return {"z": z, "a": a and {"y": a[0], "b": [b and {"k": b[0], "c": b[1]} for b in a[1]]}, "m": m, "l": n, "n": x}

    assert got == [json.dumps(plain(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in values]
