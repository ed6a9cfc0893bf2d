import random
import re

import pytest
from pyspark.sql import functions as F

from verdict.functions import python_code as P
from verdict.functions import reports as R
from verdict.functions import text as T
from verdict.sources.schema import REPORT

SOUP = ["a", "B", " ", "\n", "\r\n", "\r", "\t", "\x1c", " ", "ß", "É", "```", "python", "py", "1", ".", "_", "-"]


def soup(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SOUP) for _ in range(rng.randrange(0, 25))) for _ in range(n)]


def apply(spark, values, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r.x for r in df.select("k", expr(F.col("t")).alias("x")).orderBy("k").collect()]


def normalized(text):
    return "\n".join(line.strip() for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")).strip("\n")


def test_normalize_output(spark):
    values = [*soup(1500, 1), None, "", "\n\n a \n\n b \n"]
    assert apply(spark, values, T.normalize_output) == [normalized(v) for v in values]


def test_extract_python_code(spark):
    values = [*soup(1500, 2), "```python\nx\n```", "```PY y``` ```python z```", "no", None]
    def plain(v):
        m = re.search(r"```(?:python|py)\s*(.*?)```", v or "", re.S | re.I)
        return m[1].strip() if m else ""
    assert apply(spark, values, T.extract_python_code) == [plain(v) for v in values]


def test_strict_fence(spark):
    values = [*soup(1500, 3), "```python\nx\n```", " ```python \nx\ny\n``` \n", "```python\n\n```", "```python\nx```", "```py\nx\n```"]
    def plain(v):
        m = re.fullmatch(r"```python\s*\n(.*)\n```\s*", v.strip(), re.S)
        return m[1] if m else None
    assert apply(spark, values, T.fenced_code) == [plain(v) for v in values]


def test_small_text_functions(spark):
    assert apply(spark, ["A b!", "", None, "--", "x" * 100], lambda c: T.safe_slug(F.coalesce(c, F.lit("")), F.lit(7))) == ["problem_7_a_b", "problem_7_problem", "problem_7_problem", "problem_7_problem", "problem_7_" + "x" * 80]
    assert apply(spark, ["2.0 seconds", "256 MB", "", None, "x"], lambda c: T.parse_number(c, 1.5)) == [2.0, 256.0, 1.5, 1.5, 1.5]
    assert apply(spark, ["  Add   two Numbers. ", "", " "], lambda c: T.canonical_key(c, F.lit("stdin"), F.lit(""), F.lit("p"))) == ["stdin||add two numbers.", "id:p", "id:p"]
    assert apply(spark, ["straße"], lambda c: T.canonical_key(c, F.lit("callable"), F.lit(" Add "), F.lit("p"))) == ["callable|add|strasse"]


def test_case_folding(spark):
    rng = random.Random(1)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    texts = ["", "ABC", "Straße", "ΟΔΟΣ ΣΑΣ", "İstanbul I", "ﬁne ŉ ǰ", "ẞ", *every, *("".join(rng.choices([*every, "A", "z", " ", "é", "\U0001f600"], k=6)) for _ in range(300))]
    assert apply(spark, texts, T.casefold) == [t.casefold() for t in texts]


def quotas(n, v, r, e):
    vis = min(v, n - 2) if n >= 3 and r > 0 and e > 0 else 1 if n == 2 and r > 0 else min(v, n)
    rest = n - vis
    rew = min(r, rest - min(e, max(1, rest // 3))) if rest >= 2 and r > 0 and e > 0 else min(r, rest)
    return vis, rew, min(e, rest - rew)


@pytest.mark.parametrize("v,r,e", [(3, 20, 20), (1, 1, 1), (3, 0, 5), (3, 5, 0), (0, 4, 2)])
def test_case_quotas(spark, v, r, e):
    rows = spark.range(0, 15).select("id", T.case_quotas(F.col("id").cast("int"), v, r, e).alias("q")).orderBy("id").collect()
    assert [tuple(x.q) for x in rows] == [quotas(n, v, r, e) for n in range(15)]


def report(spark, valid, runs):
    rows = [(valid, "" if valid else "bad", [("t", "s", p, "", "", "", "", rc, to, tr) for p, rc, to, tr in runs])]
    return spark.createDataFrame([(rows[0],)], f"r {REPORT}")


def test_reports(spark):
    def of(df, c):
        return df.select(c.alias("x")).first().x
    r = F.col("r")
    empty, invalid = report(spark, True, []), report(spark, False, [])
    assert of(empty, R.all_passed(r)) and of(empty, R.pass_rate(r)) == 1.0 and of(empty, R.failure_kind(r)) == "NONE"
    assert not of(invalid, R.all_passed(r)) and of(invalid, R.pass_rate(r)) == 0.0 and of(invalid, R.failure_kind(r)) == "SYNTAX_ERROR" and of(invalid, R.candidate_score(r)) == -1.0
    mixed = report(spark, True, [(True, 0, False, False), (False, None, True, False), (False, 1, False, False), (False, 0, False, True)])
    assert of(mixed, R.pass_rate(r)) == 0.25 and of(mixed, R.failure_kind(r)) == "TIMEOUT"
    assert of(mixed, R.candidate_score(r)) == 0.25 - 1.25
    p = of(mixed, R.reward(r, r, F.lit(True)))
    assert list(p.reasons) == ["timeout", "runtime_error", "possible_sample_hardcode", "output_too_long"]
    assert abs(p.total - (0.05 + 0.15 * 0.25 + 0.6 * 0.25 - 2.0)) < 1e-9
    good = report(spark, True, [(True, 0, False, False)])
    assert abs(of(good, R.reward(r, r, F.lit(False))).total - 1.0) < 1e-9
    assert abs(of(empty, R.reward(r, r, F.lit(False))).total - 0.2) < 1e-9
    assert of(good, R.first_failed_detail(r)) is None and of(invalid, R.first_failed_detail(r)).kind == "SYNTAX_ERROR"


def test_python_code():
    assert P.compile_error("x = 1") is None and P.compile_error("x =") and P.compile_error("\ud800") and P.compile_error("return 1")
    assert P.parses("return 1") and not P.parses("x =")
    assert P.warns("1 is 1") and not P.warns("x = 1") and not P.warns("x =")
    assert P.round6.func(0.1234565) == round(0.1234565, 6)
