import json
import random

import pytest
from pyspark.sql import functions as F

from verdict.operators import audit, convert, evaluate, pack, records, resume, reward, solve, split, verify
from verdict.operators.execute import ExecConfig, evaluate as run
from verdict.sources import io
from verdict.sources.schema import PROBLEM, REWARD_LOG
from verdict.streaming import summary

SUM = "a, b = map(int, input().split())\nprint(a + b)"


def case(stdin, expected, ident="c", timeout=None):
    return {"stdin": stdin, "expected_stdout": expected, "id": ident, "timeout_sec": timeout}


def problem(ident="sum", code=SUM, verified=True, visible=True, rewarded=True, held=True, statement="Add two numbers.", mode="stdin", entry="", solutions=None):
    tests = {
        "visible_tests": [case("2 3\n", "5\n", "visible-0001")] if visible else [],
        "reward_tests": [case("10 20\n", "30\n", "reward-0001")] if rewarded else [],
        "eval_tests": [case("7 8\n", "15\n", "eval-0001")] if held else [],
    }
    solutions = [{"language": "python3", "code": code, "verified": verified}] if solutions is None else solutions
    return (ident, statement, "", "", [], "python3", 5.0, 256, mode, entry, tests, {"solutions": solutions, "source": "mock", "url": ""})


def table(spark, *rows):
    return spark.createDataFrame(list(rows), PROBLEM)


def test_execution():
    one = lambda code, *tests, **k: run(code, list(tests), 5.0, "s", **k)
    assert one(SUM, case("2 3", "5"))["runs"][0]["passed"]
    wrong = one("a, b = map(int, input().split())\nprint(a - b)", case("2 3", "5"))["runs"][0]
    assert not wrong["passed"] and wrong["actual"] == "-1"
    crash = one("raise RuntimeError('boom')", case("", ""))["runs"][0]
    assert crash["returncode"] and "RuntimeError" in crash["stderr"] and not crash["timed_out"]
    slow = one("print('begun', flush=True)\nwhile True: pass", case("", "", timeout=0.5))["runs"][0]
    assert slow["timed_out"] and slow["returncode"] is None and slow["actual"] == "begun"
    assert one("def add(a, b):\n    return a + b", case("[2, 3]", "5"), entry_point="add")["runs"][0]["passed"]
    assert one("class Solution:\n    def add(self, a, b):\n        return a + b", case("[2, 3]", "5"), entry_point="add")["runs"][0]["passed"]
    assert one("def f():\n    return {'b': 1, 'a': 2}", case("", '{"a": 2, "b": 1}'), entry_point="f")["runs"][0]["passed"]
    assert one("1 is 1")["syntax_valid"] and one("x =")["runs"] == [] and not one("x =")["syntax_valid"]
    big = run("print('x' * 100)", [case("", "x" * 100)], 5.0, "s", config=ExecConfig(max_output_bytes=10))["runs"][0]
    assert big["output_truncated"] and not big["passed"] and len(big["actual"]) == 10
    child = one("import subprocess, sys\nsubprocess.Popen([sys.executable, '-c', 'import time; time.sleep(60)'])\nprint(1)", case("", "1", timeout=3.0))["runs"][0]
    assert child["timed_out"] or child["passed"]
    grown = run("x = bytearray(900 << 20)\nprint(1)", [case("", "1")], 5.0, "s", config=ExecConfig(memory_limit=True), memory_mb=256)["runs"][0]
    assert not grown["passed"] and "MemoryError" in grown["stderr"]
    assert run("print(1)", [case("", "1")], 5.0, "s", config=ExecConfig(memory_limit=True), memory_mb=256)["runs"][0]["passed"]


def test_convert(spark):
    raw = [
        (0, "A B!", "q", "2.0 seconds", "256 MB", json.dumps({"inputs": ["1", "2", "3"], "outputs": ["1", "2", "3"]}), json.dumps(["print(input())"])),
        (1, "add", "q", None, None, json.dumps({"fn_name": "add", "inputs": [[2, 3]], "outputs": [["MAS"]]}), "print(1)"),
        (2, "x", " ", None, None, "{}", "[]"),
        (3, "x", "q", None, None, json.dumps({"inputs": ["1"], "outputs": []}), "[]"),
        (4, "x", "q", None, None, json.dumps({"inputs": ["1"], "outputs": ["1"]}), "[]"),
        (5, "x", "q", None, None, json.dumps({"fn_name": "f", "inputs": [[1]], "outputs": [[1, 0]]}), json.dumps({"python": ["p", " "]})),
    ]
    df = spark.createDataFrame(raw, "i int, name string, question string, time_limit string, memory_limit string, input_output string, solutions string")
    rows = {r.source_index: r for r in convert.convert(df, F.col("i"), 1, 1, 1).collect()}
    assert rows[0].id == "taco_0_a_b" and rows[0].time_limit_sec == 2.0 and rows[0].memory_limit_mb == 256
    assert [len(rows[0].tests[g]) for g in ("visible_tests", "reward_tests", "eval_tests")] == [1, 1, 1]
    assert rows[0].tests.eval_tests[0].id == "eval-0001" and rows[0].tests.eval_tests[0].stdin == "3\n"
    assert rows[1].io_mode == "callable" and rows[1].tests.visible_tests[0].stdin == "[2, 3]" and rows[1].tests.visible_tests[0].expected_stdout == '"MAS"'
    assert [rows[k].reason for k in (2, 3, 4)] == ["missing statement", "invalid input_output pairs", "missing Python solutions"]
    assert rows[5].tests.visible_tests[0].expected_stdout == "[1, 0]" and [s.code for s in rows[5].oracle.solutions] == ["p"]
    m = convert.manifest(convert.convert(df, F.col("i"), limit=5)).first()
    assert (m.scanned, m.written_this_run, sum(m.skip_reasons.values())) == (5, 2, 3)


def test_verify_prefers_clean_solutions(spark):
    solution = lambda c: {"language": "python3", "code": c, "verified": False}
    warned = "a, b = map(int, input().split())\nif a is 1: pass\nprint(a + b)"
    rows = table(
        spark,
        problem("clean", solutions=[solution("print(0)"), solution(warned), solution(SUM), solution("never")]),
        problem("warned", solutions=[solution(warned), solution("print(0)")]),
        problem("failed", solutions=[solution("print(0)")]),
        problem("none", solutions=[]),
        problem("vacuous", visible=False, rewarded=False, held=False, solutions=[solution("print(0)")]),
    )
    done = {r.id: r for r in verify.verify(rows, 4).collect()}
    assert [s.verified for s in done["clean"].oracle.solutions] == [False, False, True, False] and len(done["clean"].attempts) == 3
    assert [s.verified for s in done["warned"].oracle.solutions] == [True, False]
    assert {k: r.outcome for k, r in done.items()} == {"clean": "verified", "warned": "verified", "failed": "failed", "none": "no_solution", "vacuous": "verified"}
    assert verify.counters(verify.verify(rows.where("id in ('none', 'vacuous')"), 4, strict=True)).first().asDict() == {"verified": 0, "failed": 1, "no_solution": 1}


def test_split(spark, tmp_path):
    rows = [problem(f"p{k:03d}", statement=f"S{k}") for k in range(100)]
    rows += [problem("dup-a", statement="  Add   two numbers. ", held=False), problem("dup-b", statement="add two NUMBERS."), problem("open", statement="o", held=False), problem("raw", statement="r", verified=False)]
    placed = split.split(table(spark, *rows))
    got = {r.id: r.split for r in placed.collect()}
    assert "dup-a" not in got and "raw" not in got and got["open"] == "train" and len(got) == 102
    found = {r.split: r for r in split.counts(placed).collect()}
    assert found["dev"].problems == 10 and found["test"].problems == 11 and found["train"].overlap == 0
    assert got == {r.id: r.split for r in split.split(table(spark, *rows).repartition(7)).collect()}
    seeded = {r.id: r.split for r in split.split(table(spark, *rows), seed=7, order="seeded").collect()}
    ids = sorted(k for k in seeded if k != "open")
    random.Random(7).shuffle(ids)
    n = len(ids)
    assert seeded == {"open": "train"} | {k: "train" if i < int(n * 0.8) else "dev" if i < int(n * 0.8) + int(n * 0.1) else "test" for i, k in enumerate(ids)}
    with pytest.raises(ValueError):
        split.seeded_ranks(placed.unionByName(placed))
    with pytest.raises(ValueError):
        split.assign(placed, order="other")
    split.write(placed, str(tmp_path / "s"), 42)
    assert spark.read.json(str(tmp_path / "s" / "_metadata") + "/part*").where("role = 'train'").first().problem_count == 81
    with pytest.raises(ValueError):
        split.validate_ratios(0.9, 0.2, 0.1)
    with pytest.raises(ValueError):
        split.write(placed.limit(0), str(tmp_path / "e"), 42)


def test_records(spark):
    rows = table(spark, problem(), problem("call", mode="callable", entry="add"), problem("raw", verified=False))
    sft = {r.id: r for r in records.sft(rows).collect()}
    assert set(sft) == {"sum", "call"} and sft["sum"].output == f"```python\n{SUM}\n```"
    assert sft["sum"].input == "Problem statement:\nAdd two numbers.\n\nInput format:\n\n\nOutput format:\n\n\nConstraints:\n- Not specified\n\nLanguage: Python 3\nTime limit: 5 seconds\nMemory limit: 256 MB\n\n\nVisible samples:\nInput:\n2 3\nExpected output:\n5"
    assert "Callable entry point: add\n" in sft["call"].input
    chat = records.chat_prompts(rows, min_reward_tests=1).where("problem_id = 'sum'").first()
    assert [m.role for m in chat.prompt] == ["system", "user"] and chat.prompt[1].content.endswith(records.CODE_OUTPUT_RULE)
    assert records.chat_prompts(rows).count() == 0
    assert {r.problem_id for r in records.chat_prompts(rows, min_reward_tests=1).collect()} == {"sum", "call"}
    order = ["call", "sum"]
    random.Random(3).shuffle(order)
    assert [r.problem_id for r in records.chat_prompts(rows, 1, 1, 3, order="seeded").collect()] == order[:1]
    with pytest.raises(ValueError):
        records.sft(rows, metadata={"role": "test"})
    hidden = rows.select(records.review_prompt(F.lit("P"), F.lit("C"), F.lit(1)).alias("x")).first().x
    assert "10 20" not in hidden and "30" not in hidden
    shown = rows.select(records.repair_prompt(F.lit("P"), F.lit("C"), F.struct(*(F.lit(f"<{n}>").alias(n) for n in ("kind", "test_id", "stdin", "expected", "actual", "stderr"))), F.lit(1)).alias("x")).first().x
    assert "Input:\n<stdin>\nExpected:\n<expected>" in shown


def test_reward(spark):
    problems = table(spark, problem(), problem("bare", rewarded=False), problem("words", code="print('YES')"))
    given = [("sum", 0, f"```python\n{SUM}\n```"), ("sum", 1, "```python\nimport sys\nsys.stdin.read()\nprint(1)\n```"), ("sum", 2, "no block"), ("sum", 3, "```python\nprint(5)\n```"), ("bare", 4, f"```python\n{SUM}\n```")]
    scored = reward.score(spark.createDataFrame(given, "problem_id string, completion_index int, completion string"), problems)
    got = {r.completion_index: r for r in scored.collect()}
    assert got[0].total == 1.0 and got[0].reasons == []
    assert got[1].total < 0.5 and got[2].total == -1.0 and got[2].reasons == ["missing_python_code_block"]
    assert "possible_sample_hardcode" in got[3].reasons and got[3].total < 0
    assert got[4].reward_tests == 0.0 and got[4].total < 0.5
    log = reward.log_rows(scored, 3, "r1")
    assert log.where("completion_index = 2").first().code_hash == ""
    with pytest.raises(ValueError):
        reward.score(spark.createDataFrame([("zz", 0, "x")], "problem_id string, completion_index int, completion string"), problems)
    report = reward.audit_report(reward.audit(problems)).first()
    assert reward.audit(problems, 0).count() == reward.audit(problems).count() > 0 and reward.audit(problems, 1).count() == 1
    assert report.problems == 2 and report.ordering_violations == 1  # the program that never reads its input


def test_summary_of_rewards(spark, tmp_path):
    rows = [(0, 0, "a", 1.0, 10, "h1", ["x"]), (0, 1, "a", 0.0, 20, "h2", ["x", "y"]), (1, 0, "b", 0.5, 30, "h2", []), (1, 1, "b", 0.5, 40, "", [])]
    log = spark.createDataFrame(rows, "reward_call long, completion_index int, problem_id string, total double, code_chars int, code_hash string, reasons array<string>")
    s = reward.summarize(log).first()
    assert (s.completions, s.groups, s.varying_reward_groups, s.zero_variance_group_rate, s.unique_code_hash_rate, s.fully_correct_rate) == (4, 2, 1, 0.5, 0.5, 0.25)
    assert s.reason_counts == {"x": 2, "y": 1} and s.code_chars.median == 25.0
    empty = reward.summarize(log.limit(0)).first()
    assert (empty.completions, empty.reward.mean, empty.zero_variance_group_rate, empty.unique_code_hash_rate) == (0, 0.0, 0.0, 0.0)
    log.write.json(str(tmp_path / "log"))
    stream = summary.start(summary.read(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream.awaitTermination(60)
    m = summary.merged(spark, str(tmp_path / "out")).first()
    assert (m.completions, m.groups, m.varying_reward_groups, m.mean_reward) == (4, 2, 1, 0.5)
    assert sum(r["count"] for r in summary.merged_reasons(spark, str(tmp_path / "out")).collect()) == log.select(F.explode("reasons")).count()
    assert REWARD_LOG


class ByStatement:
    """Answers by what the statement says, and otherwise after a repair."""

    def __init__(self, first, again):
        self.first, self.again = first, again

    def generate(self, prompts, seeds, n):
        codes = [next(codes for key, codes in (self.again if "Previous candidate" in p else self.first).items() if key in p) for p in prompts]
        return [[f"```python\n{c[k % len(c)]}\n```" for k in range(n)] for c in codes]


def solved(spark, first, again, config=solve.SolveConfig(), **problems):
    """Results by id, where the id is the statement."""
    rows = table(spark, *(problem(name, statement=f"<{name}>", **kwargs) for name, kwargs in problems.items()))
    return {r.problem_id: r for r in solve.solve(rows, lambda: ByStatement(first, again), config).collect()}


def test_solver(spark):
    wrong, partial = "print(int('7'))", "import sys\nd = sys.stdin.read()\nprint(5 if d.split()[0] == '2' else 0)"
    first = {"<repaired>": [wrong], "<reviewed>": [partial], "<unrewarded>": [partial], "<open>": [SUM]}
    r = solved(spark, first, {"<": [SUM]}, repaired={}, reviewed={}, unrewarded={"rewarded": False}, blind={"visible": False}, open={"held": False})
    assert (r["repaired"].status, r["repaired"].attempts, [a.context_type for a in r["repaired"].attempt_records]) == ("VERIFIED_SOLVED", 2, ["INITIAL_SOLVE", "VISIBLE_REPAIR"])
    assert [a.context_type for a in r["reviewed"].attempt_records] == ["INITIAL_SOLVE", "HIDDEN_REVIEW"] and r["reviewed"].status == "VERIFIED_SOLVED"
    assert (r["unrewarded"].status, r["unrewarded"].failure_reason, r["unrewarded"].attempts) == ("FAILED", "INTERNAL_EVAL_FAILED", 1)
    assert r["blind"].failure_reason == "MISSING_VISIBLE_TESTS" and r["open"].status == "VISIBLE_SOLVED"
    r = solved(spark, {"<": [partial, SUM]}, {}, solve.SolveConfig(candidates_per_turn=2, rerank_with_reward_tests=True, max_repair_turns=0), one={})["one"]
    assert (r.status, r.attempt_records[0].selected_index) == ("VERIFIED_SOLVED", 1)
    r = solved(spark, {"<second>": [wrong, SUM], "<never>": [partial]}, {"<": [partial]}, solve.SolveConfig(candidates_per_turn=2, max_repair_turns=1), second={}, never={})
    assert (r["second"].status, r["second"].attempt_records[0].selected_index) == ("VERIFIED_SOLVED", 1)
    assert (r["never"].status, r["never"].failure_reason, r["never"].attempt_records[-1].eval_result) == ("FAILED", "INTERNAL_REWARD_FAILED", None)


def test_compare_and_metrics(spark):
    good, bad = [("", [SUM])], [("", ["import sys\nsys.stdin.read()\nprint(0)"])]
    problems = table(spark, problem("a"), problem("b"))
    config = solve.SolveConfig(max_repair_turns=0)
    base = solve.solve(problems, lambda: solve.RuleGenerator(good), config)
    cand = solve.solve(problems.where("id = 'a'"), lambda: solve.RuleGenerator(bad), config)
    m = evaluate.metrics(base).first()
    assert (m.num_problems, m.verified_success_rate, m.initial_verified_success_rate, m.repair_gain, m.syntax_error_rate, m.avg_attempts) == (2, 1.0, 1.0, 0.0, 0.0, 1.0)
    assert evaluate.metrics(base.limit(0)).count() == 0
    pairs = evaluate.paired(base, cand)
    assert [tuple(r) for r in evaluate.transitions(pairs).collect()] == [("base_only_solved", 1)]
    assert [tuple(r) for r in evaluate.missing(base, cand).collect()] == [("base_only", "b")]
    assert {(r.side, r.reason) for r in evaluate.failure_reasons(pairs).collect()} == {("base", "SOLVED"), ("candidate", "WRONG_ANSWER")}
    r = evaluate.regressions(pairs).first()
    assert (r.problem_id, r.io_mode, r.base_code_chars) == ("a", "unknown", len(SUM))
    assert evaluate.by_io_mode(pairs).first().base_verified_success_rate == 1.0 and evaluate.code_lengths(pairs).count() == 2


def test_pack(spark):
    df = spark.createDataFrame([(list(range(20)), [100, 101, 102]), ([1, 2], [9]), ([1], []), ([1], list(range(11)))], "p array<int>, c array<int>")
    got = [r.x for r in df.select(pack.pack(F.col("p"), F.col("c"), 11).alias("x")).collect()]
    assert got[0].input_ids == [0, 1, 2, 3, 4, 5, 18, 19, 100, 101, 102] and got[0].labels == [-100] * 8 + [100, 101, 102] and got[0].attention_mask == [1] * 11
    assert got[1].input_ids == [1, 2, 9] and got[2] is None and got[3] is None
    rows = spark.createDataFrame([("i", "in", "```python\nx = 1\n```"), ("i", "in", "```python\n1 is 1\n```"), ("i", "in" * 50, "x"), ("i", "in", "y" * 90)], "instruction string, input string, output string")
    flagged = pack.flagged(rows, lambda: lambda t: [ord(c) for c in t], 0, lambda a, b: F.concat(a, F.lit(" "), b), 64, 16, 60, 1000)
    assert pack.preflight(flagged).first().asDict() == {"input_records": 4, "training_records": 1, "dropped_syntax_warnings": 1, "dropped_character_outliers": 1, "dropped_overlong_targets": 1}
    assert pack.run(flagged, 64).count() == 1


def test_audit(spark, tmp_path):
    problems = table(spark, problem("a"), problem("b", statement="other", code="print(1)"))
    line = lambda out: json.dumps({"instruction": "i", "input": "x", "output": out})
    (tmp_path / "ok.jsonl").write_text("\n".join([line("```python\nprint(1)\n```"), "", line("```python\nprint(2)\n```")]))
    good = audit.training_data(spark, problems, str(tmp_path / "ok.jsonl"), strict=True)
    assert good["failures"] == [] and good["dataset"]["duplicate_inputs"] == 1 and good["dataset"]["code_chars"]["max"] == 8
    (tmp_path / "bad.jsonl").write_text("\n".join(["{", line("no"), json.dumps({"instruction": 1, "input": "x", "output": "y"}), line("```python\nx =\n```"), "[1]"]))
    bad = audit.training_data(spark, problems, str(tmp_path / "bad.jsonl"))
    assert bad["dataset"]["malformed_json_records"] == 1 and bad["dataset"]["invalid_schema_records"] == 2 and bad["dataset"]["valid_code_block_records"] == 1
    assert bad["failures"] == ["invalid_code_block_format", "invalid_sft_python_syntax", "invalid_sft_schema", "malformed_sft_json", "problem_dataset_count_mismatch"]
    with pytest.raises(ValueError):
        audit.training_data(spark, problems, str(tmp_path / "bad.jsonl"), strict=True)
    values = list(range(10))
    s = audit.length_stats(spark.createDataFrame([(v,) for v in values], "n int"), F.col("n")).first()
    assert (s.min, s.median, s.p95, s.max) == (0, 4, 8, 9)


def test_sources(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"problem": {"id": "one", "statement": "s", "time_limit_sec": None}, "tests": {"visible_tests": [{"stdin": "1", "expected_stdout": "1"}]}, "oracle": {"solutions": [{"code": ""}, {"code": "c", "verified": True}]}}, indent=1))
    (folder / "_manifest.json").write_text("{}")
    rows = io.problems(spark, str(folder))
    r = rows.first()
    assert rows.count() == 1 and r.time_limit_sec == 2.0 and r.tests.visible_tests[0].id == "visible-0001" and r.tests.eval_tests == [] and [s.code for s in r.oracle.solutions] == ["c"]
    io.save_problems(rows, str(tmp_path / "out"))
    assert io.problems(spark, str(tmp_path / "out"), lines=True).first() == r
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{bad\n{"id": "b"}\n')
    assert [x.id for x in io.jsonl(spark, str(tmp_path / "x.jsonl"), "id string", "tolerant").collect()] == ["a", "b"]
    assert io.non_blank_lines(spark, str(tmp_path / "x.jsonl")) == 3
    assert io.jsonl(spark, str(tmp_path / "x.jsonl"), "id string", "counting").cache().where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        io.jsonl(spark, str(tmp_path / "x.jsonl"), "id string").collect()
    assert io.sidecar(spark, str(tmp_path / "none.json")) == {}
    for name in ("side.json", "_split.json"):
        io.save_sidecar(spark, str(tmp_path / name), {"role": "train"})
        assert io.sidecar(spark, str(tmp_path / name)) == {"role": "train"}
    assert io.copy_sidecars(spark, str(tmp_path), str(tmp_path / "next")) == ["_split.json"] and io.sidecar(spark, str(tmp_path / "next" / "_split.json")) == {"role": "train"}
    assert io.copy_sidecars(spark, str(tmp_path / "absent"), str(tmp_path / "next")) == []
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"problem_id": "a", "status": "FAILED", "attempts": 1}]}))
    assert io.report(spark, str(tmp_path / "r.json")).first().problem_id == "a"


def test_resume(spark, tmp_path):
    todo, done = spark.range(5), spark.range(2)
    assert resume.remaining(todo, done, "id").count() == 3
    with pytest.raises(ValueError):
        resume.require_none(resume.unknown(todo, done, "id"), "unknown")
    assert not resume.consistent_pair(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    (tmp_path / "a").write_text("x")
    with pytest.raises(ValueError):
        resume.consistent_pair(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="seed"):
        resume.same_run({"seed": 1, "x": 2}, {"seed": 2, "x": 2})
    with pytest.raises(ValueError):
        resume.require_role({"role": "train"}, "test")
    with pytest.raises(ValueError):
        resume.require_at_least(generations=(1, 2))
    assert resume.accepted_arguments(lambda a, b: 0, {"a": 1, "c": 2}) == {"a": 1}
