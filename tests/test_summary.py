import os
import random
import shutil
from datetime import datetime

from pyspark.sql import functions as F

from verdict.plans import catalog_problems
from verdict.streaming import summary

SCHEMA = "reward_call long, completion_index int, problem_id string, total double, code_chars int, code_hash string, reasons array<string>"


def rows_of(rng, n):
    return [(rng.randrange(3), k, f"p{rng.randrange(6)}", rng.choice([None, 0.0, 0.5, 0.5, 1.0]), 1, "h", rng.choice([None, [], ["a"], ["a", "b"]])) for k in range(n)]


def figures(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[2]), []).append(r[3] or 0.0)
    totals = [t for g in groups.values() for t in g]
    reasons = [x for r in rows for x in r[6] or []]
    return (len(rows), len(groups), sum(max(g) - min(g) > 1e-9 for g in groups.values()), round(sum(totals) / len(totals), 9), round(sum(t >= 0.999 for t in totals) / len(totals), 9)), {x: reasons.count(x) for x in set(reasons)}


def state(spark, out):
    m = summary.merged(spark, out).select("completions", "groups", "varying_reward_groups", F.round("mean_reward", 9), F.round("fully_correct_rate", 9)).first()
    return tuple(m), {r.reason: r["count"] for r in summary.merged_reasons(spark, out).collect()}


def test_batches_add_up_and_repeat(spark, tmp_path):
    """Every batch changes what it holds only; a batch that is repeated after a loss of its commit changes nothing."""
    rng, seen = random.Random(1), []
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    for n in (4, 7, 1):
        rows = rows_of(rng, n)
        seen += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(log)
        summary.start(summary.read(spark, log, 1), out, checkpoint).awaitTermination(120)
        assert state(spark, out) == figures(seen)
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    shutil.rmtree(f"{out}/summary/batch={last}")
    summary.start(summary.read(spark, log, 1), out, checkpoint).awaitTermination(120)
    assert state(spark, out) == figures(seen)


def test_groups_are_held_without_python(spark, tmp_path):
    """A batch of many groups takes no call of Python for each; groups that vary only across batches are told."""
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    seen = []
    for total in (0.0, 1.0, 1.0):
        rows = [(k % 7, 0, f"p{k}", total if k % 3 == 0 else 0.5, 1, "h", ["a"] if k % 2 else None) for k in range(600)]
        seen += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(log)
        query = summary.start(summary.read(spark, log, 1), out, checkpoint)
        query.awaitTermination(120)
        assert state(spark, out) == figures(seen)
        held = [s.operatorName for p in query.recentProgress for s in p.stateOperators]
        assert held and not any("Python" in name or "Pandas" in name for name in held)


def test_counts_of_reasons_add_up_and_repeat(spark, tmp_path):
    """Reasons alone: no state is kept, null lists and null reasons count as in SQL, and a batch that is repeated changes nothing."""
    rng, seen = random.Random(2), []
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    for n in (0, 4, 7, 1):
        rows = rows_of(rng, n) + [(1, 0, "p", 0.5, 1, "h", r) for r in (None, []) + (([None, "c"],) if n else ())]
        seen += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(log)
        query = summary.start_reasons(summary.read(spark, log, 1), out, checkpoint)
        query.awaitTermination(120)
        assert {r.reason: r["count"] for r in summary.merged_reasons(spark, out).collect()} == figures(seen)[1]
        assert query.recentProgress and not any(p.stateOperators for p in query.recentProgress)
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    shutil.rmtree(f"{out}/summary/batch={last}")
    summary.start_reasons(summary.read(spark, log, 1), out, checkpoint).awaitTermination(120)
    assert {r.reason: r["count"] for r in summary.merged_reasons(spark, out).collect()} == figures(seen)[1]


def test_q66_keeps_no_state(spark, tmp_path, monkeypatch):
    """The query of reasons opens no state store of groups, and its counts are those of the log."""
    monkeypatch.setattr(catalog_problems, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    events = [(k, datetime(2024, 1, 1 + k % 3), k % 5, ["click", "error"][k % 2], float(k % 70), '{"k": 1}') for k in range(210)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/sf/events.parquet")
    found = {r.reason: r["count"] for r in catalog_problems.q66_streamed_reasons(spark, f"{tmp_path}/sf").collect()}
    assert found == {"timeout": 60, "runtime_error": 90, "possible_sample_hardcode": 105}
    assert not [d for d, folders, _ in os.walk(tmp_path) if "state" in folders]
