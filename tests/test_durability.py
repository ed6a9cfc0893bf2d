import os
import signal
import subprocess
import sys
import time

from tests.test_operators import SUM, problem, table
from verdict.operators import solve
from verdict.sources import io
from verdict.streaming import solving

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: A run of its own, to be killed: notes each prompt that it answers, slowly.
RUN = """
import sys, time
from pyspark.sql import SparkSession
from tests.test_durability import Noting
from verdict.operators.solve import SolveConfig
from verdict.streaming import solving
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
folder = sys.argv[1]
solving.start(solving.read(spark, folder + "/problems"), lambda: Noting(folder + "/log", 0.3), folder + "/results", folder + "/checkpoint", SolveConfig(max_repair_turns=1)).awaitTermination()
"""


class Noting:
    """Answers rightly, but for problems whose statement asks for a second try; writes down what it was asked."""

    def __init__(self, path, seconds=0.0):
        self.path, self.seconds = path, seconds

    def generate(self, prompts, seeds, n):
        for prompt in prompts:
            time.sleep(self.seconds)
            with open(self.path, "a") as f:
                f.write(prompt.split("Problem statement:\n")[1].split("\n")[0] + "\n")
        return [[f"```python\n{SUM if 'twice' not in p or 'Previous candidate' in p else 'print(0)'}\n```"] * n for p in prompts]


def stored(spark, folder):
    if not io.exists(spark, f"{folder}/results"):
        return {}
    rows = solve.stored(spark, f"{folder}/results").select("problem_id", "status", "attempts").collect()
    found = {r.problem_id: (r.status, r.attempts) for r in rows}
    assert len(found) == len(rows)  # each problem once
    return found


def test_killed_run_repeats_no_stored_problem(spark, tmp_path):
    folder = str(tmp_path)
    names = [f"p{k:02d}" for k in range(24)]
    problems = table(spark, *(problem(n, statement=f"{n}{' twice' if k % 3 == 0 else ''}") for k, n in enumerate(names)))
    io.save_problems(problems.repartition(3), f"{folder}/problems")
    env = os.environ | {"PYTHONPATH": HERE + ":" + os.environ.get("PYTHONPATH", "")}
    run = subprocess.Popen([sys.executable, "-c", RUN, folder], env=env, cwd=HERE, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    deadline, before = time.time() + 120, {}
    # Killed when the first turn of a batch is stored and its second is not.
    while time.time() < deadline and run.poll() is None and not before:
        time.sleep(0.1)
        try:
            before = stored(spark, folder)
        except Exception:  # the table is being made
            continue
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    before = stored(spark, folder)
    assert before and len(before) < len(names)
    asked = (tmp_path / "log").read_text().split("\n")
    stream = solving.start(solving.read(spark, f"{folder}/problems"), lambda: Noting(f"{folder}/again"), f"{folder}/results", f"{folder}/checkpoint", solve.SolveConfig(max_repair_turns=1))
    stream.awaitTermination(120)
    again = {line.split(" ")[0] for line in (tmp_path / "again").read_text().split("\n") if line}
    assert not again & set(before) and again | set(before) == set(names) and asked
    assert stored(spark, folder) == {n: ("VERIFIED_SOLVED", 2 if k % 3 == 0 else 1) for k, n in enumerate(names)}
    # Nothing is left to do, and later files are taken by the next run.
    io.save_problems(table(spark, problem("late", statement="late")), f"{folder}/problems", "append")
    solving.start(solving.read(spark, f"{folder}/problems"), lambda: Noting(f"{folder}/later"), f"{folder}/results", f"{folder}/checkpoint").awaitTermination(120)
    assert (tmp_path / "later").read_text() == "late\n" and len(stored(spark, folder)) == len(names) + 1


def test_batches_are_stored_turn_by_turn(spark, tmp_path):
    rows = table(spark, *(problem(f"p{k}", statement=f"p{k}{' twice' if k == 2 else ''}") for k in range(4)))
    folder = str(tmp_path)
    given = iter(solve.turns(rows, lambda: Noting(f"{folder}/log"), solve.SolveConfig(max_repair_turns=1)))
    assert next(given).count() == 0 and next(given).count() == 3 and next(given).count() == 1 and next(given).count() == 0
    done = solve.resumed(rows, lambda: Noting(f"{folder}/one"), f"{folder}/results", batches=3)
    assert done.count() == 4
    solve.resumed(rows, lambda: Noting(f"{folder}/two"), f"{folder}/results", batches=2)
    assert not os.path.exists(f"{folder}/two")
