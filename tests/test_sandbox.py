import os
import time

import pytest
from pyspark.sql import functions as F

from verdict.operators.execute import ExecConfig, dealt, run_suites
from verdict.operators.sandbox import Sandbox


@pytest.fixture
def sandbox():
    with Sandbox(1000) as s:
        yield s


def ran(sandbox, code, stdin=b"", seconds=5.0, entry="", **k):
    sandbox.load(code, entry)
    return sandbox.run(stdin, seconds, **k)


def test_programs_end_as_in_an_interpreter_of_their_own(sandbox):
    assert ran(sandbox, "import sys; sys.exit(3)").status == 3
    assert ran(sandbox, "import sys; sys.exit('bad')")[1:3] == (b"bad\n", 1)
    crash = ran(sandbox, "def f():\n    1 / 0\nf()")
    assert crash.status == 1 and crash.stderr.startswith(b"Traceback (most recent call last):\n  File \"") and crash.stderr.count(b"File") == 2 and b"ZeroDivisionError" in crash.stderr
    assert ran(sandbox, "import os; os.abort()").status == -6
    late = "import atexit, threading, time\natexit.register(print, 'exit')\nthreading.Thread(target=lambda: (time.sleep(.1), print('thread'))).start()\nprint('main')"
    assert ran(sandbox, late).stdout == b"main\nthread\nexit\n"
    assert ran(sandbox, "f = open(1, 'w', closefd=False)\nf.write('kept')").stdout == b"kept"
    told = ran(sandbox, "import os, pickle, sys\nclass A: pass\npickle.loads(pickle.dumps(A()))\nprint(__name__, len(sys.argv), os.getcwd() == os.environ['HOME'], sorted(os.environ)[:2], 'site' in sys.modules)")
    assert told.stdout == b"__main__ 1 True ['HOME', 'LANG'] True\n"
    assert ran(sandbox, "def f(a, b): return {'b': a, 'a': b}", b"[1, 2]", entry="f").stdout == b'{"a": 2, "b": 1}'


def test_limits_hold_before_the_program_starts(sandbox):
    assert ran(sandbox, "import resource as r\nprint(r.getrlimit(r.RLIMIT_AS)[0] >> 20, r.getrlimit(r.RLIMIT_CORE), r.getrlimit(r.RLIMIT_CPU)[0])", memory_mb=256).stdout == b"256 (0, 0) 15\n"
    assert b"MemoryError" in ran(sandbox, "x = bytearray(900 << 20)", memory_mb=256).stderr
    long = ran(sandbox, "print('x' * 5000)")
    assert long.truncated and len(long.stdout) == 1000 and long.status == 0
    slow = ran(sandbox, "print('b', flush=True)\nwhile True: pass", seconds=0.3)
    assert slow.status is None and slow.stdout == b"b\n"
    began = time.monotonic()
    assert ran(sandbox, "import os, time\nos.close(1); os.close(2)\ntime.sleep(60)", seconds=0.3).status is None and time.monotonic() - began < 5
    assert ran(sandbox, "print(1)", b"y" * 3_000_000).stdout == b"1\n"
    assert ran(sandbox, "import sys\nprint(len(sys.stdin.read()))", b"y" * 3_000_000).stdout == b"3000000\n"


def test_what_a_program_leaves_or_breaks(sandbox):
    left = ran(sandbox, "import subprocess, sys\np = subprocess.Popen([sys.executable, '-c', 'import time; time.sleep(60)'])\nprint(p.pid)")
    assert left.status == 0
    time.sleep(0.2)
    state = f"/proc/{int(left.stdout)}/stat"
    assert not os.path.exists(state) or open(state).read().rsplit(") ")[1][0] in "ZX"  # dead, if not yet reaped
    assert ran(sandbox, "import os, signal, time\nos.kill(os.getppid(), signal.SIGKILL)\ntime.sleep(60)", seconds=2.0).status in (None, -9)
    assert ran(sandbox, "print(2)").stdout == b"2\n"  # by a new server


def test_equal_runs_happen_once(spark, tmp_path):
    """Programs that write down that they ran: one line per program, input and limit that differ."""
    log = tmp_path / "log"
    code = f"x = input()\nopen({str(log)!r}, 'a').write(x + chr(10))\nprint(x)"
    case = lambda x, t=None: (x, x, "c", t)
    rows = [(k, code if k % 2 else None, [case("a"), case("b"), case("a"), case("a", 3.0)]) for k in range(20)] + [(99, "x =", [case("a")]), (100, code, [])]
    df = spark.createDataFrame(rows, "k int, code string, tests array<struct<stdin:string,expected_stdout:string,id:string,timeout_sec:double>>").repartition(5)
    suites = {name: (F.col("code"), F.col("tests"), name) for name in ("one", "two")}
    got = {r.k: r for r in run_suites(df, suites, F.lit(5.0), F.lit("")).collect()}
    assert sorted(log.read_text().split()) == ["a", "a", "b"]
    assert len(got) == 22 and got[2].one is None and got[3].one.runs[0].suite == "one" and got[3].two.runs[3].suite == "two"
    assert [r.actual for r in got[3].one.runs] == ["a", "b", "a", "a"] and all(r.passed for r in got[3].two.runs)
    assert not got[99].one.syntax_valid and got[99].one.runs == [] and got[100].one.syntax_valid and got[100].one.runs == []


def test_tasks_get_equal_shares_of_time(spark):
    runs = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("run"), F.when(F.col("id") % 50 == 0, 10.0).otherwise(0.5).alias("seconds"))
    placed, tasks = dealt(runs, 8)
    loads = sorted(r.n for r in placed.groupBy("task").agg(F.sum("seconds").alias("n")).collect())
    assert dealt(runs.limit(3), 8)[1] == 3 and dealt(runs.limit(0), 8)[1] == 1
    assert len(loads) == tasks == 8 and loads[-1] < 2 * loads[4] and loads[0] > loads[4] / 2


def test_limits_in_reports(spark):
    codes = {"slow": "while True: pass", "long": "print('x' * 5000)", "big": "x = bytearray(900 << 20)", "good": "print(1)"}
    df = spark.createDataFrame([(k, v, [("", "1", "c", 0.4 if k == "slow" else None)]) for k, v in codes.items()], "k string, code string, tests array<struct<stdin:string,expected_stdout:string,id:string,timeout_sec:double>>")
    config = ExecConfig(max_output_bytes=1000, memory_limit=True, tasks=2)
    got = {r.k: r.report.runs[0] for r in run_suites(df, {"report": (F.col("code"), F.col("tests"), "s")}, F.lit(None), F.lit(None), F.lit(256), config).collect()}
    assert (got["slow"].timed_out, got["slow"].returncode, got["slow"].passed) == (True, None, False)
    assert (got["long"].output_truncated, got["long"].passed, len(got["long"].actual)) == (True, False, 1000)
    assert got["big"].returncode == 1 and "MemoryError" in got["big"].stderr and got["good"].passed
