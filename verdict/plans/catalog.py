"""The queries of this engine on the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions import reports as R
from verdict.functions import text as T
from verdict.operators import audit, evaluate, pack, resume, reward, solve, split
from verdict.operators.records import INSTRUCTION, SYSTEM_PROMPT, fenced, initial_prompt
from verdict.operators.seeded import seeded_ranks
from verdict.plans import catalog_problems
from verdict.plans.tables import EXCHANGE_SQL, LOG_SQL, REPORT_SQL, candidates, exchanges, reports, reward_log, run_of_line, table
from verdict.sources.checkpoint import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folded_sql(text: str) -> str:
    """Full case folding, a character at a time."""
    single, folded, several = T.folds()
    for char, other in several.items():
        text = f"replace({text}, '{char}', '{other}')"
    return f"translate({text}, '{single}', '{folded}')"


FOLDED = _folded_sql(r"trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f]+', ' ', 'g'))")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _documents(spark, sf_dir).join(labels, "doc_id")


@query(f"SELECT doc_id, sha256(CASE WHEN {FOLDED} = '' THEN 'id:' || doc_id ELSE lang || '||' || {FOLDED} END) AS key_hash FROM documents")
def q01_doc_canonical_key(spark, sf_dir):
    key = T.canonical_key(F.col("text"), F.col("lang"), F.lit(""), F.col("id"))
    return _documents(spark, sf_dir).select("doc_id", F.sha2(key, 256).alias("key_hash"))


@query(f"""SELECT doc_id, lang, n_chars, best FROM (
  SELECT doc_id, lang, n_chars, coalesce(quality = 1, false)::INT AS best,
    row_number() OVER (PARTITION BY lang, {FOLDED} ORDER BY coalesce(quality = 1, false)::INT DESC, n_chars DESC, doc_id DESC) AS r
  FROM documents LEFT JOIN labels USING (doc_id)) WHERE r = 1""")
def q02_dedupe_equivalent(spark, sf_dir):
    docs = _documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.withColumn("best", F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int"))
    key = F.sha2(T.canonical_key(F.col("text"), F.col("lang"), F.lit(""), F.col("id")), 256)
    slim = docs.select("doc_id", "lang", "n_chars", "best", key.alias("key"))
    return split.keep_best(slim, F.col("key"), F.col("best"), F.col("n_chars"), F.col("doc_id")).drop("key")


@query("""SELECT 'documents' AS source_table, count(*) AS records, count(CASE WHEN text <> '' THEN 1 END) - count(DISTINCT CASE WHEN text <> '' THEN text END) AS duplicates FROM documents
UNION ALL SELECT 'conversations', count(*), count(CASE WHEN text <> '' THEN 1 END) - count(DISTINCT CASE WHEN text <> '' THEN text END) FROM conversations""")
def q03_duplicate_counts(spark, sf_dir):
    # Texts are hashed before they are shuffled; 256 bits keep the count exact.
    def one(name):
        hashed = F.when(F.col("text") != "", F.sha2("text", 256))
        return table(spark, sf_dir, name).select(hashed.alias("h")).agg(F.lit(name).alias("source_table"), F.count("*").alias("records"), audit.duplicates(F.col("h")).alias("duplicates"))

    return one("documents").unionByName(one("conversations"))


@query("SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def q04_verified_filter(spark, sf_dir):
    return _verified(spark, sf_dir).select("doc_id", "lang", "source")


SPLIT_SQL = """
chosen AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
placed AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id::VARCHAR) - 1 AS r, count(*) OVER () AS n FROM chosen),
assigned AS (SELECT doc_id, lang, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM placed)
"""


@query("WITH " + SPLIT_SQL + "SELECT doc_id, split FROM assigned")
def q05_split_assign(spark, sf_dir):
    return split.assign(_verified(spark, sf_dir).select("doc_id", "id")).select("doc_id", "split")


@query("WITH " + SPLIT_SQL + "SELECT split, count(*) AS problems, count(DISTINCT doc_id) AS ids, (SELECT count(*) FROM (SELECT doc_id FROM assigned GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS overlap FROM assigned GROUP BY split")
def q06_split_counts_overlap(spark, sf_dir):
    return split.counts(split.assign(_verified(spark, sf_dir).select("doc_id", "id")))


@query("SELECT sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS fingerprint FROM documents")
def q07_id_fingerprint(spark, sf_dir):
    return split.fingerprint(_documents(spark, sf_dir))


#: Python's generator in SQL, from its state after seeding: words by their recurrence, 227 at a time; then the shuffle, a
#: draw a step, of which each is a word or is drawn again. Places are listed in order of the sorted ids.
_STATE = ", ".join(map(str, random.Random(42).getstate()[1][:-1]))
SEEDED_SQL = f"""RECURSIVE
sorted AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id::VARCHAR) AS k FROM documents),
total AS (SELECT count(*)::BIGINT AS n FROM documents),
blocks(b, x) AS (
  SELECT 0, [{_STATE}]::BIGINT[]
  UNION ALL SELECT b + 1, list_concat(x[228:], [xor(xor(x[t + 397], ((x[t] & 2147483648) | (x[t + 1] & 2147483647)) >> 1), (x[t + 1] & 1) * 2567483615) FOR t IN range(1, 228)])
  FROM blocks, total WHERE b < 2 + n * 3 // 227),
fresh AS (SELECT (b - 1) * 227 + t AS pos, x[397 + t] AS y FROM blocks, range(1, 228) AS r(t) WHERE b > 0),
stirred AS (SELECT pos, xor(y, y >> 11) AS y FROM fresh),
twice AS (SELECT pos, xor(y, (y << 7) & 2636928640) AS y FROM stirred),
thrice AS (SELECT pos, xor(y, (y << 15) & 4022730752) AS y FROM twice),
words AS (SELECT list(xor(y, y >> 18) ORDER BY pos) AS w FROM thrice),
walk(i, pos, places) AS (
  SELECT n - 1, 1::BIGINT, range(1, n + 1) FROM total
  UNION ALL
  SELECT CASE WHEN j <= i THEN i - 1 ELSE i END, pos + 1, CASE WHEN j <= i THEN [CASE q WHEN i + 1 THEN places[j + 1] WHEN j + 1 THEN places[i + 1] ELSE places[q] END FOR q IN range(1, len(places) + 1)] ELSE places END
  FROM (SELECT i, pos, places, w[pos] >> (32 - length(bin(i + 1))) AS j FROM walk, words WHERE i > 0)),
shuffled AS (SELECT unnest(places) AS k, unnest(range(0, len(places))) AS place FROM walk WHERE i <= 0)
"""


@query("WITH " + SEEDED_SQL + "SELECT doc_id, place, CASE WHEN place < floor(n * 0.8::DOUBLE) THEN 'train' WHEN place < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM shuffled JOIN sorted USING (k), total")
def q67_seeded_split(spark, sf_dir):
    """Documents in the order that Python's generator shuffles their sorted ids into, and the split by it."""
    docs = _documents(spark, sf_dir).select("doc_id", "id")
    places = seeded_ranks(docs, "id", 42, "place")
    return places.join(split.assign(docs, seed=42, order="seeded").select("doc_id", "split"), "doc_id").select("doc_id", "place", "split")


@query("SELECT doc_id, CAST((42 + CAST('0x' || substr(sha256(doc_id::VARCHAR), 1, 8) AS BIGINT)) % 2147483648 AS BIGINT) AS seed FROM documents")
def q08_problem_seed(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.problem_seed(42, F.col("id")).alias("seed"))


STATS_SQL = "count(*) AS records, min(length(text)) AS min, CAST(floor(median(length(text))) AS BIGINT) AS median, list_sort(list(length(text)))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS INT) + 1] AS p95, max(length(text)) AS max"


@query(f"SELECT {STATS_SQL} FROM documents")
def q09_length_stats(spark, sf_dir):
    return audit.length_stats(table(spark, sf_dir, "documents"), F.length("text"))


@query(f"SELECT lang, {STATS_SQL} FROM documents GROUP BY lang")
def q10_length_stats_by_lang(spark, sf_dir):
    return audit.length_stats(table(spark, sf_dir, "documents"), F.length("text"), "lang")


@query("WITH " + LOG_SQL + """SELECT count(*) AS completions, min(total) AS reward_min, median(total) AS reward_median, round(avg(total), 4) AS reward_mean, max(total) AS reward_max,
  min(code_chars)::DOUBLE AS chars_min, median(code_chars)::DOUBLE AS chars_median, max(code_chars)::DOUBLE AS chars_max, round(avg((total >= 0.999)::INT), 6) AS fully_correct_rate,
  round(count(DISTINCT code_hash) / count(*), 6) AS unique_code_hash_rate FROM log""")
def q11_reward_summary(spark, sf_dir):
    s = reward.summarize(reward_log(spark, sf_dir))
    return s.select("completions", *(F.col(f"reward.{k}").alias(f"reward_{k}") for k in ("min", "median", "max")), F.round("reward.mean", 4).alias("reward_mean"), *(F.col(f"code_chars.{k}").alias(f"chars_{k}") for k in ("min", "median", "max")), F.round("fully_correct_rate", 6).alias("fully_correct_rate"), F.round("unique_code_hash_rate", 6).alias("unique_code_hash_rate"))


@query("WITH " + LOG_SQL + ", g AS (SELECT max(total) - min(total) > 1e-9 AS varying FROM log GROUP BY reward_call, problem_id) SELECT count(*) AS groups, CAST(sum(varying::INT) AS BIGINT) AS varying_reward_groups, round(1 - sum(varying::INT) / count(*), 6) AS zero_variance_group_rate FROM g")
def q12_reward_group_variance(spark, sf_dir):
    return reward.group_variance(reward_log(spark, sf_dir)).select("groups", "varying_reward_groups", F.round("zero_variance_group_rate", 6).alias("zero_variance_group_rate"))


@query("WITH " + LOG_SQL + "SELECT reason, count(*) AS count FROM (SELECT unnest(reasons) AS reason FROM log) GROUP BY reason")
def q13_reason_histogram(spark, sf_dir):
    return reward.reason_counts(reward_log(spark, sf_dir))


@query("WITH " + REPORT_SQL + """SELECT o_orderkey, round(CASE WHEN valid THEN 0.05::DOUBLE ELSE 0 END + 0.15::DOUBLE * v_rate + CASE WHEN rn > 0 THEN 0.6::DOUBLE * r_rate ELSE 0 END
  + CASE WHEN v_all AND rn > 0 AND r_all THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN NOT valid THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN t THEN 0.6::DOUBLE ELSE 0 END - CASE WHEN r THEN 0.3::DOUBLE ELSE 0 END
  - CASE WHEN o_orderstatus = 'P' THEN 0.6::DOUBLE ELSE 0 END - CASE WHEN c THEN 0.5::DOUBLE ELSE 0 END, 5) + 0.0::DOUBLE AS total,
  (NOT valid)::INT + t::INT + r::INT + (o_orderstatus = 'P')::INT + c::INT AS n_reasons FROM scored""")
def q14_reward_formula(spark, sf_dir):
    p = R.reward(F.col("visible"), F.col("tested"), F.col("o_orderstatus") == "P")
    return reports(spark, sf_dir).withColumn("p", p).select("o_orderkey", (F.round("p.total", 5) + F.lit(0.0)).alias("total"), F.size("p.reasons").alias("n_reasons"))


@query("WITH " + REPORT_SQL + "SELECT o_orderkey, n AS n_runs, all_passed, rate AS pass_rate FROM scored")
def q15_run_reports(spark, sf_dir):
    r = F.col("report")
    return reports(spark, sf_dir).select("o_orderkey", F.size("report.runs").cast("long").alias("n_runs"), R.all_passed(r).alias("all_passed"), R.pass_rate(r).alias("pass_rate"))


@query("WITH " + REPORT_SQL + "SELECT o_orderkey, round(score, 6) AS score FROM scored")
def q16_candidate_score(spark, sf_dir):
    return reports(spark, sf_dir).select("o_orderkey", F.round(R.candidate_score(F.col("report")), 6).alias("score"))


def _gathered(spark, sf_dir):
    rows = candidates(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", F.struct("o_orderkey", "o_orderstatus", "report", "visible", "tested").alias("o")))).alias("all"))
    made = F.transform("all", lambda x: F.struct(x["o"]["o_orderkey"].cast("string").alias("code"), x["o"]["visible"].alias("visible_result"), R.candidate_score(x["o"]["report"]).alias("score")))
    return rows.select("o_custkey", made.alias("candidates"), F.transform("all", lambda x: x["o"]["tested"]).alias("tested"), "all")


@query("WITH " + REPORT_SQL + "SELECT o_custkey, CAST(k AS INT) AS selected_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, k) AS place FROM scored) WHERE place = 1")
def q17_best_of_n(spark, sf_dir):
    rows = _gathered(spark, sf_dir).withColumn("selected_index", solve.best_candidate(F.col("candidates")))
    return rows.select("o_custkey", "selected_index", F.round(F.get("candidates", F.col("selected_index"))["score"], 6).alias("score"))


@query("WITH " + REPORT_SQL + """, best AS (SELECT o_custkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, k) AS place FROM scored) WHERE place = 1),
again AS (SELECT o_custkey, k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r_all::INT DESC, r_rate DESC, score DESC, k) AS place FROM scored WHERE v_all) WHERE place = 1)
SELECT o_custkey, CAST(coalesce(a.k, b.k) AS INT) AS selected_index, a.k IS NOT NULL AS reranked FROM best b LEFT JOIN again a USING (o_custkey)""")
def q18_reward_rerank(spark, sf_dir):
    rows = _gathered(spark, sf_dir)
    able = F.exists("candidates", lambda c: R.all_passed(c["visible_result"]))
    return rows.select("o_custkey", solve.rerank(F.col("candidates"), F.col("tested"), solve.best_candidate(F.col("candidates"))).cast("int").alias("selected_index"), able.alias("reranked"))


def _results(spark, sf_dir):
    """A result per customer: each order is an attempt with one candidate; finished orders carry an evaluation."""
    rows = _gathered(spark, sf_dir)
    record = F.transform("all", lambda x: F.struct(
        (x["k"] + 1).alias("turn"), F.lit("INITIAL_SOLVE").alias("context_type"),
        F.array(F.struct(x["o"]["o_orderkey"].cast("string").alias("code"), x["o"]["visible"].alias("visible_result"), R.candidate_score(x["o"]["report"]).alias("score"))).alias("candidates"),
        F.lit(0).alias("selected_index"), x["o"]["tested"].alias("reward_result"), F.when(x["o"]["o_orderstatus"] == "F", x["o"]["report"]).alias("eval_result"),
    ))
    rows = rows.select(F.col("o_custkey").cast("string").alias("problem_id"), record.alias("attempt_records"))
    last = evaluate.last_record(F.col("attempt_records"))
    done = last["eval_result"].isNotNull() & R.all_passed(last["eval_result"])
    return rows.select("problem_id", F.when(done, "VERIFIED_SOLVED").otherwise("FAILED").alias("status"), F.size("attempt_records").alias("attempts"), F.when(~done, R.final_failure(F.col("attempt_records"))).alias("failure_reason"), "attempt_records")


@query("WITH " + REPORT_SQL + """, ends AS (SELECT *, k = 0 AS first, k = max(k) OVER (PARTITION BY o_custkey) AS last, count(*) OVER (PARTITION BY o_custkey) AS attempts, o_orderstatus = 'F' AS finished FROM scored),
sides AS (SELECT o_custkey, max(attempts) AS attempts, bool_or(first AND v_all) AS iv, bool_or(first AND finished AND all_passed) AS ie, bool_or(last AND v_all) AS fv, bool_or(last AND finished AND all_passed) AS ok,
  max(CASE WHEN last THEN v_rate END) AS vr_, max(CASE WHEN last THEN r_rate END) AS rr_, max(CASE WHEN last THEN CASE WHEN finished THEN rate ELSE 0 END END) AS er_,
  bool_or(last AND NOT valid) AS bad, bool_or(last AND vr AND NOT vt) OR bool_or(last AND vr) AS crash, bool_or(last AND vt) AS slow FROM ends GROUP BY o_custkey)
SELECT count(*) AS num_problems, round(avg(iv::INT), 6) AS initial_visible_success_rate, round(avg(iv::INT), 6) AS initial_candidate_visible_pass_at_k, round(avg(ie::INT), 6) AS initial_verified_success_rate,
  round(avg(fv::INT), 6) AS final_visible_success_rate, round(avg(ok::INT), 6) AS verified_success_rate, round(avg(vr_), 6) AS visible_test_pass_rate, round(avg(rr_), 6) AS reward_test_pass_rate, round(avg(er_), 6) AS eval_test_pass_rate,
  round(avg(attempts), 6) AS avg_attempts, round(avg(bad::INT), 6) AS syntax_error_rate, round(avg(crash::INT), 6) AS runtime_error_rate, round(avg(slow::INT), 6) AS timeout_rate, round(avg(ok::INT) - avg(ie::INT), 6) AS repair_gain FROM sides""")
def q19_eval_metrics(spark, sf_dir):
    m = evaluate.metrics(_results(spark, sf_dir))
    return m.select("num_problems", *(F.round(c, 6).alias(c) for c in m.columns if c != "num_problems"))


def _side(spark, sf_dir, status):
    """One result per customer from its orders of a status, the last of them winning."""
    rows = evaluate.last_wins(reports(spark, sf_dir).where(F.col("o_orderstatus") == status), "o_custkey", "o_orderkey")
    record = F.struct(F.lit(1).alias("turn"), F.array(F.struct(F.concat(F.lit("code "), F.col("o_orderkey").cast("string")).alias("code"), F.col("report").alias("visible_result"))).alias("candidates"), F.lit(0).alias("selected_index"))
    reason = F.when(~R.all_passed(F.col("report")), R.failure_kind(F.col("report")))
    return rows.select(F.col("o_custkey").cast("string").alias("problem_id"), F.when(R.all_passed(F.col("report")), "VERIFIED_SOLVED").otherwise("FAILED").alias("status"), reason.alias("failure_reason"), F.array(record).alias("attempt_records"))


def _pairs(spark, sf_dir):
    modes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("problem_id"), F.col("c_mktsegment").alias("io_mode"))
    return evaluate.paired(_side(spark, sf_dir, "F"), _side(spark, sf_dir, "O"), modes)


PAIR_SQL = REPORT_SQL + """,
failing AS (SELECT l_orderkey, arg_min(CASE WHEN timed_out THEN 'TIMEOUT' WHEN truncated THEN 'OUTPUT_TOO_LONG' WHEN returncode <> 0 THEN 'RUNTIME_ERROR' ELSE 'WRONG_ANSWER' END, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}) AS kind FROM lines WHERE NOT passed GROUP BY l_orderkey),
last_of AS (SELECT s.o_custkey::VARCHAR AS problem_id, o_orderstatus, o_orderkey, all_passed, rate, CASE WHEN all_passed THEN 'SOLVED' WHEN NOT valid THEN 'SYNTAX_ERROR' ELSE kind END AS reason,
  row_number() OVER (PARTITION BY s.o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS place FROM scored s LEFT JOIN failing f ON f.l_orderkey = s.o_orderkey),
base AS (SELECT * FROM last_of WHERE o_orderstatus = 'F' AND place = 1),
cand AS (SELECT * FROM last_of WHERE o_orderstatus = 'O' AND place = 1),
pairs AS (SELECT b.problem_id, b.all_passed AS bs, c.all_passed AS cs, b.reason AS br, c.reason AS cr, 'code ' || b.o_orderkey AS bc, 'code ' || c.o_orderkey AS cc, c.rate AS crate, coalesce(c_mktsegment, 'unknown') AS io_mode
  FROM base b JOIN cand c USING (problem_id) LEFT JOIN customer ON c_custkey::VARCHAR = b.problem_id)
"""


@query("WITH " + PAIR_SQL + "SELECT io_mode, count(*) AS problems, CAST(sum(bs::INT) AS BIGINT) AS base_solved, CAST(sum(cs::INT) AS BIGINT) AS candidate_solved, round(avg(bs::INT), 6) AS base_verified_success_rate, round(avg(cs::INT), 6) AS candidate_verified_success_rate FROM pairs GROUP BY io_mode")
def q20_paired_compare(spark, sf_dir):
    rows = evaluate.by_io_mode(_pairs(spark, sf_dir))
    return rows.select(*(F.round(c, 6).alias(c) if c.endswith("rate") else F.col(c) for c in rows.columns))


@query("WITH " + PAIR_SQL + "SELECT CASE WHEN bs AND cs THEN 'both_solved' WHEN bs THEN 'base_only_solved' WHEN cs THEN 'candidate_only_solved' ELSE 'neither_solved' END AS transition, count(*) AS count FROM pairs GROUP BY 1")
def q20_transitions(spark, sf_dir):
    return evaluate.transitions(_pairs(spark, sf_dir))


@query("WITH " + PAIR_SQL + "SELECT 'base' AS side, br AS reason, count(*) AS count FROM pairs GROUP BY 2 UNION ALL SELECT 'candidate', cr, count(*) FROM pairs GROUP BY 2")
def q20_failure_reasons(spark, sf_dir):
    return evaluate.failure_reasons(_pairs(spark, sf_dir))


@query("WITH " + PAIR_SQL + "SELECT 'base_only' AS side, problem_id FROM base WHERE problem_id NOT IN (SELECT problem_id FROM cand) UNION ALL SELECT 'candidate_only', problem_id FROM cand WHERE problem_id NOT IN (SELECT problem_id FROM base)")
def q21_missing_both_sides(spark, sf_dir):
    return evaluate.missing(_side(spark, sf_dir, "F"), _side(spark, sf_dir, "O"))


@query("WITH " + PAIR_SQL + "SELECT problem_id, io_mode, cr AS candidate_failure_reason, length(bc) AS base_code_chars, length(cc) AS candidate_code_chars, crate AS candidate_visible_pass_rate, bc AS base_code_preview, cc AS candidate_code_preview FROM pairs WHERE bs AND NOT cs ORDER BY problem_id LIMIT 10")
def q22_regression_examples(spark, sf_dir):
    return evaluate.regressions(_pairs(spark, sf_dir))


@query("WITH " + EXCHANGE_SQL + f"SELECT conv_id, turn, '{INSTRUCTION}' AS instruction, question AS input, '```python' || chr(10) || answer || chr(10) || '```' AS output FROM exchanges")
def q23_sft_records(spark, sf_dir):
    return exchanges(spark, sf_dir).select("conv_id", "turn", F.lit(INSTRUCTION).alias("instruction"), F.col("question").alias("input"), fenced(F.col("answer")).alias("output"))


@query("WITH " + EXCHANGE_SQL + f"""SELECT conv_id, turn, r.role AS role, r.content AS content FROM (SELECT conv_id, turn, unnest([{{'role': 'system', 'content': '{SYSTEM_PROMPT}'}},
  {{'role': 'user', 'content': question || chr(10) || chr(10) || 'Return exactly one Python code block and no explanation:' || chr(10) || '```python' || chr(10) || '# complete solution' || chr(10) || '```'}}]) AS r FROM exchanges)""")
def q24_chat_prompts(spark, sf_dir):
    prompt = F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), initial_prompt(F.col("question")).alias("content")))
    return exchanges(spark, sf_dir).select("conv_id", "turn", F.explode(prompt).alias("r")).select("conv_id", "turn", "r.*")


#: A text around a code block, by turn: marked python or py, in other cases, or not marked.
WRAPPED_SQL = "'See ' || role || chr(10) || '```' || CASE turn % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'Py' ELSE 'text' END || chr(10) || '  ' || coalesce(text, '') || ' ' || chr(10) || '```' || ' end'"


def _wrapped(spark, sf_dir):
    mark = F.when(F.col("turn") % 3 == 0, "python").when(F.col("turn") % 3 == 1, "Py").otherwise("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit("See "), "role", F.lit("\n```"), mark, F.lit("\n  "), F.coalesce("text", F.lit("")), F.lit(" \n``` end")).alias("wrapped"))


@query(rf"SELECT conv_id, turn, role, regexp_replace(regexp_extract({WRAPPED_SQL}, '(?is)```(?:python|py)[\s\x0b\x1c-\x1f]*(.*?)```', 1), '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') AS code FROM conversations")
def q25_code_extract(spark, sf_dir):
    return _wrapped(spark, sf_dir).select("conv_id", "turn", "role", T.extract_python_code(F.col("wrapped")).alias("code"))


FENCED_SQL = "CASE turn % 2 WHEN 0 THEN '' ELSE 'x ' END || '```python' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10)"


@query(rf"""WITH f AS (SELECT conv_id, turn, role, regexp_replace({FENCED_SQL}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, role, regexp_full_match(t, '(?s)```python[\s\x0b\x1c-\x1f]*\n(.*)\n```[\s\x0b\x1c-\x1f]*') AS strict, CASE WHEN regexp_full_match(t, '(?s)```python[\s\x0b\x1c-\x1f]*\n(.*)\n```[\s\x0b\x1c-\x1f]*') THEN length(regexp_extract(t, '(?s)^```python[\s\x0b\x1c-\x1f]*\n(.*)\n```[\s\x0b\x1c-\x1f]*$', 1)) ELSE -1 END AS code_chars FROM f""")
def q26_fence_audit(spark, sf_dir):
    text = F.concat(F.when(F.col("turn") % 2 == 0, "").otherwise("x "), F.lit("```python\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.is_fenced(text).alias("strict"), F.coalesce(F.length(T.fenced_code(text)), F.lit(-1)).alias("code_chars"))


@query("""WITH ids AS (SELECT doc_id, [length(w) FOR w IN string_split(coalesce(text, ''), ' ')] AS p, [length(w) + 1000 FOR w IN string_split(lang || ' ' || source, ' ')] AS c FROM documents),
cut AS (SELECT *, 64 - len(c) AS room FROM ids),
parts AS (SELECT *, greatest(1, CAST(floor(room * 0.75::DOUBLE) AS INT)) AS head FROM cut),
kept AS (SELECT doc_id, c, CASE WHEN len(p) > room THEN p[:head] || p[len(p) - (room - head) + 1:] ELSE p END AS k FROM parts)
SELECT doc_id, len(k) + len(c) AS n_tokens, array_to_string(k || c, ',') AS input_ids, array_to_string([-100 FOR x IN k] || c, ',') AS labels FROM kept""")
def q27_token_pack(spark, sf_dir):
    ids = lambda text, base: F.transform(F.split(text, " "), lambda w: F.length(w) + base)
    rows = table(spark, sf_dir, "documents").select("doc_id", ids(F.coalesce("text", F.lit("")), 0).alias("p"), ids(F.concat_ws(" ", "lang", "source"), 1000).alias("c"))
    packed = rows.select("doc_id", pack.pack(F.col("p"), F.col("c"), 64).alias("x"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return packed.select("doc_id", F.size("x.input_ids").cast("long").alias("n_tokens"), joined("x.input_ids").alias("input_ids"), joined("x.labels").alias("labels"))


@query("""WITH f AS (SELECT CASE WHEN length(text) > 5000 THEN 'long' WHEN length(lang || source) > 7 THEN 'target' END AS dropped FROM documents)
SELECT count(*) AS input_records, count(CASE WHEN dropped IS NULL THEN 1 END) AS training_records, count(CASE WHEN dropped = 'long' THEN 1 END) AS dropped_long, count(CASE WHEN dropped = 'target' THEN 1 END) AS dropped_target FROM f""")
def q28_char_filter_cascade(spark, sf_dir):
    long = ~pack.within_chars(F.col("text"), 5000)
    target = ~pack.within_chars(F.concat("lang", "source"), 7)
    rows = table(spark, sf_dir, "documents").select(F.when(long, "long").when(target, "target").alias("dropped"))
    return rows.agg(F.count("*").alias("input_records"), F.count(F.when(F.col("dropped").isNull(), 1)).alias("training_records"), *(F.count(F.when(F.col("dropped") == k, 1)).alias(f"dropped_{k}") for k in ("long", "target")))


@query(r"""WITH t AS (SELECT doc_id, chr(13) || chr(10) || '  ' || replace(coalesce(text, ''), '. ', '.' || chr(9) || chr(13) || chr(10) || ' ') || chr(13) AS t FROM documents),
l AS (SELECT doc_id, [regexp_replace(x, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') FOR x IN string_split(regexp_replace(t, '\r\n|\r', chr(10), 'g'), chr(10))] AS l FROM t)
SELECT doc_id, sha256(trim(array_to_string(l, chr(10)), chr(10))) AS normalized FROM l""")
def q29_normalize_output(spark, sf_dir):
    text = F.concat(F.lit("\r\n  "), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\t\r\n ")), F.lit("\r"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_output(text), 256).alias("normalized"))


@query("""WITH c AS (SELECT o_orderkey, count(l_orderkey)::INT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
v AS (SELECT *, CASE WHEN n >= 3 THEN least(3, n - 2) WHEN n = 2 THEN 1 ELSE least(3, n) END AS visible FROM c),
r AS (SELECT *, n - visible AS rest FROM v),
q AS (SELECT *, CASE WHEN rest >= 2 THEN least(4, rest - least(2, greatest(1, rest // 3))) ELSE least(4, rest) END AS reward FROM r)
SELECT o_orderkey, visible::INT AS visible, reward::INT AS reward, least(2, rest - reward)::INT AS eval FROM q""")
def q30_case_quotas(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    rows = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("q", T.case_quotas(F.coalesce("n", F.lit(0)), 3, 4, 2))
    return rows.select("o_orderkey", "q.*")


@query("SELECT p_partkey, 'part_' || p_partkey || '_' || coalesce(nullif(substr(lower(trim(regexp_replace(p_name || ' (' || p_type || ')', '[^a-zA-Z0-9]+', '_', 'g'), '_')), 1, 80), ''), 'problem') AS slug FROM part")
def q31_safe_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), F.col("p_partkey"), "part").alias("slug"))


@query(r"SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(props, '\d+(?:\.\d+)?'), '') AS DOUBLE), 2.0) AS number FROM events")
def q32_parse_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.parse_number(F.col("props"), 2.0).alias("number"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q33_resume_anti_join(spark, sf_dir):
    return resume.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, trim(b.text)) WHERE length(trim(b.text)) > 0")
def q34_heldout_leakage(spark, sf_dir):
    """Documents that hold a benchmark item verbatim. Both sides meet by the hash of an item's first words; the
    whole item is compared after that."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.btrim("text").alias("item")).where("item <> ''").withColumn("w", F.split("item", r"\s+"))
    # An item's anchor is its first window of up to 8 words; the lengths of anchors are 8 at most, so few passes are made.
    items = checkpointed(items.withColumn("n", F.least(F.lit(8), F.size("w"))).select("item_id", "item", "n", F.xxhash64(F.slice(F.transform("w", lambda x: F.xxhash64(x)), 1, F.col("n"))).alias("lead")))
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    bits = items.select((F.pmod("lead", F.lit(1 << 16))).alias("b")).distinct()
    marks = bits.groupBy((F.shiftright("b", 6)).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int"))).alias("word"))
    # One row of a fixed size: a bit for the hash of every anchor, tried before a window leaves its document's array.
    filled = marks.agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0).cast("long"))).alias("marks"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    # Words are hashed once, so that a window is a run of numbers.
    body = docs.select("doc_id", F.transform(F.split("text", r"\s+"), lambda x: F.xxhash64(x)).alias("w")).crossJoin(F.broadcast(checkpointed(filled)))

    def windows(n: int):
        hashes = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k: F.xxhash64(F.slice("w", k, n)))
        told = lambda h: F.getbit(F.element_at("marks", (F.shiftright(F.pmod(h, F.lit(1 << 16)), 6) + 1).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1
        return F.when(F.size("w") >= n, F.array_distinct(F.filter(hashes, told)))

    found = reduce(DataFrame.unionByName, [body.select("doc_id", F.lit(n).alias("n"), F.explode(windows(n)).alias("lead")) for n in lengths or [8]])
    found = found.join(items.select("item_id", "n", "lead"), ["n", "lead"]).select("doc_id", "item_id").distinct()
    checked = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "item"), "item_id")
    return checked.where(F.contains("text", "item")).select("doc_id", "item_id").distinct()


@query("SELECT conv_id, arg_min(role, {'t': turn, 'r': role}) AS first_role, arg_max(role, {'t': turn, 'r': role}) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id")
def q35_first_last_attempt(spark, sf_dir):
    at = F.struct("turn", "role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", at).alias("first_role"), F.max_by("role", at).alias("last_role"), F.count("*").alias("turns"))


@query("WITH " + REPORT_SQL + "SELECT CASE WHEN timed_out THEN 'TIMEOUT' WHEN truncated THEN 'OUTPUT_TOO_LONG' WHEN returncode <> 0 THEN 'RUNTIME_ERROR' ELSE 'WRONG_ANSWER' END AS kind, count(*) AS runs FROM lines WHERE NOT passed GROUP BY 1")
def q36_failure_classify(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(run_of_line().alias("run")).where("NOT run.passed")
    return runs.groupBy(R.run_failure(F.col("run")).alias("kind")).agg(F.count("*").alias("runs"))


@query(r"SELECT conv_id, turn, role, role = 'user' AND text <> '' AND NOT regexp_matches(text || CASE turn % 3 WHEN 0 THEN ' x = input ( )' WHEN 1 THEN ' sys.stdin' ELSE ' print(1)' END, '\binput\s*\(|sys\.stdin|open\s*\(\s*0\b|fileinput\.|os\.read\s*\(\s*0\b') AS hardcoded FROM conversations")
def q37_hardcode_heuristic(spark, sf_dir):
    code = F.concat("text", F.when(F.col("turn") % 3 == 0, " x = input ( )").when(F.col("turn") % 3 == 1, " sys.stdin").otherwise(" print(1)"))
    mode = F.when(F.col("role") == "user", "stdin").otherwise("callable")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.looks_hardcoded(code, mode, F.array("text")).alias("hardcoded"))


QUERIES |= catalog_problems.QUERIES
ORACLES |= catalog_problems.ORACLES
