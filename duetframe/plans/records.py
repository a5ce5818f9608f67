"""Queries: requests, responses, metric structs, result files and asserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import execute, states as ss, turns as tr
from ..sources import readers
from ..sources.tables import scratch
from ..sources.views import view, with_views
from .registry import query

R6 = lambda c: F.round(c, 6)
W = "PARTITION BY trajectory_id ORDER BY round"


def _sql(text: str) -> str:
    """A Python text as a DuckDB literal."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(with_views("v_traj") + """ SELECT trajectory_id, passed AND rounds > 0 AS passed, round(least(1.0, pass_rate), 6) AS pass_rate, rounds, context_tokens, round(0.02 * rounds, 6) AS round_cost, incentive_total, role_penalty AS role_boundary_penalty_total FROM v_traj""")
def trajectory_metrics(spark, d):
    t = view(spark, d, "v_traj")
    rate = R6(F.least(F.lit(1.0), F.col("pass_rate")))
    metrics = F.struct((F.col("passed") & (F.col("rounds") > 0)).alias("passed"), rate.alias("pass_rate"), "rounds", "context_tokens", R6(0.02 * F.col("rounds")).alias("round_cost"), "incentive_total", F.col("role_penalty").alias("role_boundary_penalty_total"))
    return t.select("trajectory_id", metrics.alias("metrics")).select("trajectory_id", "metrics.*")


_JSON_TEXT = """CASE turn % 4 WHEN 0 THEN '{"from": "gpt", "value": "said ' || conv_id || '"}' WHEN 1 THEN '"plain ' || turn || '"' WHEN 2 THEN '{"from": "gpt"}' ELSE 'raw ' || turn END"""


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'said ' || conv_id WHEN 1 THEN 'plain ' || turn WHEN 2 THEN '' ELSE 'raw ' || turn END AS response FROM conversations")
def response_coercion(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return t.select("conv_id", "turn", prompts.response_text(F.expr(_JSON_TEXT)).alias("response"))


def _ask(round_: str, prompt: str, before: str, feedback: str) -> str:
    return f"CASE WHEN {round_} = 1 THEN {_sql(prompts.PLAN_ASK)} || {prompt} ELSE {_sql(prompts.PLAN_AGAIN)} || 'Task:' || chr(10) || {prompt} || chr(10) || chr(10) || 'Previous code:' || chr(10) || {before} || chr(10) || chr(10) || 'Execution feedback:' || chr(10) || {feedback} END"


@query(with_views("v_turn") + f", b AS (SELECT *, 'solve ' || task_id AS prompt, coalesce(lag(code) OVER ({W}), '') AS before, 'error ' || coalesce(lag(error_type) OVER ({W}), 'none') AS feedback FROM v_turn) SELECT trajectory_id, round, {_ask('round', 'prompt', 'before', 'feedback')} AS request FROM b")
def planner_requests(spark, d):
    t = tr.with_previous(view(spark, d, "v_turn"))
    feedback = F.concat(F.lit("error "), F.coalesce("previous_error", F.lit("none")))
    return t.select("trajectory_id", "round", prompts.planner_request(F.col("round"), F.concat(F.lit("solve "), "task_id"), F.col("previous_code"), feedback).alias("request"))


_GAP = " || chr(10) || chr(10) || "


@query(with_views("v_turn") + f""", b AS (SELECT *, 'solve ' || task_id AS prompt, coalesce(lag(code) OVER ({W}), '') AS before, 'error ' || coalesce(lag(error_type) OVER ({W}), 'none') AS feedback FROM v_turn)
SELECT trajectory_id, round, 'Task:' || chr(10) || prompt || {_GAP.strip(' |')} || CASE WHEN round = 1 THEN 'Planner guidance:' || chr(10) || plan{_GAP}'pay'{_GAP}{_sql(prompts.CODE_ASK)}
 ELSE 'Previous code:' || chr(10) || before{_GAP}'Execution feedback:' || chr(10) || feedback{_GAP}'Planner repair guidance:' || chr(10) || plan{_GAP}'pay'{_GAP}{_sql(prompts.CODE_AGAIN)} END AS request FROM b""")
def coder_requests(spark, d):
    t = tr.with_previous(view(spark, d, "v_turn"))
    feedback = F.concat(F.lit("error "), F.coalesce("previous_error", F.lit("none")))
    return t.select("trajectory_id", "round", prompts.coder_request(F.col("round"), F.concat(F.lit("solve "), "task_id"), F.col("plan"), F.col("previous_code"), feedback, F.lit("pay")).alias("request"))


@query(with_views("v_task") + " SELECT task_id, 'Task ID: ' || task_id || chr(10) || 'Entry point: f' || ord || chr(10) || 'Task prompt:' || chr(10) || prompt AS state_text FROM v_task")
def leader_state_text(spark, d):
    t = view(spark, d, "v_task")
    return t.select("task_id", prompts.leader_state(F.col("task_id"), F.concat(F.lit("f"), F.col("ord").cast("string")), F.col("prompt")).alias("state_text"))


@query(with_views("v_turn") + " SELECT trajectory_id, round FROM v_turn WHERE round > 1 ORDER BY ord LIMIT 300")
def repair_only_states(spark, d):
    return ss.selected(view(spark, d, "v_turn"), 300, repair_only=True).select("trajectory_id", "round")


@query(with_views("v_task", "v_turn") + ", r AS (SELECT task_id, max(pass_rate) AS best FROM v_turn GROUP BY task_id) SELECT task_id, round(best, 6) AS best, row_number() OVER (ORDER BY v_task.ord) AS place FROM v_task JOIN r USING (task_id)")
def results_in_task_order(spark, d):
    done = view(spark, d, "v_turn").groupBy("task_id").agg(F.max("pass_rate").alias("best"))
    return ss.placed(view(spark, d, "v_task").join(done, "task_id")).select("task_id", R6(F.col("best")).alias("best"), (F.col("place") + 1).cast("bigint").alias("place"))


@query("WITH m AS (" + with_views("v_run") + " SELECT DISTINCT method FROM v_run) SELECT method FROM m INTERSECT SELECT * FROM (VALUES ('direct_prompt'), ('self_repair'), ('mad'))")
def known_methods(spark, d):
    asked = spark.createDataFrame([(m,) for m in ("direct_prompt", "self_repair", "mad")], "method string")
    return view(spark, d, "v_run").select("method").intersect(asked)


@query("SELECT 0 AS missing, count(*) AS there FROM conversations")
def lenient_scan(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    path = scratch(spark)
    readers.write_jsonl(t, path)
    missing = readers.read_jsonl_or_empty(spark, path + "-none", t.schema).agg(F.count("*").cast("int").alias("missing"))
    there = readers.read_jsonl_or_empty(spark, path, t.schema).agg(F.count("*").alias("there"))
    return missing.crossJoin(F.broadcast(there))  # one row each


@query("SELECT conv_id, turn, role, text FROM conversations")
def append_resume(spark, d):
    """Written in two goes, the second of which gets all rows again: each key is there once."""
    t = spark.read.parquet(f"{d}/conversations.parquet").withColumn("key", F.concat_ws("_", "conv_id", "turn"))
    path = scratch(spark)
    readers.write_jsonl(t.where("turn % 2 = 0"), path)
    readers.append_new(t, path, "key")
    return readers.read_jsonl(spark, path, t.schema).drop("key")


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_roundtrip(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_size")
    path = scratch(spark)
    readers.write_csv(t, path)
    return spark.read.option("header", True).schema(t.schema).csv(path)


@query("SELECT conv_id, role, count(*) AS turns FROM conversations GROUP BY ALL")
def training_array(spark, d):
    """Rows written as JSON arrays without their metadata and read again."""
    t = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id", "role").agg(F.count("*").alias("turns"))
    path = scratch(spark)
    readers.write_dpo_arrays(t.withColumn("metadata", F.struct(F.lit("x").alias("stage"))), path)
    return spark.read.option("multiLine", True).schema(t.schema).json(path)


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def log_stamp(spark, d):
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("SELECT r_regionkey, r_regionkey % 2 = 0 AS passed, CASE WHEN r_regionkey % 2 = 0 THEN 1.0 ELSE 1.0 / 3 END AS pass_rate, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 3 ELSE 1 END AS INT) AS passed_tests, CAST(3 AS INT) AS total_tests FROM region")
def execute_assertions(spark, d):
    """A function of each region run against three asserts; odd regions' functions are off by one for numbers over 0."""
    t = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey")
    code = F.concat(F.lit("def f(x):\n    return x + "), F.col("r_regionkey").cast("string"), F.lit(" + (x > 0) * "), (F.col("r_regionkey") % 2).cast("string"), F.lit("\n"))
    k = F.col("r_regionkey").cast("string")
    test = F.concat(F.lit("def check(candidate):\n    assert candidate(0) == "), k, F.lit("\n    assert candidate(1) == 1 + "), k, F.lit("\nassert f(2) == 2 + "), k)
    ran = execute.execute_asserts(t.withColumns({"code": code, "entry_point": F.lit("f"), "test": test}), seconds=10.0)
    return ran.select("r_regionkey", *(F.col(f"feedback.{c}").alias(c) for c in ("passed", "pass_rate", "passed_tests", "total_tests")))
