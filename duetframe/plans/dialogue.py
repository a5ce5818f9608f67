"""Queries: the interaction loop over all tasks, with a model and an executor that hang on every byte of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..operators.loop import LoopConfig, outcomes, play
from ..sources.tables import workspace
from ..sources.views import view, with_views
from .feedback import _text
from .registry import query

R6 = lambda c: F.round(c, 6)
CFG = LoopConfig(max_rounds=3, best_so_far=True, seed=13)


def _said(requests):
    """Plans state an effort that goes with the request's length; code returns the request's digest."""
    h = F.sha2(F.concat_ws("|", "role", "user", F.col("seed").cast("string")), 256)
    plan = F.concat(F.lit("Estimated effort tokens: "), (60 + F.length("user") % 700).cast("string"), F.lit("\nplan "), F.substr(h, F.lit(1), F.lit(8)))
    code = F.concat(F.lit("def "), "entry_point", F.lit('(x):\n    return "'), F.substr(h, F.lit(1), F.lit(6)), F.lit('"'))
    count = lambda x: F.ceil(F.length(x) / 4).cast("int")
    told = requests.withColumn("generated_text", F.when(F.col("role") == "planner", plan).otherwise(code))
    return told.withColumns({"prompt_tokens": count("user"), "completion_tokens": count("generated_text")})


def _ran(rows):
    """Four asserts, of which the code's digest says how many hold."""
    n = ((F.instr(F.lit("0123456789abcdef"), F.substr(F.sha2("code", 256), F.lit(1), F.lit(1))) - 1) % 5).cast("int")
    failed = F.concat(F.lit('[{"assert": "assert f('), n.cast("string"), F.lit(') == 1", "passed": false}]'))
    none = F.lit(None).cast("string")
    fields = {"passed": n == 4, "pass_rate": n / 4, "passed_tests": n, "total_tests": F.lit(4), "timeout": F.lit(False), "error_type": F.when(n == 0, "ValueError"), "error_message": none, "assert_results": F.when(n < 4, failed).otherwise("[]"), "stderr": none}
    return rows.withColumn("feedback", F.struct(*(v.alias(k) for k, v in fields.items())))


def _runs(spark, d):
    t = view(spark, d, "v_task")
    return t.select(F.col("task_id").alias("run_id"), "task_id", "prompt", F.concat(F.lit("f"), F.col("ord").cast("string")).alias("entry_point"), "ord", "test_tokens")


_TEXT = """E'{\\n  "passed": ' || CAST(p = 4 AS VARCHAR) || E',\\n  "pass_rate": ' || CAST(p / 4.0 AS VARCHAR) || E',\\n  "passed_tests": ' || p || E',\\n  "total_tests": 4,\\n  "timeout": false,\\n  "error_type": ' || CASE WHEN p = 0 THEN '"ValueError"' ELSE 'null' END || E',\\n  "error_message": null' ||
 CASE WHEN p < 4 THEN E',\\n  "failed_asserts": [\\n    {\\n      "assert": "assert f(' || p || E') == 1",\\n      "passed": false\\n    }\\n  ]' ELSE '' END || E'\\n}'"""
_SHOWN = "E'Task:\\n' || prompt || E'\\n\\nPrevious code:\\n' || pc || E'\\n\\nExecution feedback:\\n' || pf"
_PAY = "'Incentive rule: execution improvements are rewarded by incremental pass-rate gain. Remaining trajectory incentive budget is about ' || printf('%.4f', money) || '; per-step payment is capped at ' || printf('%.4f', 0.08) || '; current best pass rate is ' || printf('%.3f', best) || '.'"
_LOOP = f"""loop(run_id, prompt, ep, ord, tt, n, pc, pf, best, kr, kt, budget, preq, creq, code, rate, better, gain, ended, plan, ptok, ctok) AS (
 SELECT task_id, prompt, concat('f', ord), ord, test_tokens, 0, '', CAST(NULL AS VARCHAR), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), 0, CAST(NULL AS DOUBLE), '', '', '', CAST(0 AS DOUBLE), false, CAST(0 AS DOUBLE), false, '', 0, 0 FROM v_task
 UNION ALL
 SELECT run_id, prompt, ep, ord, tt, m, CASE WHEN up THEN new ELSE pc END, CASE WHEN up THEN {_TEXT} ELSE pf END, greatest(best, p / 4.0), CASE WHEN up THEN p / 4.0 ELSE kr END, CASE WHEN up THEN tok ELSE kt END, money, ask, ask2, new, p / 4.0, up, greatest(0.0, p / 4.0 - best), p = 4, said, CAST(ceil(length(ask) / 4.0) AS INT), CAST(ceil(length(ask2) / 4.0) AS INT)
 FROM (SELECT *, kr IS NULL OR p / 4.0 > kr OR (p / 4.0 = kr AND tok < kt) AS up
 FROM (SELECT *, CAST((strpos('0123456789abcdef', sha256(new)[1]) - 1) % 5 AS INT) AS p, CAST(ceil(length(new) / 4.0) AS INT) AS tok
 FROM (SELECT *, 'def ' || ep || E'(x):\\n    return "' || sha256('coder|' || ask2 || '|' || (14 + 1000 * ord + 10 * m))[1:6] || E'"\\n' AS new
 FROM (SELECT *, CASE WHEN m = 1 THEN E'Task:\\n' || prompt || E'\\n\\nPlanner guidance:\\n' || said || E'\\n\\n' || {_PAY} || E'\\n\\n' || {_text(prompts.CODE_ASK)} ELSE {_SHOWN} || E'\\n\\nPlanner repair guidance:\\n' || said || E'\\n\\n' || {_PAY} || E'\\n\\n' || {_text(prompts.CODE_AGAIN)} END AS ask2
 FROM (SELECT *, coalesce(budget, least(0.25, greatest(0.0, 0.03 * greatest(1.0 / 3.0, least(3.0, exp(0.45 * greatest(-3.0, least(3.0, (est - 256.0) / 256.0)))))))) AS money
 FROM (SELECT *, trunc(greatest(80, least(800, greatest(60 + length(ask) % 700, trunc(ceil(length(said) / 4.0) + 0.25 * ceil(length(prompt) / 4.0) + 0.10 * tt))))) AS est
 FROM (SELECT *, 'Estimated effort tokens: ' || (60 + length(ask) % 700) || E'\\nplan ' || sha256('planner|' || ask || '|' || (13 + 1000 * ord + 10 * m))[1:8] AS said
 FROM (SELECT *, n + 1 AS m, CASE WHEN n = 0 THEN {_text(prompts.PLAN_ASK)} || prompt ELSE {_text(prompts.PLAN_AGAIN)} || {_SHOWN} END AS ask FROM loop WHERE NOT ended AND n < 3) a) b) c) d) e) f) g) h)"""


@query(with_views("v_task").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_LOOP} SELECT run_id, n AS round, sha256(preq) AS planner_request, sha256(creq) AS coder_request, code, rate AS pass_rate, better AS selected, round(least(0.08, budget * gain), 6) AS incentive, round(budget, 6) AS total_budget, ptok AS planner_prompt_tokens, ctok AS coder_prompt_tokens FROM loop WHERE n > 0")
def interaction_loop(spark, d):
    """Every turn of every task; requests as digests."""
    turns = play(_runs(spark, d), CFG, _said, _ran)
    return turns.select("run_id", "round", F.sha2("planner_request", 256).alias("planner_request"), F.sha2("coder_request", 256).alias("coder_request"), "code", "pass_rate", "selected", R6(F.col("incentive")).alias("incentive"), R6(F.col("total_budget")).alias("total_budget"), "planner_prompt_tokens", "coder_prompt_tokens")


@query(with_views("v_task").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_LOOP}, o AS (SELECT run_id, max(n) AS rounds, bool_or(n = 1 AND rate = 1) AS first_round_passed, max(rate) AS best, sum(ptok + ctok) AS ctx, sum(ceil(length(plan) / 4.0) + ceil(length(code) / 4.0)) AS com, sum(least(0.08, budget * gain)) AS inc, arg_max(n, n) FILTER (better) AS best_at, arg_max(code, n) FILTER (better) AS code FROM loop WHERE n > 0 GROUP BY run_id)
SELECT run_id, rounds, first_round_passed, best_at AS selected_round, best AS pass_rate, code, CAST(ctx AS BIGINT) AS context_tokens, CAST(com AS BIGINT) AS communication_tokens, round(inc, 6) AS incentive_total, round(best - 0.02 * rounds - 0.00001 * com - inc, 6) AS leader_utility FROM o""")
def interaction_outcomes(spark, d):
    """What became of every task: the final turn is the best one."""
    runs = _runs(spark, d)
    with workspace(spark) as keep:
        got = keep(outcomes(play(runs, CFG, _said, _ran), runs, CFG))
    return got.select("run_id", "rounds", "first_round_passed", "selected_round", "pass_rate", "code", "context_tokens", "communication_tokens", R6(F.col("incentive_total")).alias("incentive_total"), R6(F.col("leader_utility")).alias("leader_utility"))
