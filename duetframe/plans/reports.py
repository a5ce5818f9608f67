"""Queries: summaries, health, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate
from ..operators import pairs as pr
from ..operators import stats as st
from ..operators import turns as tr
from ..operators.ranks import numbered
from ..sources.views import view, with_views
from .registry import query
from .scoring import _GATED, _PAIRS, FOLLOW, LEADER, R6, U, gated_rows, leader_pair_rows, scored

METHODS = ("direct_prompt", "self_consistency_3", "self_repair", "agentcoder")
DISPLAY = {"direct_prompt": "Direct Prompt", "self_consistency_3": "Self-Consistency@3", "self_repair": "Self-Repair", "agentcoder": "AgentCoder"}
_NAMES = ", ".join(f"('{m}', '{n}', {i})" for i, (m, n) in enumerate(DISPLAY.items()))


@query(with_views("v_traj") + ", " + _PAIRS + """ SELECT (SELECT count(DISTINCT task_id) FROM v_traj) AS tasks, (SELECT count(*) FROM v_traj) AS trajectories, count(*) AS preferences, count(DISTINCT task_id) AS tasks_with_preferences,
 (SELECT count(DISTINCT task_id) FROM v_traj) - count(DISTINCT task_id) AS tasks_without_preferences, (SELECT round(avg(pass_rate), 6) FROM v_traj) AS pass_rate_mean, (SELECT count(*) FROM v_traj WHERE passed) AS passed,
 (SELECT round(avg(u), 6) FROM s) AS utility_mean, (SELECT round(avg(rounds), 6) FROM v_traj) AS avg_rounds, (SELECT round(avg(incentive_total), 6) FROM v_traj) AS avg_incentive, (SELECT count(*) FROM v_traj WHERE role_penalty > 0) AS violations FROM p""")
def sampling_summary(spark, d):
    t = view(spark, d, "v_traj").join(scored(spark, d).select("trajectory_id", "leader_utility"), "trajectory_id")
    one = t.agg(F.count_distinct("task_id").alias("tasks"), F.count("*").alias("trajectories"), R6(F.avg("pass_rate")).alias("pass_rate_mean"), F.count_if("passed").alias("passed"), R6(F.avg("leader_utility")).alias("utility_mean"), R6(F.avg("rounds")).alias("avg_rounds"), R6(F.avg("incentive_total")).alias("avg_incentive"), F.count_if(F.col("role_penalty") > 0).alias("violations"))
    # counted by a sweep over utilities: no pair is made
    two = pr.delta_stats(scored(spark, d), "task_id", "leader_utility", LEADER.leader_margin).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("preferences"), F.count("*").alias("tasks_with_preferences"))
    return one.crossJoin(F.broadcast(two)).withColumn("tasks_without_preferences", F.col("tasks") - F.col("tasks_with_preferences"))


@query(with_views("v_cand") + ", " + _GATED + """ SELECT count(*) AS pairs, count(DISTINCT state_id) AS states, count(DISTINCT c.task_id) AS tasks, count(*) FILTER (c.passed) AS chosen_passed, count(*) FILTER (NOT c.passed) AS chosen_partial, (SELECT count(*) FROM v_cand) AS candidates FROM g""")
def follower_summary(spark, d):
    g = gated_rows(spark, d).agg(F.count("*").alias("pairs"), F.count_distinct("state_id").alias("states"), F.count_distinct("chosen.task_id").alias("tasks"), F.count_if("chosen.passed").alias("chosen_passed"), F.count_if(~F.col("chosen.passed")).alias("chosen_partial"))
    return g.crossJoin(F.broadcast(view(spark, d, "v_cand").agg(F.count("*").alias("candidates"))))


@query(with_views("v_cand") + ", " + _GATED + " SELECT map_from_entries(list({'k': k, 'v': n} ORDER BY k)) AS counts FROM (SELECT CAST(c.round AS VARCHAR) AS k, count(*) AS n FROM g GROUP BY 1)")
def round_counts(spark, d):
    return st.counter(gated_rows(spark, d).select(F.col("chosen.round").alias("round")), "round")


_HEALTH = """h AS (SELECT trajectory_id, arg_max(passed, round) AS passed, max(pass_rate) AS best, max(round) AS rounds, bool_or(coalesce(error_type = 'SyntaxError', false)) AS syn, bool_or(coalesce(error_type = 'IndentationError', false)) AS ind FROM v_turn GROUP BY 1)"""


def health(spark, d):
    return st.trajectory_health(tr.rollup(view(spark, d, "v_turn")))


@query(with_views("v_turn") + ", " + _HEALTH + """ SELECT count(*) AS trajectories, count(*) FILTER (passed) AS passed, count(*) FILTER (best > 0) AS positive_pass_rate, round(count(*) FILTER (passed) / count(*), 6) AS passed_rate, round(count(*) FILTER (best > 0) / count(*), 6) AS positive_pass_rate_fraction,
 count(*) FILTER (syn) AS syntax_error_trajectories, count(*) FILTER (ind) AS indentation_error_trajectories, round(count(*) FILTER (syn) / count(*), 6) AS syntax_error_rate, round(count(*) FILTER (ind) / count(*), 6) AS indentation_error_rate, round(avg(rounds), 6) AS avg_rounds FROM h""")
def trajectory_health(spark, d):
    h = health(spark, d)
    return h.select(*(R6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in h.dtypes))


GATES = [
    ("01_context", "trajectories", 128.0, None),
    ("01_context", "syntax_error_rate", None, 0.15),
    ("01_context", "positive_pass_rate_fraction", 0.1, None),
    ("01_context", "avg_rounds", None, 1.95),
    ("04_resample", "preferences", 16.0, None),
    ("04_resample", "passed", None, None),
]
_RULES = ", ".join(f"('{g}', '{m}', {'NULL' if lo is None else lo}, {'NULL' if hi is None else hi})" for g, m, lo, hi in GATES)


@query(with_views("v_turn") + ", " + _HEALTH + f""", v(metric, value) AS (SELECT 'trajectories', CAST(count(*) AS DOUBLE) FROM h UNION ALL SELECT 'syntax_error_rate', count(*) FILTER (syn) / count(*) FROM h UNION ALL SELECT 'positive_pass_rate_fraction', count(*) FILTER (best > 0) / count(*) FROM h
 UNION ALL SELECT 'avg_rounds', avg(rounds) FROM h UNION ALL SELECT 'passed', CAST(count(*) FILTER (passed) AS DOUBLE) FROM h), r(gate, metric, low, high) AS (VALUES {_RULES})
SELECT gate, metric, round(value, 6) AS value, CASE WHEN (low IS NOT NULL OR high IS NOT NULL) AND value IS NULL THEN 'missing' WHEN value < low THEN 'below' WHEN value > high THEN 'above' ELSE '' END AS failed FROM r LEFT JOIN v USING (metric)""")
def health_gates(spark, d):
    return st.health_gates(health(spark, d), GATES).withColumn("value", R6(F.col("value")))


_UNTIL = """u AS (SELECT * FROM (SELECT *, sum(passed::INT) OVER (PARTITION BY trajectory_id ORDER BY round) - passed::INT AS earlier FROM v_turn) WHERE earlier = 0),
r AS (SELECT trajectory_id, arg_min(passed, round) AS first_passed, bool_or(passed) AS final_passed, max(pass_rate) AS final_pass_rate, max(round) AS rounds_used, sum(plan_tokens) AS pt, sum(CASE WHEN round > 1 THEN code_tokens * 2 ELSE code_tokens END) AS ct FROM u GROUP BY 1)"""


@query(with_views("v_turn") + ", " + _UNTIL + """ SELECT count(*) AS num_tasks, count(*) FILTER (first_passed) AS first_round_passed, round(count(*) FILTER (first_passed) / count(*), 6) AS first_round_pass_at_1, count(*) FILTER (final_passed) AS final_passed, round(count(*) FILTER (final_passed) / count(*), 6) AS final_pass_rate_binary,
 round(avg(final_pass_rate), 6) AS avg_assert_pass_rate_final, round(avg(rounds_used), 6) AS avg_rounds_used, round(avg(pt), 6) AS avg_planner_tokens, round(avg(ct), 6) AS avg_coder_tokens, round(avg(0.02 * rounds_used + 0.00001 * (pt + ct)), 6) AS avg_total_cost, round(avg(final_pass_rate - (0.02 * rounds_used + 0.00001 * (pt + ct))), 6) AS avg_leader_utility FROM r""")
def eval_summary(spark, d):
    t = tr.until_passed(view(spark, d, "v_turn"))
    # repair rounds were sampled twice: the total over the samples counts, not the turn's own
    total = F.when(F.col("round") > 1, F.col("code_tokens") * 2)
    r = t.groupBy("trajectory_id").agg(F.min_by("passed", "round").alias("fp"), F.bool_or("passed").alias("lp"), F.max("pass_rate").alias("pr"), F.max("round").alias("n"), F.sum("plan_tokens").alias("pt"), F.sum(F.coalesce(total, F.col("code_tokens"))).alias("ct"))
    from ..functions.utility import clamp01, total_cost

    cost = total_cost(F.col("n"), F.col("pt") + F.col("ct"), U)
    n = F.count("*")
    return r.agg(n.alias("num_tasks"), F.count_if("fp").alias("first_round_passed"), R6(st.rate(F.count_if("fp"), n)).alias("first_round_pass_at_1"), F.count_if("lp").alias("final_passed"), R6(st.rate(F.count_if("lp"), n)).alias("final_pass_rate_binary"), R6(F.avg("pr")).alias("avg_assert_pass_rate_final"), R6(F.avg("n")).alias("avg_rounds_used"), R6(F.avg("pt")).alias("avg_planner_tokens"), R6(F.avg("ct")).alias("avg_coder_tokens"), R6(F.avg(cost)).alias("avg_total_cost"), R6(F.avg(clamp01(F.col("pr")) - cost)).alias("avg_leader_utility"))


@query(with_views("v_task", "v_cand") + """, j AS (SELECT coalesce(split, '') AS split, c.passed, c.pass_rate FROM v_cand c JOIN v_task t ON t.task_id = c.task_id) SELECT split, count(*) AS num_tasks, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 6) AS pass_at_1, round(avg(pass_rate), 6) AS avg_assert_pass_rate FROM j GROUP BY split""")
def model_summary(spark, d):
    j = view(spark, d, "v_cand").select("task_id", "passed", "pass_rate").join(view(spark, d, "v_task").select("task_id", F.coalesce("split", F.lit("")).alias("split")), "task_id")
    n, p = F.count("*"), F.count_if("passed")
    return j.groupBy("split").agg(n.alias("num_tasks"), p.alias("passed"), R6(st.rate(p, n)).alias("pass_at_1"), R6(F.avg("pass_rate")).alias("avg_assert_pass_rate"))


@query(with_views("v_run") + f""", n(method, display, rank) AS (VALUES {_NAMES}) SELECT coalesce(display, method) AS method, count(*) AS num_tasks, count(*) FILTER (final_passed > 8) AS final_passed, round_even(100 * (count(*) FILTER (final_passed > 8) / count(*)), 2) AS pass_rate, round_even(100 * avg(assert_rate), 2) AS assert_pass_rate, CAST(round_even(avg(tokens), 0) AS BIGINT) AS avg_tokens FROM v_run LEFT JOIN n USING (method) GROUP BY 1""")
def baseline_table(spark, d):
    names = spark.createDataFrame(list(DISPLAY.items()), "method string, display string")
    r = view(spark, d, "v_run").join(F.broadcast(names), "method", "left").withColumn("m", F.coalesce("display", "method"))
    n, p = F.count("*"), F.count_if(F.col("final_passed") > 8)
    return r.groupBy(F.col("m").alias("method")).agg(n.alias("num_tasks"), p.alias("final_passed"), F.bround(100 * st.rate(p, n), 2).alias("pass_rate"), F.bround(100 * F.avg("assert_rate"), 2).alias("assert_pass_rate"), F.bround(F.avg("tokens")).cast("bigint").alias("avg_tokens"))


@query(with_views("v_run") + """ SELECT setting, variant, count(*) AS num_tasks, count(*) FILTER (final_passed % 4 = 1) AS syntax_error_count, count(*) FILTER (final_passed % 4 = 2) AS indentation_error_count FROM v_run GROUP BY setting, variant""")
def diagnosis_summary(spark, d):
    e = F.col("final_passed") % 4
    return view(spark, d, "v_run").groupBy("setting", "variant").agg(F.count("*").alias("num_tasks"), F.count_if(e == 1).alias("syntax_error_count"), F.count_if(e == 2).alias("indentation_error_count"))


@query(with_views("v_run") + f""", n(method, display, rank) AS (VALUES {_NAMES}) SELECT coalesce(display, method) AS method, budget AS max_new_tokens, row_number() OVER (ORDER BY coalesce(rank, 99), budget, ord) AS place FROM v_run LEFT JOIN n USING (method)""")
def efficiency_curve(spark, d):
    names = spark.createDataFrame([(m, n, i) for i, (m, n) in enumerate(DISPLAY.items())], "method string, display string, rank int")
    r = view(spark, d, "v_run").join(F.broadcast(names), "method", "left")
    r = r.select(F.coalesce("display", "method").alias("method"), F.coalesce("rank", F.lit(99)).alias("rank"), "budget", "ord")
    return numbered(r, ["rank", "budget", "ord"], first=1).select("method", F.col("budget").alias("max_new_tokens"), "place")


@query(with_views("v_run") + """ SELECT ord, CASE WHEN has_failed THEN 'failed' WHEN has_summary THEN 'completed' ELSE 'pending' END AS status, CASE WHEN has_summary THEN round_even(100 * assert_rate, 2) END AS assert_pass_rate_percent, CASE WHEN has_summary THEN final_passed BETWEEN 0 AND 17 AND tokens > 0 AND assert_rate BETWEEN 0 AND 1 END AS valid FROM v_run""")
def run_status(spark, d):
    r = view(spark, d, "v_run")
    summary = r.where("has_summary").select("ord", "assert_rate", "tokens", "final_passed")
    failed = r.where("has_failed").select("ord", F.lit(True).alias("failed"))
    j = r.select("ord").join(summary, "ord", "left").join(failed, "ord", "left")
    status = F.when(F.col("failed"), "failed").when(F.col("assert_rate").isNotNull(), "completed").otherwise("pending")
    valid = F.col("final_passed").between(0, 17) & (F.col("tokens") > 0) & F.col("assert_rate").between(0, 1)
    return j.select("ord", status.alias("status"), F.bround(100 * F.col("assert_rate"), 2).alias("assert_pass_rate_percent"), valid.alias("valid"))


@query(with_views("v_cand") + ", " + _GATED + " SELECT c.round AS round, count(*) AS pairs, round(avg(delta), 6) AS mean_delta, min(c.pass_rate - r.pass_rate >= 0.1) AS gated FROM g GROUP BY 1")
def pairs_by_round(spark, d):
    p = pr.gated(gated_rows(spark, d).drop("pass_rate_delta"), FOLLOW)
    return p.groupBy(F.col("chosen.round").alias("round")).agg(F.count("*").alias("pairs"), R6(F.avg("utility_delta")).alias("mean_delta"), F.min(F.col("pass_rate_delta") >= 0.1).alias("gated"))


_METHODS = ", ".join(f"('{m}')" for m in generate.METHODS)


@query(with_views("v_gen") + f""", m(method) AS (VALUES {_METHODS}),
a AS (SELECT method, g.*, max(CASE WHEN call = 0 AND passed THEN 1 ELSE 0 END) OVER (PARTITION BY method, task_id) AS first_passed FROM v_gen g, m),
u AS (SELECT * FROM a WHERE CASE method WHEN 'direct_prompt' THEN call = 0 WHEN 'cot' THEN call = 0 WHEN 'self_consistency_3' THEN call < 3 WHEN 'self_repair' THEN call = 0 OR (call = 1 AND first_passed = 0) WHEN 'mad' THEN call < 4 ELSE call < 2 OR (call = 2 AND first_passed = 0) END),
t AS (SELECT *, sum(prompt_tokens + completion_tokens) OVER (PARTITION BY method, task_id ORDER BY call) AS spent, prompt_tokens + completion_tokens AS own FROM u),
c AS (SELECT *, CAST(CASE WHEN method = 'self_consistency_3' THEN own ELSE spent END AS BIGINT) AS tokens FROM t WHERE NOT (method = 'mad' AND call < 3) AND NOT (method = 'agentcoder' AND call = 1)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY method, task_id ORDER BY pass_rate DESC, passed DESC, tokens, call) = 1),
s AS (SELECT method, task_id, count(*) AS num_generations, CAST(sum(own) AS BIGINT) AS total_tokens FROM t GROUP BY 1, 2)
SELECT s.method, s.task_id, num_generations, total_tokens, b.call AS selected_call, b.pass_rate, b.passed FROM s JOIN b USING (method, task_id)""")
def baseline_methods(spark, d):
    return generate.baselines(view(spark, d, "v_gen"))


@query(with_views("v_turn") + """, b AS (SELECT *, coalesce(max(pass_rate) OVER (PARTITION BY trajectory_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bb, sum(passed::INT) OVER (PARTITION BY trajectory_id ORDER BY round) - passed::INT AS earlier FROM v_turn),
k AS (SELECT *, least(0.04, 0.05 * greatest(0.0, pass_rate - bb)) AS inc FROM b WHERE earlier = 0),
g AS (SELECT trajectory_id, max(round) AS rounds, CAST(sum(plan_tokens + code_tokens) AS BIGINT) AS communication_tokens, sum(inc) AS incentive_total, arg_max(pass_rate, round) AS pass_rate, bool_or(passed) AS passed FROM k GROUP BY 1)
SELECT trajectory_id, rounds, communication_tokens, round(incentive_total, 6) AS incentive_total, round(pass_rate, 6) AS pass_rate, passed, round(pass_rate - 0.02 * rounds - 0.00001 * communication_tokens - incentive_total, 6) AS leader_utility FROM g""")
def interaction_replay(spark, d):
    t = generate.replayed_trajectories(view(spark, d, "v_turn"), 0.05, 0.04, U)
    return t.select("trajectory_id", "rounds", "communication_tokens", R6(F.col("incentive_total")).alias("incentive_total"), R6(F.col("pass_rate")).alias("pass_rate"), "passed", R6(F.col("leader_utility")).alias("leader_utility"))


@query(with_views("v_run") + """ SELECT variant, setting, count(*) AS num_tasks, count(*) FILTER (final_passed > 8) AS final_passed, round(count(*) FILTER (final_passed > 8) / count(*), 6) AS final_pass_rate, round(avg(assert_rate), 6) AS avg_assert_pass_rate, round(avg(tokens), 6) AS avg_total_tokens,
 round(avg(assert_rate) - 0.02 * avg(budget % 4) - 0.00001 * avg(tokens), 6) AS leader_utility FROM v_run GROUP BY variant, setting""")
def ablation_table(spark, d):
    n, p = F.count("*"), F.count_if(F.col("final_passed") > 8)
    u = F.avg("assert_rate") - U.lambda_round * F.avg(F.col("budget") % 4) - U.lambda_token * F.avg("tokens")
    return view(spark, d, "v_run").groupBy("variant", "setting").agg(n.alias("num_tasks"), p.alias("final_passed"), R6(st.rate(p, n)).alias("final_pass_rate"), R6(F.avg("assert_rate")).alias("avg_assert_pass_rate"), R6(F.avg("tokens")).alias("avg_total_tokens"), R6(u).alias("leader_utility"))
