"""Queries: turns, states, selection, grids, scans and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import utility as ut
from ..operators import states as ss
from ..operators import turns as tr
from ..operators.ranks import numbered, scattered
from ..sources import readers
from ..sources.tables import scratch
from ..sources.views import view, with_views
from .registry import query

R6 = lambda c: F.round(c, 6)
W = "PARTITION BY trajectory_id ORDER BY round"
_BEST = f"b AS (SELECT *, coalesce(max(pass_rate) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best_before FROM v_turn)"


def turns(spark, d):
    return view(spark, d, "v_turn")


@query(with_views("v_turn") + f" SELECT trajectory_id, round, coalesce(lag(code) OVER ({W}), '') AS previous_code, lag(error_type) OVER ({W}) AS previous_error FROM v_turn")
def turn_lag(spark, d):
    return tr.with_previous(turns(spark, d)).select("trajectory_id", "round", "previous_code", "previous_error")


@query(with_views("v_turn") + ", " + _BEST + " SELECT trajectory_id, round, round(best_before, 6) AS best_before FROM b")
def running_best(spark, d):
    return tr.with_best_before(turns(spark, d)).select("trajectory_id", "round", R6(F.col("best_before")).alias("best_before"))


@query(with_views("v_turn") + ", " + _BEST + " SELECT trajectory_id, round, round(greatest(0.0, pass_rate - best_before), 6) AS delta_best, round(least(0.04, 0.05 * greatest(0.0, pass_rate - best_before)), 6) AS step_incentive FROM b")
def step_incentive(spark, d):
    t = tr.with_best_before(turns(spark, d))
    gain = F.greatest(F.lit(0.0), ut.clamp01(F.col("pass_rate")) - F.col("best_before"))
    return t.select("trajectory_id", "round", R6(gain).alias("delta_best"), R6(ut.step_incentive(F.col("pass_rate"), F.col("best_before"), F.lit(0.05), F.lit(0.04))).alias("step_incentive"))


@query(with_views("v_turn") + f" SELECT trajectory_id, round, passed FROM (SELECT *, sum(passed::INT) OVER ({W}) - passed::INT AS earlier FROM v_turn) WHERE earlier = 0")
def stop_on_pass(spark, d):
    return tr.until_passed(turns(spark, d)).select("trajectory_id", "round", "passed")


_FIRST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY pass_rate DESC, passed DESC, code_tokens, {}) = 1"


@query(with_views("v_turn") + " SELECT trajectory_id, round, code_tokens FROM v_turn " + _FIRST.format("trajectory_id", "round"))
def best_turn(spark, d):
    return tr.best_turn(turns(spark, d)).select("trajectory_id", "round", "code_tokens")


@query(with_views("v_cand") + " SELECT state_id, candidate_id FROM v_cand " + _FIRST.format("state_id", "ord"))
def best_candidate(spark, d):
    from ..operators.pairs import first_of_each

    return first_of_each(view(spark, d, "v_cand"), ["state_id"], tr.best_first(order="ord")).select("state_id", "candidate_id")


@query(with_views("v_turn") + " SELECT trajectory_id, CAST(sum(plan_tokens) AS BIGINT) AS planner_tokens, CAST(sum(code_tokens) AS BIGINT) AS coder_tokens, arg_min(plan, round) AS plan, arg_max(code, round) AS code, max(round) AS rounds, round(max(pass_rate), 6) AS best_pass_rate FROM v_turn GROUP BY trajectory_id")
def turn_rollup(spark, d):
    return tr.rollup(turns(spark, d)).select("trajectory_id", "planner_tokens", "coder_tokens", "plan", "code", "rounds", R6(F.col("best_pass_rate")).alias("best_pass_rate"))


@query(with_views("v_turn") + " SELECT trajectory_id, concat(string_agg(concat(CASE round WHEN 1 THEN 'Initial plan' ELSE concat('Repair plan round ', round) END, ':', chr(10), trim(plan)), concat(chr(10), chr(10)) ORDER BY round), chr(10)) AS planner_training_text FROM v_turn GROUP BY trajectory_id")
def planner_training_text(spark, d):
    t = turns(spark, d).groupBy("trajectory_id").agg(F.collect_list(F.struct("round", "plan")).alias("t"))
    return t.select("trajectory_id", tr.training_text(F.col("t")).alias("planner_training_text"))


@query(with_views("v_turn") + """, g AS (SELECT trajectory_id, sum(plan_tokens) AS pt, sum(code_tokens) AS ct, arg_min(plan, round) AS fp, arg_max(code, round) AS lc, arg_max(pass_rate, round) AS pr, max(round) AS n FROM v_turn GROUP BY 1)
SELECT trajectory_id, CAST(CASE WHEN n % 2 = 0 THEN 7 ELSE pt + ct END AS BIGINT) AS communication_tokens, CAST(100 + CASE WHEN n % 2 = 0 THEN 7 ELSE pt + ct END AS BIGINT) AS total_tokens, CASE WHEN n % 3 = 0 THEN 'own plan' ELSE fp END AS plan, CASE WHEN n = 1 THEN 'own code' ELSE lc END AS code, round(CASE WHEN n = 2 THEN 0.0 ELSE pr END, 6) AS pass_rate FROM g""")
def normalize_trajectory(spark, d):
    r, n = tr.rollup(turns(spark, d)), F.col("rounds")
    raw = r.select("trajectory_id", "turns", F.lit(100).alias("context_tokens"), F.when(n % 2 == 0, 7).alias("communication_tokens"), F.when(n % 3 == 0, "own plan").otherwise("").alias("plan"), F.when(n == 1, "own code").alias("code"), F.when(n != 2, F.col("pass_rate")).alias("pass_rate"))
    return tr.normalized(raw).select("trajectory_id", "communication_tokens", "total_tokens", "plan", "code", R6(F.col("pass_rate")).alias("pass_rate"))


@query(with_views("v_turn") + " SELECT concat(task_id, '_round', round) AS state_id, trajectory_id, round, concat('Task state:', chr(10), task_id, chr(10), chr(10), 'Planner guidance:', chr(10), plan) AS prompt, code, code_tokens AS coder_tokens FROM v_turn")
def flatten_turn_candidates(spark, d):
    nested = turns(spark, d).groupBy("task_id", "trajectory_id").agg(F.array_sort(F.collect_list(F.struct("round", "plan", "code", "code_tokens"))).alias("turns"))
    t = nested.select("task_id", "trajectory_id", F.posexplode("turns").alias("at", "t"))
    prompt = F.concat(F.lit("Task state:\n"), "task_id", F.lit("\n\nPlanner guidance:\n"), F.col("t.plan"))
    return t.select(F.concat("task_id", F.lit("_round"), F.col("t.round").cast("string")).alias("state_id"), "trajectory_id", F.col("t.round").alias("round"), prompt.alias("prompt"), F.col("t.code").alias("code"), F.col("t.code_tokens").alias("coder_tokens"))


_STATES = _BEST + f""", st AS (SELECT b.*, concat(trajectory_id, '_round', round) AS state_id, coalesce(lag(code) OVER ({W}), '') AS previous_code,
 CASE WHEN max(incentive) OVER (PARTITION BY trajectory_id) > 0 THEN max(incentive) OVER (PARTITION BY trajectory_id) ELSE 0.08 END AS max_step FROM b),
js AS (SELECT st.*, t.prompt FROM st JOIN v_task t ON st.task_id = t.task_id)"""


def states(spark, d):
    return ss.build_states(turns(spark, d), view(spark, d, "v_task").select("task_id", "prompt"))


@query(with_views("v_turn", "v_task") + ", " + _STATES + " SELECT state_id, prompt, plan, previous_code, round(best_before, 6) AS best_before, round(max_step, 6) AS max_step_incentive, 'exp_token_difficulty' AS incentive_rule FROM js")
def build_states(spark, d):
    return states(spark, d).select("state_id", "prompt", "plan", "previous_code", R6(F.col("best_before")).alias("best_before"), R6(F.col("max_step_incentive")).alias("max_step_incentive"), "incentive_rule")


@query(with_views("v_turn", "v_task") + ", " + _STATES + """, q AS (SELECT *, row_number() OVER (PARTITION BY round > 1 ORDER BY ord) AS nth FROM js),
r AS (SELECT *, CASE WHEN round = 1 AND nth <= 20 THEN 0 WHEN round > 1 AND nth <= 30 THEN 1 ELSE 2 END AS stage FROM q)
SELECT state_id, row_number() OVER (ORDER BY stage, CASE WHEN stage < 2 THEN 0 WHEN round > 1 THEN 0 ELSE 1 END, ord) AS selected_at FROM r ORDER BY selected_at LIMIT 80""")
def state_selection(spark, d):
    return ss.selected(states(spark, d), 80, prefer_repair=True, most_first=20, most_repair=30).select("state_id", "selected_at")


@query(with_views("v_task") + " SELECT task_id FROM v_task WHERE ord % 7 = 3")
def modulo_shard(spark, d):
    return ss.shard(view(spark, d, "v_task"), 7, 3).select("task_id")


@query(with_views("v_task") + """ SELECT task_id, sample_index, temperature, 13 + 1000 * ord + 100 * sample_index + 10 AS planner_seed, 14 + 1000 * ord + 100 * sample_index + 10 AS coder_seed, concat('traj_', lpad(CAST(ord * 3 + sample_index AS VARCHAR), 8, '0')) AS trajectory_id
FROM v_task, (VALUES (0, 0.2), (1, 0.7), (2, 1.0)) g(sample_index, temperature)""")
def sampling_grid(spark, d):
    return ss.grid(view(spark, d, "v_task"), [0.2, 0.7, 1.0], 13).select("task_id", "sample_index", "temperature", "planner_seed", "coder_seed", "trajectory_id")


SHUFFLE_SEED = 7919


@query()
def shuffled_budget(spark, d):
    """Each task with the static budget that a seeded shuffle of all tasks' budgets puts in its place."""
    t = view(spark, d, "v_task").select("ord", "task_id", "prompt_tokens")
    moved = ss.shuffled(t, SHUFFLE_SEED).select("shuffled_at", F.col("prompt_tokens").alias("budget"))
    return ss.placed(t).join(moved, F.col("place") == F.col("shuffled_at")).select("task_id", "budget")


@query()
def seeded_shuffle(spark, d):
    return ss.shuffled(view(spark, d, "v_task").select("ord", "task_id"), 11).select("task_id", "shuffled_at")


_KEYED = "sha256('{}:' || ord)"


@query(with_views("v_task") + f" SELECT task_id, row_number() OVER (ORDER BY {_KEYED.format(11)}, ord) - 1 AS shuffled_at FROM v_task")
def keyed_shuffle(spark, d):
    """A permutation drawn by a seed, for tables of any size."""
    return scattered(view(spark, d, "v_task").select("ord", "task_id"), 11).select("task_id", "shuffled_at")


@query(with_views("v_task") + f", a AS (SELECT task_id, row_number() OVER (ORDER BY ord) AS p FROM v_task), b AS (SELECT prompt_tokens, row_number() OVER (ORDER BY {_KEYED.format(SHUFFLE_SEED)}, ord) AS p FROM v_task) SELECT task_id, prompt_tokens AS budget FROM a JOIN b USING (p)")
def keyed_budget(spark, d):
    """As shuffled_budget, with a permutation for tables of any size: tasks and permuted budgets are joined by place."""
    t = view(spark, d, "v_task").select("ord", "task_id", "prompt_tokens")
    moved = scattered(t, SHUFFLE_SEED).select(F.col("shuffled_at").alias("place"), F.col("prompt_tokens").alias("budget"))
    return ss.placed(t).join(moved, "place").select("task_id", "budget")


@query(with_views("v_traj") + """, f AS (SELECT task_id, min(CAST(split_part(trajectory_id, '_', 1) AS BIGINT) * 100 + ord) AS f FROM v_traj GROUP BY 1 ORDER BY f LIMIT 50)
SELECT trajectory_id FROM (SELECT trajectory_id, CAST(split_part(trajectory_id, '_', 1) AS BIGINT) * 100 + ord AS o FROM v_traj WHERE task_id IN (SELECT task_id FROM f)) ORDER BY o LIMIT 120""")
def limit_trajectories(spark, d):
    t = view(spark, d, "v_traj").withColumn("place", F.split("trajectory_id", "_")[0].cast("bigint") * 100 + F.col("ord"))
    return ss.limited(t, 50, 120, order="place").select("trajectory_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS ord FROM events GROUP BY user_id")
def keyed_last_wins(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.col("event_id").alias("ord"))
    return ss.last_of_each(e, "user_id").select("user_id", "event_type", "ord")


@query(with_views("v_task") + " SELECT task_id, coalesce(source_task_id, task_id) AS source_task_id, coalesce(split, '') AS split FROM v_task ORDER BY ord LIMIT 200")
def task_scan_defaults(spark, d):
    return readers.with_task_defaults(view(spark, d, "v_task"), 200).select("task_id", "source_task_id", "split")


@query(with_views("v_task") + " SELECT task_id, split FROM v_task WHERE split IS NOT NULL ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, ord LIMIT 700")
def split_union_limit(spark, d):
    t = view(spark, d, "v_task").where("split is not null")
    return readers.union_in_order([t.where(F.col("split") == s) for s in ("train", "valid", "test")], 700).select("task_id", "split")


@query(with_views("v_task") + " SELECT task_id, row_number() OVER (ORDER BY ord % 4, ord) AS place FROM v_task")
def shard_merge(spark, d):
    t = view(spark, d, "v_task")
    merged = readers.union_in_order([ss.shard(t, 4, k) for k in range(4)])
    return numbered(merged.select("task_id", "file_rank", "ord"), ["file_rank", "ord"], first=1).select("task_id", "place")


@query(with_views("v_task", "v_turn") + " SELECT task_id FROM v_task WHERE task_id NOT IN (SELECT task_id FROM v_turn WHERE passed)")
def resume_antijoin(spark, d):
    done = turns(spark, d).where("passed").select("task_id").distinct()
    return view(spark, d, "v_task").join(done, "task_id", "left_anti").select("task_id")


@query("SELECT DISTINCT method FROM (" + with_views("v_run") + " SELECT method FROM v_run) WHERE method NOT IN ('direct_prompt', 'cot', 'self_consistency_3', 'self_repair', 'mad', 'agentcoder')")
def unknown_methods(spark, d):
    known = spark.createDataFrame([(m,) for m in ("direct_prompt", "cot", "self_consistency_3", "self_repair", "mad", "agentcoder")], "method string")
    return view(spark, d, "v_run").select("method").distinct().join(F.broadcast(known), "method", "left_anti")


@query("SELECT count(*) AS lines FROM conversations WHERE regexp_matches(text, '\\S')")
def count_nonblank(spark, d):
    lines = spark.read.parquet(f"{d}/conversations.parquet").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value"))
    path = scratch(spark)
    lines.write.mode("overwrite").text(path)
    return readers.count_lines(spark, path)


@query("SELECT conv_id, turn, role, text, CAST(turn AS DOUBLE) / 4 AS quarter FROM conversations")
def scan_jsonl_roundtrip(spark, d):
    path = scratch(spark)
    df = spark.read.parquet(f"{d}/conversations.parquet").withColumn("quarter", F.col("turn") / 4)
    readers.write_jsonl(df, path)
    return readers.read_jsonl(spark, path, df.schema)


@query(with_views("v_task") + """, f AS (SELECT task_id, row_number() OVER (ORDER BY ord) - 1 AS i FROM v_task QUALIFY i < 50)
SELECT CAST(s.s AS INT) AS step, CAST(m.m AS INT) AS micro, CAST(b.b AS INT) AS slot, task_id FROM range(0, 20) s(s), range(0, 3) m(m), range(0, 4) b(b) JOIN f ON f.i = ((s.s * 3 + m.m) * 4 + b.b) % 50""")
def batch_schedule(spark, d):
    from pyspark.sql import Window

    first = ss.limited(view(spark, d, "v_task"), None, 50).select("task_id", (F.row_number().over(Window.orderBy("ord")) - 1).cast("bigint").alias("ord"))
    return ss.batch_schedule(first, 50, 20, 3, 4).select("step", "micro", "slot", "task_id")


@query("""SELECT conv_id, turn, list_slice(p, greatest(1, len(p) - greatest(1, 24 - len(c)) + 1), len(p)) AS prompt, c AS response FROM (SELECT conv_id, turn, p, CASE WHEN len(e) >= 24 THEN list_append(list_slice(e, 1, 23), 0) ELSE e END AS c
FROM (SELECT conv_id, turn, range(1, length(text) % 50 + 2) AS p, CASE WHEN turn % 2 = 0 THEN list_append(range(1, length(text) % 37 + 2), 0) ELSE list_append(range(1, length(text) % 37 + 2), 0) END AS e FROM conversations))""")
def seq_truncate(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    n = F.length("text")
    prompt = F.sequence(F.lit(1).cast("bigint"), (n % 50 + 1).cast("bigint"))
    body = F.sequence(F.lit(1).cast("bigint"), (n % 37 + 1).cast("bigint"))
    response = F.when(F.col("turn") % 2 == 0, F.concat(body, F.array(F.lit(0).cast("bigint")))).otherwise(body)
    return t.select("conv_id", "turn", tx.sequence_plan(prompt, response, 24, 0).alias("s")).select("conv_id", "turn", "s.prompt", "s.response")


@query("""SELECT conv_id, turn, list_concat(range(1, n + 1), list_resize(CAST([] AS BIGINT[]), 30 - n, -100)) AS labels FROM (SELECT conv_id, turn, length(text) % 30 + 1 AS n FROM conversations)""")
def pad_labels(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet")
    tokens = F.sequence(F.lit(1).cast("bigint"), (F.length("text") % 30 + 1).cast("bigint"))
    return t.select("conv_id", "turn", tx.padded(tokens, F.lit(30), -100).cast("array<bigint>").alias("labels"))
