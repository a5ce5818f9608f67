"""Generation by replay, the interaction loop over replayed turns, and the baseline methods.

A model is nothing but a table of what it said: requests are joined with it. Anything that makes such a table (a model
server behind mapInArrow, say) can stand in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import UtilityConfig
from ..functions.utility import clamp01, leader_utility, step_incentive
from .turns import best_first, until_passed, with_best_before

METHODS = ("direct_prompt", "cot", "self_consistency_3", "self_repair", "mad", "agentcoder")


def replay(requests: DataFrame, said: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Requests with what the table holds for them; the run fails at a request that has no answer in it."""
    joined = requests.join(said.select(*keys, F.col(text).alias("generated_text")), keys, "left")
    return joined.where(F.assert_true(F.col("generated_text").isNotNull(), F.lit("a request without a replayed answer")).isNull())


def replayed_trajectories(turns: DataFrame, budget: float, max_step: float, cfg: UtilityConfig) -> DataFrame:
    """Trajectories of turns that are known beforehand: stopped at the first that passes, with incentives and utility."""
    t = until_passed(with_best_before(turns))
    t = t.withColumn("step", step_incentive(F.col("pass_rate"), F.col("best_before"), F.lit(budget), F.lit(max_step)))
    g = t.groupBy("trajectory_id").agg(
        F.max("round").alias("rounds"),
        F.sum(F.col("plan_tokens") + F.col("code_tokens")).alias("communication_tokens"),
        F.sum("step").alias("incentive_total"),
        F.max_by(clamp01(F.col("pass_rate")), "round").alias("pass_rate"),
        F.bool_or("passed").alias("passed"),
    )
    return g.withColumn("leader_utility", leader_utility(F.col("pass_rate"), F.col("rounds"), F.col("communication_tokens"), cfg, F.col("incentive_total")))


def baselines(generations: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Every method on every task, from replayed generations (task_id, call, prompt_tokens, completion_tokens, pass_rate, passed).

    Which calls a method makes depends on the first one's outcome at most: one for direct prompting and chain of thought,
    three independent ones, a repair after a failure, three plans and a final answer, or code, tests and a repair. A
    candidate costs its own tokens where candidates are independent, else all that was spent up to it. The best one by
    pass rate, passing and fewest tokens is selected; total_tokens counts all calls made.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}")
    call = F.col("call")
    each = generations.withColumn("method", F.explode(F.array(*(F.lit(m) for m in methods))))
    first = F.max((call == 0) & F.col("passed")).over(Window.partitionBy("method", "task_id"))
    each = each.withColumn("__ok", first)
    made = {
        "direct_prompt": call == 0,
        "cot": call == 0,
        "self_consistency_3": call < 3,
        "self_repair": (call == 0) | ((call == 1) & ~F.col("__ok")),
        "mad": call < 4,
        "agentcoder": (call < 2) | ((call == 2) & ~F.col("__ok")),
    }
    used = F.lit(False)
    for m in methods:
        used = used | ((F.col("method") == m) & made[m])
    order = Window.partitionBy("method", "task_id").orderBy("call")
    each = each.where(used).withColumn("own", (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint"))
    each = each.withColumn("spent", F.sum("own").over(order))
    each = each.withColumn("tokens", F.when(F.col("method") == "self_consistency_3", F.col("own")).otherwise(F.col("spent")))
    answer = ~((F.col("method") == "mad") & (call < 3)) & ~((F.col("method") == "agentcoder") & (call == 1))
    rank = F.row_number().over(Window.partitionBy("method", "task_id").orderBy(F.when(answer, 0).otherwise(1), *best_first(tokens="tokens", order="call")))
    each = each.withColumns({"__answer": answer, "__rank": rank})
    best = F.first(F.when(F.col("__answer") & (F.col("__rank") == 1), F.struct("call", "pass_rate", "passed")), ignorenulls=True)
    out = each.groupBy("method", "task_id").agg(F.count("*").alias("num_generations"), F.sum("own").alias("total_tokens"), best.alias("b")).where("b is not null")
    return out.select("method", "task_id", "num_generations", "total_tokens", F.col("b.call").alias("selected_call"), F.col("b.pass_rate").alias("pass_rate"), F.col("b.passed").alias("passed"))
