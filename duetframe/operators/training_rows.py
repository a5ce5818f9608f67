"""Training rows (ShareGPT style) from pairs, and the examples of initial and repair rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import repair_request
from ..functions.text import rstrip, sharegpt

# What the two roles are told, and the names of the metadata of a row.
LEADER_SYSTEM = "You are the leader/planner in a planner-coder code generation team. Give concise, actionable guidance. Do not write code."
FOLLOWER_SYSTEM = "You are the follower/coder in a planner-coder code generation team. Return only valid Python code. Do not include markdown fences, prose, tests, or examples."
LEADER_ASK = "\n\nCreate an implementation plan for the coder.\nStart with exactly one line: Estimated effort tokens: N\nThen mention the core algorithm and key edge cases. Do not write code."
FOLLOWER_ASK = "\n\nWrite the complete Python function requested by the task. Return Python code only."


def _measures(pairs: DataFrame) -> list[Column]:
    """What a pair was chosen by: null where its columns don't have it, except for the weight (1)."""
    there = lambda c, other: F.col(c).cast("double") if c in pairs.columns else F.lit(other).cast("double")
    return [there(c, None).alias(c) for c in ("chosen_utility", "rejected_utility", "utility_delta")] + [F.coalesce(there("weight", 1.0), F.lit(1.0)).alias("weight")]


def leader_rows(pairs: DataFrame, states: DataFrame | None) -> DataFrame:
    """pairs: task_id, chosen_id, rejected_id, chosen, rejected, utility_delta, weight; states: trajectory_id, state_text.

    The metadata also has the utilities of both sides, if pairs has chosen_utility and rejected_utility. A pair whose chosen trajectory isn't there gets an empty state.
    There are many more pairs than trajectories: where state_text can come with the chosen side, pairs has it and states is None.
    """
    j = pairs if states is None else pairs.join(states.withColumnRenamed("trajectory_id", "chosen_id"), "chosen_id", "left")
    human = F.concat(F.lit("Task state:\n"), F.coalesce("state_text", F.lit("")), F.lit(LEADER_ASK))
    metadata = F.struct(F.lit("leader_initial").alias("stage"), "task_id", F.col("chosen_id").alias("chosen_trajectory_id"), F.col("rejected_id").alias("rejected_trajectory_id"), *_measures(pairs))
    return j.select(*sharegpt(LEADER_SYSTEM, human, F.col("chosen"), F.col("rejected"), metadata, F.col("weight")))


def follower_rows(pairs: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """As leader_rows with candidates (candidate_id, prompt); a pair whose chosen candidate isn't there is left out.
    Where pairs has the prompt, candidates is None and all pairs stay."""
    j = pairs if candidates is None else pairs.join(candidates.select(F.col("candidate_id").alias("chosen_id"), "prompt"), "chosen_id")
    human = F.when(F.coalesce("prompt", F.lit("")) != "", F.col("prompt")).otherwise(F.concat(F.lit("Task state id: "), "state_id", F.lit(FOLLOWER_ASK)))
    metadata = F.struct(F.lit("follower_code").alias("stage"), "task_id", "state_id", F.col("chosen_id").alias("chosen_candidate_id"), F.col("rejected_id").alias("rejected_candidate_id"), *_measures(pairs))
    return j.select(*sharegpt(FOLLOWER_SYSTEM, human, rstrip(F.col("chosen")), rstrip(F.col("rejected")), metadata, F.col("weight")))


def with_references(pairs: DataFrame, trajectories: DataFrame, row: Column) -> DataFrame:
    """Adds chosen_row and rejected_row (null where the trajectory isn't there)."""
    one = trajectories.select("trajectory_id", row.alias("r"))
    return pairs.join(one.select(F.col("trajectory_id").alias("chosen_id"), F.col("r").alias("chosen_row")), "chosen_id", "left").join(one.select(F.col("trajectory_id").alias("rejected_id"), F.col("r").alias("rejected_row")), "rejected_id", "left")


def usable(a: Column, b: Column) -> Column:
    """Two plans that both say something and not the same."""
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (a != b)


def initial_examples(pairs: DataFrame) -> DataFrame:
    """pairs with chosen_row.turns and rejected_row.turns: the first plans, where they are usable."""
    a, b = (F.get(F.col(f"{side}_row.turns"), F.lit(0))["plan"] for side in ("chosen", "rejected"))
    return pairs.where("chosen_row is not null and rejected_row is not null").withColumns({"chosen_plan": a, "rejected_plan": b}).where(usable(F.col("chosen_plan"), F.col("rejected_plan")))


def repair_examples(pairs: DataFrame, turns: DataFrame, same: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Turns after the first that both sides of a pair reached from the same state: one row each, with kept (usable).

    turns: trajectory_id, round, plan, and signature of the state the turn starts from (functions.feedback.state_signature:
    task, code before, and the whole compact feedback). Turns are joined by pair and round, so a pair costs no more rows
    than its shorter side has turns.

    same: where signatures cost much, a function that adds ``same`` (whether both sides start from one state) to the
    joined rows, of which it needs to say nothing unless ``usable`` is true. Turns then have a struct ``signature`` of
    what it needs; it finds them as chosen_start and rejected_start.
    """
    later = turns.where("round > 1")
    a = pairs.join(later.select(F.col("trajectory_id").alias("chosen_id"), "round", F.col("plan").alias("chosen_plan"), F.col("signature").alias("chosen_start")), "chosen_id")
    b = later.select(F.col("trajectory_id").alias("rejected_id"), "round", F.col("plan").alias("rejected_plan"), F.col("signature").alias("rejected_start"))
    both = a.join(b, ["rejected_id", "round"]).withColumn("usable", usable(F.col("chosen_plan"), F.col("rejected_plan")))
    told = same(both) if same else both.withColumn("same", F.col("chosen_start") == F.col("rejected_start"))
    return told.withColumn("kept", F.col("usable") & F.col("same")).drop("chosen_start", "rejected_start", "usable", "same")


def repair_rows(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """Training rows of the kept repair examples, with round.

    pairs: as for leader_rows; turns: as for repair_examples, with state_text, previous_code and previous_feedback (the
    compact text) of the turn, which the request shows as the chosen side saw them.
    """
    kept = repair_examples(pairs, turns).where("kept")
    seen = turns.select(F.col("trajectory_id").alias("chosen_id"), "round", "state_text", "previous_code", "previous_feedback")
    j = kept.join(seen, ["chosen_id", "round"])
    human = repair_request(F.col("state_text"), F.col("previous_code"), F.col("previous_feedback"))
    metadata = F.struct(F.lit("leader_repair_strict").alias("stage"), "round", "task_id", F.col("chosen_id").alias("chosen_trajectory_id"), F.col("rejected_id").alias("rejected_trajectory_id"), *_measures(j))
    return j.select(*sharegpt(LEADER_SYSTEM, human, F.col("chosen_plan"), F.col("rejected_plan"), metadata, F.lit(1.0)))
