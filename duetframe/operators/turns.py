"""Sequence operators over the turns of a trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.utility import clamp01

KEY, ORDER = "trajectory_id", "round"


def _before(key: str = KEY, order: str = ORDER):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def with_previous(turns: DataFrame) -> DataFrame:
    """Adds what the turn before wrote and got: previous_code ("" at first), previous_error and previous_pass_rate (null)."""
    w = Window.partitionBy(KEY).orderBy(ORDER)
    return turns.withColumns({"previous_code": F.lag("code", 1, "").over(w), "previous_error": F.lag("error_type").over(w), "previous_pass_rate": F.lag("pass_rate").over(w)})


def with_best_before(turns: DataFrame) -> DataFrame:
    """Adds best_before: the highest pass rate (0 to 1) of the turns before, 0 at first."""
    return turns.withColumn("best_before", F.coalesce(F.max(clamp01(F.col("pass_rate"))).over(_before()), F.lit(0.0)))


def until_passed(turns: DataFrame) -> DataFrame:
    """Turns up to the first that passed, that one included."""
    n = F.sum(F.col("passed").cast("int")).over(_before())
    return turns.withColumn("__p", n).where("coalesce(__p, 0) = 0").drop("__p")


def best_first(pass_rate: str = "pass_rate", passed: str = "passed", tokens: str = "code_tokens", order: str = ORDER) -> list[Column]:
    """Best first: highest pass rate, passed, fewest tokens, earliest."""
    return [clamp01(F.col(pass_rate)).desc(), F.col(passed).desc(), F.col(tokens).asc(), F.col(order).asc()]


def best_turn(turns: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(*best_first())
    return turns.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def training_text(rounds_and_plans: Column) -> Column:
    """The plans of array<struct<round, plan>>, sorted, each under a heading."""
    label = lambda t: F.when(t["round"] == 1, "Initial plan").otherwise(F.concat(F.lit("Repair plan round "), t["round"].cast("string")))
    parts = F.transform(F.array_sort(rounds_and_plans), lambda t: F.concat(label(t), F.lit(":\n"), strip(t["plan"])))
    return F.concat(strip(F.array_join(parts, "\n\n")), F.lit("\n"))


def rollup(turns: DataFrame) -> DataFrame:
    """One row for each trajectory: sums, first plan, last code, number of rounds, best and last pass rate, all turns."""
    return turns.groupBy(KEY).agg(
        F.sum("plan_tokens").alias("planner_tokens"),
        F.sum("code_tokens").alias("coder_tokens"),
        F.min_by("plan", ORDER).alias("plan"),
        F.max_by("code", ORDER).alias("code"),
        F.max(ORDER).alias("rounds"),
        F.max(clamp01(F.col("pass_rate"))).alias("best_pass_rate"),
        F.max_by("pass_rate", ORDER).alias("pass_rate"),
        F.max_by("passed", ORDER).alias("passed"),
        F.array_sort(F.collect_list(F.struct(ORDER, "plan", "code", "plan_tokens", "code_tokens", "pass_rate", "error_type"))).alias("turns"),
    )


def normalized(trajectories: DataFrame) -> DataFrame:
    """Fills what a trajectory row leaves open from its turns: tokens, plan, code, pass rate."""
    turns = F.col("turns")

    def total(c: str) -> Column:
        return F.aggregate(turns, F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(t[c], F.lit(0)))

    sums = {c: total(c) for c in ("plan_tokens", "code_tokens")}
    said = F.coalesce("communication_tokens", F.lit(0)).cast("bigint")
    both = F.when((said == 0) & (F.size(turns) > 0), sums["plan_tokens"] + sums["code_tokens"]).otherwise(said)
    return trajectories.withColumns(
        {
            "communication_tokens": both,
            "total_tokens": F.coalesce("context_tokens", F.lit(0)).cast("bigint") + both,
            "plan": F.coalesce(F.nullif("plan", F.lit("")), F.try_element_at(turns, F.lit(1))["plan"], F.lit("")),
            "code": F.coalesce(F.nullif("code", F.lit("")), F.try_element_at(turns, F.lit(-1))["code"], F.lit("")),
            "pass_rate": F.coalesce("pass_rate", F.lit(0.0)),
        }
    )
