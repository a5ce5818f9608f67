"""Interaction states, their selection, shards, permutations and sampling grids."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered
from .turns import with_best_before, with_previous

#: A step's incentive where none is known.
DEFAULT_STEP = 0.08


def build_states(turns: DataFrame, tasks: DataFrame) -> DataFrame:
    """A state for each turn of a known task: what came before, the budget and the largest step incentive."""
    seen = with_best_before(with_previous(turns))
    most = F.max("incentive").over(Window.partitionBy("trajectory_id"))
    seen = seen.withColumns({"state_id": F.concat("trajectory_id", F.lit("_round"), F.col("round").cast("string")), "max_step_incentive": F.when(most > 0, most).otherwise(DEFAULT_STEP), "incentive_rule": F.lit("exp_token_difficulty")})
    return seen.join(tasks, "task_id")


def selected(states: DataFrame, limit: int, order: str = "ord", prefer_repair: bool = False, repair_only: bool = False, most_first: int | None = None, most_repair: int | None = None) -> DataFrame:
    """At most ``limit`` states: quotas of first and repair rounds in order, filled up from the rest.

    Where only one quota is given the other is 0. prefer_repair puts repair rounds first among the rest (or, without
    quotas, among all). Adds selected_at, from 1.
    """
    repair = F.col("round") > 1
    if repair_only:
        states = states.where(repair)
    first = F.when(repair, 0).otherwise(1) if prefer_repair else F.lit(0)
    if most_first is None and most_repair is None:
        rank = [first, F.col(order)]
    else:
        # of each kind no more rows than its quota and the limit can be selected: the numbering sees only those
        kind = F.coalesce(repair, F.lit(False))
        states = states.where(~kind).orderBy(order).limit((most_first or 0) + limit).unionByName(states.where(kind).orderBy(order).limit((most_repair or 0) + limit))
        nth = F.row_number().over(Window.partitionBy(repair).orderBy(order))
        states = states.withColumn("__quota", F.when(repair, nth <= (most_repair or 0)).otherwise(nth <= (most_first or 0)))
        stage = F.when(F.col("__quota") & ~repair, 0).when(F.col("__quota"), 1).otherwise(2)
        rank = [stage, F.when(F.col("__quota"), 0).otherwise(first), F.col(order)]
    top = states.withColumns({f"__r{i}": r for i, r in enumerate(rank)}).orderBy(*(f"__r{i}" for i in range(len(rank)))).limit(limit)
    out = top.withColumn("selected_at", F.row_number().over(Window.orderBy(*(f"__r{i}" for i in range(len(rank))))).cast("bigint"))
    return out.drop("__quota", *(f"__r{i}" for i in range(len(rank))))


def shard(df: DataFrame, shards: int, index: int, order: str = "ord") -> DataFrame:
    if shards < 1 or not 0 <= index < shards:
        raise ValueError("shard index out of range")
    return df.where(F.pmod(F.col(order), F.lit(shards)) == index)


def permutation(n: int, seed: int) -> list[int]:
    """A permutation of 0..n-1 that Python's generator makes of the seed."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def placed(df: DataFrame, order: str = "ord") -> DataFrame:
    """Adds place, the row's number in order, from 0."""
    return numbered(df, [order])


def shuffled(df: DataFrame, seed: int, order: str = "ord") -> DataFrame:
    """Rows with the place (shuffled_at) that a seeded shuffle of their ordinals gives them.

    The permutation has a number for each row; it is joined as a table, so order it on the driver only for tables whose
    rows are drawn one by one anyway (tasks, states of a run).
    """
    n = df.count()
    table = df.sparkSession.createDataFrame([(was, now) for now, was in enumerate(permutation(n, seed))] or [(None, None)], "__was bigint, shuffled_at bigint")
    nth = placed(df, order)
    return nth.join(table, nth["place"] == table["__was"]).drop("place", "__was")


def grid(tasks: DataFrame, temperatures: list[float], seed: int, rounds: int = 1, order: str = "ord", prefix: str = "traj") -> DataFrame:
    """Every task with every temperature: sample_index, temperature, seeds and a numbered id.

    The number is the task's ordinal times the temperatures plus the sample, as a counter over both would give; no
    sort of all rows is needed.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("sample_index"), F.lit(t).alias("temperature")) for i, t in enumerate(temperatures))))
    out = tasks.withColumn("__c", cells).select("*", "__c.*").drop("__c")
    number = F.col(order) * len(temperatures) + F.col("sample_index")
    planner = F.lit(seed) + 1000 * F.col(order) + 100 * F.col("sample_index") + 10 * rounds
    return out.withColumns({"planner_seed": planner.cast("bigint"), "coder_seed": (planner + 1).cast("bigint"), "trajectory_id": F.concat(F.lit(f"{prefix}_"), F.lpad(number.cast("string"), 8, "0"))})


def limited(df: DataFrame, max_tasks: int | None, max_rows: int | None, task: str = "task_id", order: str = "ord") -> DataFrame:
    """The rows of the first max_tasks tasks (by first appearance), of those the first max_rows."""
    if max_tasks is not None:
        first = df.groupBy(task).agg(F.min(order).alias("__first")).orderBy("__first").limit(max_tasks).select(task)
        df = df.join(F.broadcast(first), task)
    return df.orderBy(order).limit(max_rows) if max_rows is not None else df


def last_of_each(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Of the rows of a key the last, as loading rows into a map by key would leave."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, order).alias("__r")).select("__r.*")


def batch_schedule(df: DataFrame, items: int, steps: int, accumulation: int, batch_size: int, order: str = "ord") -> DataFrame:
    """step, micro, slot and the item (an ordinal below ``items``) that training takes there, going round."""
    spark = df.sparkSession
    n = steps * accumulation * batch_size
    at = spark.range(n).select((F.col("id") / (accumulation * batch_size)).cast("int").alias("step"), F.pmod((F.col("id") / batch_size).cast("int"), F.lit(accumulation)).alias("micro"), F.pmod("id", F.lit(batch_size)).cast("int").alias("slot"), F.pmod("id", F.lit(items)).alias("__item"))
    return at.join(df, at["__item"] == df[order]).drop("__item")
