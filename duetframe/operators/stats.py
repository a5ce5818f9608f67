"""Summaries, percentiles by nearest index, health and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import nearest_ranks, values_at


def nearest(sorted_values: Column, q: float) -> Column:
    """The value at index round((n - 1) * q), halves to even, of a sorted array; 0 of an empty one."""
    at = F.bround((F.size(sorted_values) - 1) * F.lit(q)).cast("int")
    return F.when(F.size(sorted_values) > 0, F.get(sorted_values, at)).otherwise(0.0)


def exact_percentiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """Nearest-index percentiles of each group (or of all rows) without gathering a group in one row.

    Distinct values are counted first (with partial counts). Of all rows, the values are picked from the ranges of values
    that hold their ranks (ranks.values_at). Of groups, a window goes over each group's distinct values: where a running
    count passes an index stands its value.
    """
    if not group:
        got = values_at(df, value, nearest_ranks(shares))
        return df.sparkSession.createDataFrame([tuple(got[name] for name in shares)], ", ".join(f"`{name}` double" for name in shares))
    counts = df.groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*group).orderBy("v")
    run = counts.withColumns({"upto": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy(*group))})
    hit = lambda q: F.max(F.when((F.bround((F.col("n") - 1) * F.lit(q)) >= F.col("upto") - F.col("c")) & (F.bround((F.col("n") - 1) * F.lit(q)) < F.col("upto")), F.col("v")))
    return run.groupBy(*group).agg(*(hit(q).alias(name) for name, q in shares.items()))


def median(df: DataFrame, value: str) -> float | None:
    """The middle value of all rows, or the mean of the two middle ones; None of nothing."""
    got = values_at(df, value, lambda n: {"low": (n - 1) // 2, "high": n // 2})
    return None if got["low"] is None else (got["low"] + got["high"]) / 2


def rate(count: Column, total: Column) -> Column:
    """count / total, 0 of nothing."""
    return F.coalesce(count / F.nullif(total, F.lit(0)), F.lit(0.0))


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def weight_summary(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """One row on the weights and deltas of pairs, from one pass over them."""
    w, d = F.col("weight"), F.col("utility_delta")
    return pairs.agg(
        F.count("*").alias("count"),
        F.coalesce(F.min(w), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(w), F.lit(0.0)).alias("max"),
        mean(w).alias("mean"),
        F.coalesce(F.stddev_pop(w), F.lit(0.0)).alias("stdev"),
        F.count_if(w <= low + 1e-8).alias("clipped_low"),
        F.count_if(w >= high - 1e-8).alias("clipped_high"),
        mean(d).alias("delta_mean"),
        F.min(d).alias("delta_min"),
        F.max(d).alias("delta_max"),
    )


def weight_stats(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """weight_summary with percentiles, which take another pass when the plan is made."""
    base = weight_summary(pairs, low, high)
    cuts = exact_percentiles(pairs, "weight", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return base.crossJoin(F.broadcast(cuts.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in cuts.columns))))


def side_lookups(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """state_id, wrong (pairs whose chosen utility isn't the higher one) and odd: whether some side of the state's pairs
    isn't found, is found twice, or is found under another state, or two of them differ in what is found.

    pairs: state_id, c and r (ids of the sides), uc and ur (their utilities); found: id and found, a struct of s (state),
    t and round. A side is one row here however many pairs it is in, and no pair is moved: they lie by state already.
    """
    sides = F.explode(F.array(F.struct(F.col("c").alias("id"), (F.col("uc") <= F.col("ur")).cast("int").alias("wrong")), F.struct(F.col("r").alias("id"), F.lit(0).alias("wrong")))).alias("x")
    refs = pairs.select("state_id", sides).groupBy("state_id", F.col("x.id").alias("id")).agg(F.sum("x.wrong").alias("wrong"))
    once = found.groupBy("id").agg(F.count("*").alias("n"), F.min("found").alias("found"))
    looked = refs.join(once, "id", "left")
    own = F.coalesce((F.col("n") == 1) & (F.col("found.s") == F.col("state_id")), F.lit(False))
    looked = looked.select("state_id", "wrong", own.alias("own"), F.struct("found.t", "found.round").alias("rest"))
    states = looked.groupBy("state_id").agg(F.sum("wrong").alias("wrong"), F.bool_and("own").alias("own"), F.min("rest").alias("a"), F.max("rest").alias("b"))
    return states.select("state_id", "wrong", (~F.col("own") | ~F.col("a").eqNullSafe(F.col("b"))).alias("odd"))


def trajectory_health(trajectories: DataFrame) -> DataFrame:
    """Counts and rates of trajectories; an error counts once for a trajectory, whichever turn it is in."""

    def has(kind: str) -> Column:
        return F.exists("turns", lambda t: F.contains(F.coalesce(t["error_type"], F.lit("")), F.lit(kind)))

    n = F.count("*")
    syntax, indent = F.count_if(has("SyntaxError")), F.count_if(has("IndentationError"))
    passed, positive = F.count_if("passed"), F.count_if(F.coalesce("best_pass_rate", "pass_rate", F.lit(0.0)) > 0)
    return trajectories.agg(
        n.alias("trajectories"),
        passed.alias("passed"),
        positive.alias("positive_pass_rate"),
        rate(passed, n).alias("passed_rate"),
        rate(positive, n).alias("positive_pass_rate_fraction"),
        syntax.alias("syntax_error_trajectories"),
        indent.alias("indentation_error_trajectories"),
        rate(syntax, n).alias("syntax_error_rate"),
        rate(indent, n).alias("indentation_error_rate"),
        mean(F.col("rounds")).alias("avg_rounds"),
    )


def health_gates(summary: DataFrame, rules: list[tuple[str, str, float | None, float | None]]) -> DataFrame:
    """gate, metric, value, failed: every rule (gate, metric, min, max) against a one-row summary.

    A metric that the summary lacks fails as missing; a rule with neither limit always holds.
    """
    spark = summary.sparkSession
    table = spark.createDataFrame(rules, "gate string, metric string, low double, high double")
    numbers = [c for c, t in summary.dtypes if t in ("int", "bigint", "double", "float")]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers))
    values = summary.select(F.explode(pairs).alias("p")).select("p.*")
    joined = table.join(values, "metric", "left")
    bound = F.col("low").isNotNull() | F.col("high").isNotNull()
    failed = F.when(bound & F.col("value").isNull(), "missing").when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above")
    return joined.select("gate", "metric", "value", F.coalesce(failed, F.lit("")).alias("failed"))


def require(summary: DataFrame, rules: list, enabled: bool = True) -> list:
    """Raises if a gate fails; returns the gates' rows (as many as there are rules)."""
    got = health_gates(summary, rules).collect() if enabled else []
    if bad := [f"{r.gate}: {r.metric} {r.failed}" for r in got if r.failed]:
        raise RuntimeError("health gate failed: " + ", ".join(sorted(bad)))
    return got


def counter(df: DataFrame, key: str, name: str = "counts") -> DataFrame:
    """A one-row map of how often each value of the key occurs, sorted by it (keys are few: stages, splits, rounds)."""
    counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
