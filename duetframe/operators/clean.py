"""Cleaning of leader pairs: basic and gated filters, first-reason counts, duplicates and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, overreach_basic, overreach_extended, strip, text_hash
from .pairs import first_of_each


def clean_basic(df: DataFrame, text: str = "chosen", order: str = "ord") -> DataFrame:
    """Without rows that overstep, then of equal normalised texts the first."""
    return first_of_each(df.where(~overreach_basic(F.col(text))).withColumn("__k", normalize(F.col(text))), ["__k"], [F.col(order)]).drop("__k")


def drop_reason(chosen: Column, rejected: Column, has_metrics: Column, pass_rate: Column, passed: Column, utility: Column, min_chars: int = 80, min_pass_rate: float | None = None, require_passed: bool = False, min_utility: float | None = None, drop_rejected_overreach: bool = False) -> Column:
    """The first rule that a row breaks, else null."""
    c = F.when((F.length(strip(chosen)) < min_chars) | (F.length(strip(rejected)) < min_chars), "short").when(overreach_extended(strip(chosen)), "chosen_overreach")
    if drop_rejected_overreach:
        c = c.when(overreach_extended(strip(rejected)), "rejected_overreach")
    if min_pass_rate is not None or require_passed:
        c = c.when(~has_metrics, "missing_chosen_metrics")
        if min_pass_rate is not None:
            c = c.when(F.coalesce(pass_rate, F.lit(0.0)) < min_pass_rate, "chosen_pass_rate")
        if require_passed:
            c = c.when(~F.coalesce(passed, F.lit(False)), "chosen_not_passed")
    if min_utility is not None:
        c = c.when(F.coalesce(utility, F.lit(0.0)) < min_utility, "chosen_utility")
    return c


def dedup_and_cap(df: DataFrame, cap: int, task: str = "task_id", text: str = "chosen", order: tuple = ("utility_delta", "weight", "ord")) -> DataFrame:
    """Adds outcome (accepted, duplicate, cap), each text counted within its task.

    Rows of a task are taken in order of falling utility_delta and weight. A row whose text was accepted is a duplicate;
    else, when the task has its fill, it is over the cap; only accepted rows count for either. The first ``cap``
    different texts of a task are therefore the accepted ones, which windows can tell: a text's rank is that of its first
    row among first rows. cap <= 0 sets no cap. See dedup_and_cap_across for texts that several tasks share.
    """
    by = [F.col(order[0]).desc(), F.col(order[1]).desc(), F.col(order[2])]
    df = df.withColumn("__h", text_hash(F.col(text)))
    seen = df.withColumn("__n", F.row_number().over(Window.partitionBy(task, "__h").orderBy(*by)))
    ranked = seen.withColumn("__rank", F.sum(F.when(F.col("__n") == 1, 1).otherwise(0)).over(Window.partitionBy(task).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("__n") == 1, F.col("__rank"))).over(Window.partitionBy(task, "__h"))
    inside = F.lit(True) if cap <= 0 else first <= cap
    ranked = ranked.withColumn("__in", inside)
    outcome = F.when(F.col("__in") & (F.col("__n") == 1), "accepted").when(F.col("__in"), "duplicate").otherwise("cap")
    return ranked.withColumn("outcome", outcome).drop("__h", "__n", "__rank", "__in")


def dedup_and_cap_across(df: DataFrame, cap: int, task: str = "task_id", text: str = "chosen", order: tuple = ("utility_delta", "weight", "ord"), rounds: int | None = None) -> DataFrame:
    """As dedup_and_cap, but a text accepted for a task that comes earlier (by name, null first) blocks it in later ones as well.

    Whether a text is accepted depends on earlier tasks alone, so tasks are settled in waves: a task is ready once every
    earlier task that shares a text with it is settled, unless the text has been accepted already. Each wave settles the
    first task of those left, and until no shared text is open it accepts one of them, so there are at most as many
    waves as tasks, or as shared texts and one. Texts of one task alone never wait. Each wave is a window query; its
    result is written before the next. With ``rounds``, more waves than that are an error.
    """
    from ..sources.tables import stored

    base = stored(df.withColumns({"__h": text_hash(F.col(text)), "__t": F.struct(F.col(task).alias("t"))}))
    shared = base.where("__h is not null").select("__t", "__h").distinct()
    waiting = stored(shared.join(shared.groupBy("__h").agg(F.count("*").alias("n")).where("n > 1").select("__h"), "__h"))
    left, taken, done = stored(base.select("__t").distinct()), None, []
    while True:
        if rounds is not None and len(done) >= rounds:
            raise RuntimeError(f"{left.count()} tasks are left after {rounds} waves")
        firsts = waiting.groupBy("__h").agg(F.min("__t").alias("first"))
        blocked = waiting.join(firsts, "__h").where(F.col("__t") > F.col("first")).select("__t").distinct()
        now = stored(left.join(blocked, "__t", "left_anti"))
        ready = base.join(now, "__t").drop("__t")
        if taken is None:
            out = stored(dedup_and_cap(ready.drop("__h"), cap, task, text, order))
        else:
            ready = ready.join(taken.withColumn("__taken", F.lit(True)), "__h", "left")
            free = dedup_and_cap(ready.where("__taken is null").drop("__h", "__taken"), cap, task, text, order)
            known = ready.where("__taken").drop("__h", "__taken").withColumn("outcome", F.lit("duplicate"))
            out = stored(free.unionByName(known))
        done.append(out)
        left = stored(left.join(now, "__t", "left_anti"))
        if left.isEmpty():
            break
        accepted = out.where("outcome = 'accepted'").select(text_hash(F.col(text)).alias("__h")).where("__h is not null").distinct()
        taken = stored(accepted if taken is None else taken.union(accepted).distinct())
        waiting = stored(waiting.join(now, "__t", "left_anti").join(taken, "__h", "left_anti"))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
