"""What sorts, shuffles and joins carry at scale, seen in the plans of the registered queries."""

import re

import pytest

from duetframe.plans import QUERIES

TINY = "/root/testdata/sf0.001"


def moved(df) -> list[str]:
    """The columns that each exchange of the plan takes."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)


@pytest.mark.parametrize("name", ["profile_requests", "follower_state_text", "state_signatures", "repair_requests"])
def test_feedback_texts_are_made_after_the_sort(spark, name):
    got = moved(QUERIES[name](spark, TINY))
    assert got and not any(re.search(r"\b(text|stderr|assert_results|previous_feedback)#", c) for c in got)


@pytest.mark.parametrize("name", ["repair_examples_strict", "round_conversion_all", "stage_counts"])
def test_states_are_compared_without_signatures_of_every_turn(spark, name):
    """Neither texts nor their digests are made before turns are joined, nor are all turns of a trajectory gathered."""
    df = QUERIES[name](spark, TINY)
    assert not any(re.search(r"\b(text|signature|previous_feedback)#", c) for c in moved(df))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "sha2(" not in plan and "collect_list" not in plan


def test_same_state_looks_at_texts_only_where_the_rest_is_equal(spark):
    from pyspark.sql import functions as F

    from duetframe.operators import training_rows as rows

    turns = spark.createDataFrame([(t, r, f"{t}{r}" if t != "d" else f"a{r}", c) for t, c in zip("abcd", (1, 1, 2, 1)) for r in (1, 2)], "trajectory_id string, round int, plan string, signature int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "chosen_id string, rejected_id string")
    same = lambda both: both.withColumn("same", F.when(F.col("usable"), F.col("chosen_start") == F.col("rejected_start")))
    wanted = {("b", True), ("c", False), ("d", False)}
    for how in (None, same):
        assert {(r.rejected_id, r.kept) for r in rows.repair_examples(pairs, turns, how).collect()} == wanted


@pytest.mark.parametrize("name", ["leader_wpo", "follower_wpo"])
def test_texts_come_with_the_rows_and_not_by_joins_of_the_pairs(spark, name):
    got = moved(QUERIES[name](spark, TINY))
    assert got and not any(re.search(r"\b(chosen_id|rejected_id|chosen|rejected)#", c) for c in got)


def test_sides_of_pairs_are_looked_up_once_for_each_state(spark):
    from pyspark.sql import functions as F

    from duetframe.operators import stats

    rows = [(s, f"{s}{i}", s, "t", 1) for s in ("good", "lost", "twice", "other", "mixed", "down") for i in range(4)]
    found = [r[1:] for r in rows if r[1] != "lost2"] + [("twice1", "twice", "t", 1)]
    found = [(i, "good" if i == "other3" else s, t, 2 if i == "mixed0" else n) for i, s, t, n in found]
    found = spark.createDataFrame(found, "id string, s string, t string, round int").select("id", F.struct("s", "t", "round").alias("found"))
    pairs = [(s, f"{s}{i}", f"{s}{j}", 1.0, 1.0 if s == "down" and j == 3 else 0.0) for s in ("good", "lost", "twice", "other", "mixed", "down") for i in range(4) for j in range(i)] + [("down", "down0", "down3", 0.5, 0.5)]
    got = stats.side_lookups(spark.createDataFrame(pairs, "state_id string, c string, r string, uc double, ur double"), found)
    got = {r.state_id: (r.wrong, r.odd) for r in got.collect()}
    assert got == {"good": (0, False), "lost": (0, True), "twice": (0, True), "other": (0, True), "mixed": (0, True), "down": (1, False)}


def test_consistency_check_names_what_is_wrong(spark, monkeypatch):
    """Against the plain joins of all pairs: a missing side, one of another state, one in the wrong direction."""
    from pyspark.sql import functions as F

    from duetframe.plans import scoring

    right = scoring.gated_rows(spark, TINY)
    n = F.pmod(F.xxhash64("state_id"), F.lit(5))
    side = F.col("chosen").withField("candidate_id", F.when(n == 0, "nobody").when(n == 1, F.concat(F.lit("s1_1_"), F.lit(1))).otherwise(F.col("chosen.candidate_id"))).withField("utility", F.when(n == 2, F.col("rejected.utility")).otherwise(F.col("chosen.utility")))
    made = right.withColumn("chosen", side)
    monkeypatch.setattr(scoring, "gated_rows", lambda spark, d: made)
    cand = scoring.view(spark, TINY, "v_cand").select("candidate_id", F.struct("state_id", "task_id", "round").alias("s")).collect()
    at = {r.candidate_id: r.s for r in cand}
    p = [(at.get(r.chosen.candidate_id), at.get(r.rejected.candidate_id), r.chosen.utility <= r.rejected.utility) for r in made.collect()]
    wanted = (sum(a != b for a, b, _ in p), sum(a is None or b is None for a, b, _ in p), sum(w for *_, w in p))
    assert min(wanted) > 0 and tuple(scoring.verify_state_consistency(spark, TINY).first()) == wanted


def test_a_summary_without_percentiles_takes_no_pass_for_them(spark, monkeypatch):
    from duetframe.operators import stats

    monkeypatch.setattr(stats, "exact_percentiles", lambda *_: pytest.fail("percentiles that nobody asked for"))
    assert QUERIES["weight_stats_follower"](spark, TINY).first()["count"] > 0
