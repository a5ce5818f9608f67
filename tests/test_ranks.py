"""Numbers, running totals, ranks and deltas against plain Python; no window over all rows in their plans."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duetframe.operators import pairs, ranks, states
from duetframe.operators.pairs import _largest_below


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def alone(df):
    """Whether a step of the plan brings all rows to one task."""
    return "SinglePartition" in plan(df)


@pytest.mark.parametrize("n", [0, 1, 7, 2000])
def test_numbered(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "a", "b", "c" * 9]), rng.random()) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ord long, k string, x double").repartition(5)
    got = ranks.numbered(df, [F.col("k").desc_nulls_last(), "ord"], first=1)
    want = sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0]))
    assert [r.ord for r in sorted(got.collect(), key=lambda r: r.place)] == [r[0] for r in want]
    assert sorted(r.place for r in got.collect()) == list(range(1, n + 1)) and not alone(got)
    moved = sorted((r.shuffled_at, r.ord) for r in ranks.scattered(df, 3).collect())
    assert [a for a, _ in moved] == list(range(n))
    again = sorted((r.shuffled_at, r.ord) for r in ranks.scattered(df.repartition(2), 3).collect())
    assert moved == again and (n < 9 or [b for _, b in moved] != sorted(b for _, b in moved))
    placed = states.placed(df)
    assert sorted((r.place, r.ord) for r in placed.collect()) == [(i, i) for i in range(n)] and not alone(placed)


def test_values_at(spark):
    rng = random.Random(1)
    for values in ([], [None], [2.5], [rng.choice([0.5, 1.0, 7.25, None]) for _ in range(999)], [rng.random() for _ in range(1500)]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        real = sorted(v for v in values if v is not None)
        shares = {f"p{i}": i / 10 for i in range(11)}
        got = ranks.values_at(df, "x", ranks.nearest_ranks(shares))
        assert got == {k: (real[round((len(real) - 1) * q)] if real else None) for k, q in shares.items()}


@pytest.mark.parametrize("groups", [["a"], ["a", "b", "b", "b", "c"], list("abcdefgh")])
def test_running_totals_over_many_ranges(spark, groups):
    rng = random.Random(len(groups))
    rows = [(rng.choice(groups), i, float(rng.randrange(-9, 9)), rng.choice([None, float(i)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, x double, p double").repartition(4)
    got = {r.o: (r.x_upto, r.p_upto) for r in ranks.running(df, "g", ["o"], ["x"], "p").collect()}
    total, latest = {}, {}
    for g, o, x, p in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0.0) + x
        latest[g] = p if p is not None else latest.get(g)
        assert got[o] == (total[g], latest[g])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-3, 3) | st.sampled_from([0.0, 0.03, 0.06, 0.31, -0.03]), min_size=1, max_size=20), st.sampled_from([0.0, 0.02, 0.03, 0.5, 45_000.0]))
def test_largest_below(us, margin):
    u = np.array(us)
    t = _largest_below(u, margin)
    assert (u - t > margin).all() and not (u - np.nextafter(t, np.inf) > margin).any()


@pytest.mark.parametrize("tile", [None, 7, 100])
def test_deltas_and_pairs_of_crowded_groups(spark, tile):
    rng = random.Random(5)
    rows = [("crowded" if i % 3 else rng.choice("xyz") if i % 2 else None, i, rng.choice([round(rng.uniform(-1, 1), 2), rng.random(), 0.03, 0.06, None]), f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, ord int, u double, text string").repartition(3)
    margin = 0.03
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if a[0] is not None and a[0] == b[0] and None not in (a[2], b[2]) and abs(a[2] - b[2]) > margin:
            want[a[1], b[1]] = (a[0], abs(a[2] - b[2]), (a if a[2] > b[2] else b)[3], (b if a[2] > b[2] else a)[3])
    made = pairs.pair_within(df, "g", "u", margin, tile=tile)
    got = [(r.ord_a, r.ord_b, (r.g, r.utility_delta, r.chosen.text, r.rejected.text)) for r in made.collect()]
    assert len(got) == len(want) and {(a, b): x for a, b, x in got} == want
    assert made.columns == ["g", "chosen", "rejected", "utility_delta", "ord_a", "ord_b"] and set(made.schema["chosen"].dataType.names) == {"g", "ord", "u", "text"}
    stats = pairs.delta_stats(df, "g", "u", margin, crowded=tile or 10_000)
    by = {}
    for g, d, *_ in want.values():
        by.setdefault(g, []).append(d)
    for way in (stats, pairs.swept_stats(df, "g", "u", margin)):
        found = {r.g: r for r in way.collect()}
        assert set(found) == set(by)
        for g, ds in by.items():
            r = found[g]
            assert (r.pairs, r.least, r.most) == (len(ds), min(ds), max(ds)) and abs(r.total - sum(ds)) < 1e-9 * len(ds)
    assert abs(pairs.mean_delta(stats) - sum(map(sum, by.values())) / len(want)) < 1e-9
    assert pairs.delta_stats(df.limit(0), "g", "u", margin).collect() == [] and pairs.mean_delta(stats.limit(0)) is None


def test_a_crowded_group_goes_to_many_tasks(spark):
    df = spark.range(50_000).select(F.lit("one").alias("g"), F.col("id").alias("ord"), F.col("id").cast("double").alias("u"))
    made = pairs.pair_within(df, "g", "u", 45_000.0, tile=5_000)
    sizes = made.groupBy(F.spark_partition_id().alias("p")).count()
    assert made.count() == sum(max(0, i - 45_000) for i in range(50_000)) == pairs.delta_stats(df, "g", "u", 45_000.0).first().pairs
    assert sizes.count() >= 3


@pytest.mark.parametrize("margin", [0.9, 0.5, 0.03])
def test_of_crowded_groups_only_rows_that_can_pair_are_looked_at(spark, margin, monkeypatch):
    """A high margin leaves few rows of a crowded group, which are joined; a low one leaves it to the sweep."""
    rng = random.Random(5)
    rows = [(f"g{i % 3}", round(rng.random() if i % 3 else rng.random() ** 4, 3)) for i in range(900)] + [("few", 0.0), ("few", 1.0)]
    swept = []
    monkeypatch.setattr(pairs, "swept_stats", lambda *a, f=pairs.swept_stats: swept.append(a[0].count()) or f(*a))
    got = {r.g: (r.pairs, round(r.total, 6), round(r.least, 9), round(r.most, 9)) for r in pairs.delta_stats(spark.createDataFrame(rows, "g string, u double"), "g", "u", margin).collect()}
    wanted = {}
    for g in {g for g, _ in rows}:
        u = sorted(x for k, x in rows if k == g)
        d = [b - a for i, a in enumerate(u) for b in u[i + 1 :] if b - a > margin]
        wanted[g] = (len(d), round(sum(d), 6), round(min(d), 9), round(max(d), 9))
    assert got == wanted and bool(swept) == (margin < 0.1)
