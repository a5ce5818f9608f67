"""Preference pairs: all pairs within a group that differ by more than a margin, oriented, gated and weighted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FollowerConfig, UtilityConfig
from ..functions.utility import raw_weight, weight
from ..sources.tables import stored
from .ranks import running


def pair_within(df: DataFrame, group: str, utility: str, margin: float, order: str = "ord", tile: int | None = None) -> DataFrame:
    """Each unordered pair of a group once: group, chosen and rejected (structs of the rows), utility_delta, ord_a, ord_b.

    The join is an equality on the group (so it hashes or sorts, and adaptive execution splits a crowded group) with
    the order and the margin as conditions of the join itself. Keep wide text out of ``df`` and join it on later.

    tile: groups with more rows than that are cut into tiles of about so many, and each pair of tiles is a join key of
    its own; a row goes to as many keys as its group has tiles. The groups are counted for that when the plan is made.
    """
    keys = [group]
    if tile:
        df, keys = _tiled(df, group, tile), [group, "__x", "__y"]
    row = F.struct(*(c for c in df.columns if c not in ("__tile", "__x", "__y")))
    own = [F.col("__tile")] if tile else []
    left = df.select(*keys, *own, F.col(order).alias("ord_a"), F.col(utility).alias("u_a"), row.alias("a"))
    right = df.select(*keys, *own, F.col(order).alias("ord_b"), F.col(utility).alias("u_b"), row.alias("b"))
    l, r = left.alias("l"), right.alias("r")
    wanted = (F.col("ord_a") < F.col("ord_b")) & (F.abs(F.col("u_a") - F.col("u_b")) > margin)
    for k in keys:
        wanted = (F.col(f"l.{k}") == F.col(f"r.{k}")) & wanted
    if tile:  # rows of one tile meet where it is paired with itself
        wanted = wanted & ((F.col("l.__x") == F.col("l.__y")) | (F.col("l.__tile") != F.col("r.__tile")))
    first = F.col("u_a") > F.col("u_b")
    return l.join(r, wanted).select(
        F.col(f"l.{group}").alias(group),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"),
        F.abs(F.col("u_a") - F.col("u_b")).alias("utility_delta"),
        "ord_a",
        "ord_b",
    )


#: Crowded groups that are sent to every task, at most; beyond that their table is joined by a shuffle.
MOST_SENT = 1_000_000


def _tiled(df: DataFrame, group: str, tile: int) -> DataFrame:
    """The rows with __tile, once for each pair of tiles (__x <= __y) that the row's tile is in."""
    crowded = df.groupBy(F.col(group).alias("__g")).agg(F.ceil(F.count("*") / tile).cast("int").alias("__tiles")).where("__tiles > 1")
    side = F.broadcast(crowded) if crowded.limit(MOST_SENT + 1).count() <= MOST_SENT else crowded
    tiles = F.coalesce("__tiles", F.lit(1))
    spread = df.join(side, F.col(group) == F.col("__g"), "left").withColumn("__tile", F.pmod(F.xxhash64(*df.columns), tiles).cast("int"))
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    spread = spread.withColumn("__o", other)
    return spread.withColumns({"__x": F.least("__tile", "__o"), "__y": F.greatest("__tile", "__o")}).drop("__g", "__tiles", "__o")


def _largest_below(u: np.ndarray, margin: float) -> np.ndarray:
    """For each number the largest t with u - t > margin, as doubles are subtracted: found by halving between doubles."""
    if margin < 0:
        raise ValueError("margin must not be negative")
    ordered = lambda x: (i := x.view(np.int64)) ^ ((i >> 63) & np.int64(2**63 - 1))  # noqa: E731  as integers in the same order
    low, high = ordered(u - 2 * margin - np.abs(u) * 1e-15 - 1e-300), ordered(u.copy())
    while (low + 1 < high).any():
        middle = (low & high) + ((low ^ high) >> 1)  # their mean, rounded down, without overflow
        fits = u - (middle ^ ((middle >> 63) & np.int64(2**63 - 1))).view(np.float64) > margin
        low, high = np.where(fits, middle, low), np.where(fits, high, middle)
    return (low ^ ((low >> 63) & np.int64(2**63 - 1))).view(np.float64)


def swept_stats(df: DataFrame, group: str, utility: str, margin: float) -> DataFrame:
    """As delta_stats, by a sweep.

    Equal utilities of a group are one row with a count. A sweep over the group in order of utility holds how many there
    are below, their sum and the last one; each utility looks up what stands more than the margin below it. This sorts n
    rows where pairs would be n squared, and a crowded group lies in many tasks (ranks.running).
    """
    points = df.where(F.col(group).isNotNull() & F.col(utility).isNotNull()).groupBy(F.col(group).alias("g"), F.col(utility).cast("double").alias("u")).agg(F.count("*").cast("double").alias("c"))
    kind = points.schema["g"].dataType.simpleString()
    names = ["g", "key", "kind", "n", "s", "point", "asks", "u"]

    def events(batches):
        for b in batches:
            u, c = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            none = pa.nulls(len(u), pa.float64())
            zero = pa.array(np.zeros(len(u)))
            ones = [pa.array(np.full(len(u), k, np.int32)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(u), ones[0], pa.array(c), pa.array(c * u), pa.array(u), zero, none], names)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_largest_below(u, margin)), ones[1], zero, zero, none, pa.array(c), pa.array(u)], names)

    shape = f"g {kind}, key double, kind int, n double, s double, point double, asks double, u double"
    swept = running(points.mapInArrow(events, shape), "g", ["key", "kind"], ["n", "s"], "point")
    has = (F.col("kind") == 1) & (F.col("n_upto") > 0)
    each = swept.groupBy("g").agg(
        F.sum(F.when(has, F.col("asks") * F.col("n_upto"))).alias("pairs"),
        F.sum(F.when(has, F.col("asks") * (F.col("n_upto") * F.col("u") - F.col("s_upto")))).alias("total"),
        F.min(F.when(has, F.col("u") - F.col("point_upto"))).alias("least"),
        (F.max(F.when(has, F.col("u"))) - F.min("point")).alias("most"),
    )
    return each.where("pairs > 0").select(F.col("g").alias(group), F.col("pairs").cast("bigint").alias("pairs"), "total", "least", "most")


def delta_stats(df: DataFrame, group: str, utility: str, margin: float, crowded: int = 128) -> DataFrame:
    """Of each group that has pairs: pairs, total, least and most of the deltas of pair_within, without giving the pairs.

    Groups of up to ``crowded`` rows are joined with themselves, and what the join finds is summed up where it is found.
    Of larger groups, where that would be n squared, only rows can be in a pair that lie more than the margin above the
    group's lowest or below its highest. If the upper ones have few lower ones each (``crowded`` for a row, in the
    mean), the two are joined; else the group goes through a sweep in order of utility (swept_stats), n log n. All give
    the same; ordinals are taken to be different within a group, and rows without group or utility are in no pair.
    """
    known = df.select(F.col(group).alias("g"), F.col(utility).cast("double").alias("u")).where("g is not null and u is not null")
    sizes = known.groupBy("g").agg(F.count("*").alias("n"), F.min("u").alias("lowest"), F.max("u").alias("highest")).where(F.col("n") > crowded).drop("n")
    n = sizes.limit(MOST_SENT + 1).count()
    if not n:
        return _joined_stats(known, known, group, margin)
    side = F.broadcast(sizes) if n <= MOST_SENT else sizes
    small = known.join(side.select("g"), "g", "left_anti")
    upper, lower = F.col("u") - F.col("lowest") > margin, F.col("highest") - F.col("u") > margin
    able = stored(known.join(side, "g").select("g", "u", upper.alias("upper"), lower.alias("lower")).where("upper or lower"))
    a, b = F.count_if("upper"), F.count_if("lower")
    dense = able.groupBy("g").agg((a * b > F.lit(crowded) * (a + b)).alias("dense")).where("dense").select("g")
    m = dense.limit(MOST_SENT + 1).count()
    swept = F.broadcast(dense) if m <= MOST_SENT else dense
    sparse = able.join(swept, "g", "left_anti") if m else able
    out = _joined_stats(small, small, group, margin).unionByName(_joined_stats(sparse.where("upper"), sparse.where("lower"), group, margin))
    return out.unionByName(swept_stats(able.join(swept, "g", "left_semi"), "g", "u", margin).withColumnRenamed("g", group)) if m else out


def _joined_stats(upper: DataFrame, lower: DataFrame, group: str, margin: float) -> DataFrame:
    a, b = upper.select("g", "u").alias("a"), lower.select("g", "u").alias("b")
    delta = F.col("a.u") - F.col("b.u")
    # equal utilities make no pair: of two others the higher one is on the left
    joined = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.u") > F.col("b.u")) & (delta > margin))
    return joined.groupBy(F.col("a.g").alias(group)).agg(F.count("*").alias("pairs"), F.sum(delta).alias("total"), F.min(delta).alias("least"), F.max(delta).alias("most"))


def mean_delta(stats: DataFrame) -> float | None:
    """The mean of all deltas, from delta_stats."""
    r = stats.agg(F.sum("total").alias("t"), F.sum("pairs").alias("n")).first()
    return r.t / r.n if r.n else None


def with_mean(pairs: DataFrame, scope: str | None = None, mean: float | None = None) -> DataFrame:
    """Adds mean_delta: ``mean`` if it is known (mean_delta of delta_stats), else of the group named by ``scope`` (a window), or of all pairs (one row, joined to all)."""
    if mean is not None:
        return pairs.withColumn("mean_delta", F.lit(mean))
    if scope:
        return pairs.withColumn("mean_delta", F.avg("utility_delta").over(Window.partitionBy(scope)))
    return pairs.crossJoin(F.broadcast(pairs.agg(F.avg("utility_delta").alias("mean_delta"))))


def weighted(pairs: DataFrame, cfg: UtilityConfig = UtilityConfig(), scope: str | None = None, partial_scale: float | None = None, passed: Column | None = None, mean: float | None = None) -> DataFrame:
    """Adds raw_weight and weight; with partial_scale, pairs whose chosen side hasn't passed get that share of it."""
    w = weight(F.col("utility_delta"), F.col("mean_delta"), cfg)
    if partial_scale is not None:
        done = F.coalesce(F.col("chosen.passed") if passed is None else passed, F.lit(False))
        w = F.when(done, w).otherwise(F.greatest(F.lit(cfg.weight_min), w * partial_scale))
    return with_mean(pairs, scope, mean).withColumns({"raw_weight": raw_weight(F.col("utility_delta"), F.col("mean_delta")), "weight": w}).drop("mean_delta")


def reweighted(pairs: DataFrame, cfg: UtilityConfig = UtilityConfig(), partial_scale: float = 1.0, passed: Column | None = None) -> DataFrame:
    """Weights by the mean of all pairs; what the columns were is kept as local_raw_weight and local_weight."""
    kept = pairs.withColumnsRenamed({"raw_weight": "local_raw_weight", "weight": "local_weight"})
    return weighted(kept, cfg, None, partial_scale, passed)


def gated(pairs: DataFrame, cfg: FollowerConfig) -> DataFrame:
    """Pairs that pass the gates on the chosen side's pass rate; pass_rate_delta is each pair's own."""
    delta = F.col("chosen.pass_rate") - F.col("rejected.pass_rate")
    keep = (delta >= cfg.min_pass_rate_delta) & (F.col("chosen.pass_rate") >= cfg.min_chosen_pass_rate)
    if cfg.require_chosen_passed:
        keep = keep & F.col("chosen.passed")
    if cfg.require_repair_improvement:
        keep = keep & ((F.col("chosen.round") <= 1) | (F.col("chosen.pass_rate") > F.col("chosen.best_before")))
    return pairs.where(keep).withColumn("pass_rate_delta", delta)


def strong(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("chosen.passed") & ~F.col("rejected.passed"))


def first_of_each(df: DataFrame, keys: list[Column | str], order: list) -> DataFrame:
    """The first row in ``order`` for each value of the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
