"""Numbers, running totals and ranks over all rows of a table, without a task that sees them all.

Rows are dealt out by ranges of their order, as many as there are shuffle partitions, and sorted within; each range's
count (or total) goes to the driver, a row for each range, and what comes before a range is added to its rows. The
ranges are written down once, so both passes see the same ones, whatever is lost in between.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored

#: Bits that monotonically_increasing_id has for the place of a row in its partition.
_BITS = 33


def _ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows, dealt out by ranges of the order and sorted, with __range and __at (from 0 in each); written down.

    Equal rows of the order share a range: give enough columns to tell rows apart where many are equal.
    """
    spread = df.repartitionByRange(_ranges(df.sparkSession), *order).sortWithinPartitions(*order)
    return stored(_placed(spread))


def _placed(df: DataFrame) -> DataFrame:
    """Adds __range, the row's partition, and __at, its place in it."""
    whole = df.withColumn("__id", F.monotonically_increasing_id())
    return whole.withColumns({"__range": F.shiftright("__id", _BITS).cast("int"), "__at": F.col("__id").bitwiseAND(F.lit((1 << _BITS) - 1))}).drop("__id")


def _before(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(range, how many rows stand in the ranges before it)."""
    out, total = [], 0
    for which, n in sorted(sizes):
        out.append((which, total))
        total += n
    return out


def numbered(df: DataFrame, order: list[str | Column], name: str = "place", first: int = 0) -> DataFrame:
    """Adds the row's number in the order, from ``first``. Rows that are equal in the order are numbered in any order."""
    ranged = in_ranges(df, *order)
    before = _before([tuple(r) for r in ranged.groupBy("__range").count().collect()])
    starts = df.sparkSession.createDataFrame(before, "__range int, __before bigint")
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__before") + F.col("__at") + first).cast("bigint")).drop("__range", "__at", "__before")


def scattered(df: DataFrame, seed: int, order: str = "ord", name: str = "shuffled_at") -> DataFrame:
    """Adds the place that a permutation drawn by the seed gives the row: the rank of a digest of seed and ordinal.

    It is the same for the same ordinals however many rows are beside them in a partition, and needs no list of all
    places; ``states.shuffled`` gives the places of Python's generator, for tables that fit into such a list.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string")), 256)
    return numbered(df.withColumn("__digest", digest), ["__digest", order], name).drop("__digest")


def values_at(df: DataFrame, value: str, wanted: Callable[[int], dict[str, int]]) -> dict[str, float | None]:
    """Values by rank: ``wanted`` gives a rank (from 0) for each name, of the number of rows that have a value.

    Equal values are counted first; ranges of values whose counts hold no wanted rank are not looked at again. A rank
    that isn't there has None.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = in_ranges(counts, "v")
    sizes = [(r["__range"], r.n) for r in ranged.groupBy("__range").agg(F.sum("c").alias("n")).collect()]
    total = sum(n for _, n in sizes)
    ranks = wanted(total)
    starts = _before(sizes)
    asked: dict[int, list[tuple[str, int]]] = {}
    for name, rank in ranks.items():
        if 0 <= rank < total:
            which, before = max((s for s in starts if s[1] <= rank), key=lambda s: (s[1], s[0]))
            asked.setdefault(which, []).append((name, rank - before))
    out: dict[str, float | None] = dict.fromkeys(ranks)
    if asked:
        held = ranged.where(F.col("__range").isin(list(asked)))
        picked = held.groupBy("__range").applyInArrow(_pick(asked), "name string, v double")
        out |= {r.name: r.v for r in picked.collect()}
    return out


def _pick(asked: dict[int, list[tuple[str, int]]]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        upto = np.cumsum(table.column("c").to_numpy())
        values = table.column("v").to_numpy(zero_copy_only=False).astype(float)
        mine = asked[table.column("__range")[0].as_py()]
        return pa.table({"name": pa.array([n for n, _ in mine], pa.string()), "v": pa.array([values[np.searchsorted(upto, r, "right")] for _, r in mine], pa.float64())})

    return run


def nearest_ranks(shares: dict[str, float]) -> Callable[[int], dict[str, int]]:
    """Ranks round((n - 1) * share), halves to even."""
    return lambda n: {name: round((n - 1) * q) for name, q in shares.items()}


def running(df: DataFrame, group: str, order: list[str], sums: list[str], last: str | None = None) -> DataFrame:
    """Adds <name>_upto for each of ``sums``: the total of the group's rows up to and with this one, in order.

    ``last``: a column of which <last>_upto is the latest value that isn't null. A group of any size may lie in many
    ranges: what it has in those before is added from the ranges' totals.
    """
    spark = df.sparkSession
    spread = df.repartitionByRange(_ranges(spark), group, *order).sortWithinPartitions(group, *order)
    kinds = T.StructType([*df.schema.fields, *(T.StructField(f"{c}_upto", T.DoubleType()) for c in [*sums, *([last] if last else [])])])
    summed = spread.mapInArrow(_running(df.columns.index(group), [df.columns.index(c) for c in sums], df.columns.index(last) if last else None, kinds.names), kinds)
    ranged = stored(_placed(summed))
    # of each range the group at its end, which alone may go on in the next one, with what it has there
    tops = [f"{c}_upto" for c in sums] + ([f"{last}_upto"] if last else [])
    edge = ranged.groupBy("__range").agg(F.min(group).alias("first"), F.max(group).alias("last"))
    edges = {r["__range"]: (r.first, r.last) for r in edge.collect()}
    if not edges:
        return ranged.drop("__range", "__at")
    kind = df.schema[group].dataType.simpleString()
    wanted = spark.createDataFrame([(k, e) for k, (_, e) in edges.items()], f"__range int, `{group}` {kind}")
    # the totals of a range's last group: those of its last row
    totals = ranged.join(F.broadcast(wanted), ["__range", group]).groupBy("__range").agg(F.max_by(F.struct(*tops), "__at").alias("t"))
    totals = {r["__range"]: tuple(r.t) for r in totals.collect()}
    carried, held = [], None  # (group, totals) that goes on
    for which in sorted(edges):
        head, end = edges[which]
        base = held[1] if held and held[0] == head else None
        if base:
            carried.append((which, head, *base))
        mine = totals[which]
        if base and head == end:
            mine = tuple(a + b for a, b in zip(base[: len(sums)], mine)) + tuple(b if b is not None else a for a, b in zip(base[len(sums) :], mine[len(sums) :]))
        held = (end, mine)
    if not carried:
        return ranged.drop("__range", "__at")
    more = spark.createDataFrame(carried, f"__range int, `{group}` {kind}, " + ", ".join(f"`__{c}` double" for c in tops))
    joined = ranged.join(F.broadcast(more), ["__range", group], "left")
    for c in sums:
        joined = joined.withColumn(f"{c}_upto", F.col(f"{c}_upto") + F.coalesce(F.col(f"__{c}_upto"), F.lit(0.0)))
    if last:
        joined = joined.withColumn(f"{last}_upto", F.coalesce(f"{last}_upto", f"__{last}_upto"))
    return joined.drop("__range", "__at", *(f"__{c}" for c in tops))


def _running(group: int, sums: list[int], last: int | None, names: list[str]):
    def run(batches):
        held, base, latest = object(), [0.0] * len(sums), np.nan
        for b in batches:
            keys = b.column(group)
            n = len(keys)
            if not n:
                continue
            code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            goes_on = keys[0].as_py() == held
            size = np.diff(np.r_[starts, n])
            out = []
            for k, at in enumerate(sums):
                x = b.column(at).to_numpy(zero_copy_only=False).astype(float)
                total = np.cumsum(x)
                total -= np.repeat(total[starts] - x[starts], size)
                if goes_on:
                    total[: size[0]] += base[k]
                base[k] = float(total[-1])
                out.append(pa.array(total))
            if last is not None:
                x = b.column(last).to_numpy(zero_copy_only=False).astype(float)
                at = np.where(np.isnan(x), -1, np.arange(n))
                at = np.maximum.accumulate(at)
                inside = at >= np.repeat(starts, size)
                value = np.where(inside, x[np.maximum(at, 0)], np.nan)
                if goes_on:
                    head = value[: size[0]]
                    value[: size[0]] = np.where(np.isnan(head), latest, head)
                latest = value[-1]
                out.append(pa.array(value, mask=np.isnan(value)))
            held = keys[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=names)

    return run
