"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read, ship_code, stored, workspace

__all__ = ["LOWER", "WORD", "beside", "connected_components", "few", "lower_ascii", "read", "shuffle_partitions", "stored", "workspace"]

#: Lower-casing of A-Z alone, for bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def beside(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that none of ``columns`` has (Spark's names ignore case)."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return [mark + n for n in names]


#: Rows of two or three numbers that are sent to every worker rather than shuffled, at most.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side of a join for broadcast if a count shows that it has no more than ``rows`` (narrow) rows."""
    return F.broadcast(df) if df.count() <= rows else df


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id it is connected with) of every id in the edges (a, b).

    Alternates large-star and small-star until the edges are stars around the smallest ids. Both are an aggregation
    with partial minima and a join, so an id with very many edges isn't gathered anywhere; each round is written to the
    shared folder.
    """
    edges = stored(edges.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def lean(f):
    """A function over record batches that gives its memory back when it has gone through them.

    Workers are used again for other tasks and stages; without this each keeps the most it ever took. Made on the
    driver, it also sees to it that the workers have this package.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        ship_code(session)

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)
