"""Structured Streaming: rows taken in once by id, and the running best of trajectories as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def append_once(stream: DataFrame, out: str, checkpoint: str, key: str, **trigger) -> StreamingQuery:
    """Appends each key's first row to Parquet files; a restart goes on where it stopped."""
    once = stream.dropDuplicates([key])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def counts_by_window(stream: DataFrame, time: str, key: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and mean pass rate by key and window; rows later than ``late`` are left out."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.avg("pass_rate").alias("pass_rate")).select("w.start", "w.end", key, "n", "pass_rate")


_OUT = "trajectory_id string, round int, best_before double, step_incentive double"


def running_best(stream: DataFrame, budget: float = 0.05, max_step: float = 0.04) -> DataFrame:
    """Each arriving turn (trajectory_id, round, pass_rate) with the best before it and its step incentive.

    The best pass rate of a trajectory is kept as state. Turns of one batch are taken in order of their round; a turn
    that comes in a later batch than its successors sees what has come before it, not what stands before it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("round", kind="stable")
        out = []
        for r in rows.itertuples():
            rate = min(1.0, max(0.0, r.pass_rate if r.pass_rate == r.pass_rate and r.pass_rate is not None else 0.0))
            out.append((key[0], int(r.round), best, min(max_step, budget * max(0.0, rate - best))))
            best = max(best, rate)
        state.update((best,))
        yield pd.DataFrame(out, columns=["trajectory_id", "round", "best_before", "step_incentive"])

    return stream.groupBy("trajectory_id").applyInPandasWithState(step, _OUT, "best double", "append", GroupStateTimeout.NoTimeout)
