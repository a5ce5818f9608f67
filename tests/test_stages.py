"""Stages that run again exactly when what they hang on has changed; registries with many writers."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from duetframe import config
from duetframe.plans import pipelines, turns as turn_queries
from duetframe.operators import turns
from duetframe.sources import readers

D = "/root/testdata/sf0.001"


def skipped(m):
    return {name: s["skipped"] for name, s in m["stages"].items()}


def test_a_changed_setting_runs_what_hangs_on_it(spark, tmp_path):
    out, ran = str(tmp_path / "run"), []

    def stages(a=1, d=1):
        def make(name, needs, of):
            def run(tables):
                assert set(tables) == set(needs)
                ran.append(name)
                base = spark.range(3).withColumn("x", F.lit(of or 0))
                for t in tables.values():
                    base = base.withColumn("x", F.col("x") + F.lit(t.agg(F.max("x")).first()[0]))
                return base

            return pipelines.Stage(name, run, needs=needs, of=of)

        return [make("a", (), a), make("b", ("a",), None), make("c", (), 5), make("d", ("b", "c"), d), make("e", ("c",), None)]

    pipelines.run_stages(spark, stages(), out)
    assert ran == list("abcde") and not (ran.clear() or ran)
    assert all(skipped(pipelines.run_stages(spark, stages(), out)).values()) and not ran
    pipelines.run_stages(spark, stages(d=2), out)
    assert ran == ["d"] and not (ran.clear() or ran)
    pipelines.run_stages(spark, stages(a=7, d=2), out)
    assert ran == ["a", "b", "d"] and not (ran.clear() or ran)
    assert spark.read.parquet(f"{out}/d").agg(F.max("x")).first()[0] == 2 + 7 + 5
    (tmp_path / "run/c/_SUCCESS").unlink()  # as a run that was cut short leaves it
    pipelines.run_stages(spark, stages(a=7, d=2), out)
    assert ran == ["c"] and not (ran.clear() or ran)
    pipelines.run_stages(spark, stages(a=7, d=2), out, resume=False)
    assert ran == list("abcde")
    with pytest.raises(ValueError):
        pipelines.run_stages(spark, [pipelines.Stage("x", lambda t: spark.range(1), needs=("none",))], out)


def test_staged_run_reads_its_tables(spark, tmp_path):
    t = turns.rollup(turn_queries.turns(spark, D)).withColumns({"ord": F.split("trajectory_id", "_")[0].cast("long") * 1000 + F.split("trajectory_id", "_")[1].cast("long"), "task_id": F.split("trajectory_id", "_")[0], "state_text": F.col("trajectory_id"), "context_tokens": F.lit(1), "communication_tokens": F.lit(None).cast("int")})
    t.limit(60).write.parquet(f"{tmp_path}/in")
    rows, out, cfg = spark.read.parquet(f"{tmp_path}/in"), str(tmp_path / "run"), config.UtilityConfig()
    first = pipelines.staged(spark, rows, out, cfg)
    whole = {k: sorted(map(str, spark.read.parquet(f"{out}/{k}").drop("order").collect())) for k in first["stages"]}
    made = pipelines.from_trajectories(rows, cfg)
    assert whole == {k: sorted(map(str, made[k].drop("order").collect())) for k in whole}
    assert all(skipped(pipelines.staged(spark, rows, out, cfg)).values())
    now = skipped(pipelines.staged(spark, rows, out, config.UtilityConfig(follower_margin=0.5, leader_margin=cfg.leader_margin)))
    assert now == {"leader": True, "clean": True, "candidates": True, "follower": False, "leader_rows": True}
    pipelines.staged(spark, rows, out, cfg)
    t.limit(50).write.mode("overwrite").parquet(f"{tmp_path}/in")
    assert not any(skipped(pipelines.staged(spark, spark.read.parquet(f"{tmp_path}/in"), out, cfg)).values())


def test_registry_with_many_writers(spark, tmp_path):
    path = f"file://{tmp_path}/info.json"
    done = []

    def write(k):
        for i in range(4):
            readers.upsert_dataset(path, f"{k}_{i}", {"n": i}, spark=spark)
        done.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(done) == 5 and set(readers.read_json(path, spark)) == {f"{k}_{i}" for k in range(5) for i in range(4)}
    assert len(readers.read_json(path + ".bak", spark)) == 19 and readers.read_json(path + "x", spark) is None
    assert not [p for p in tmp_path.iterdir() if p.name not in ("info.json", "info.json.bak") and not p.name.endswith(".crc")]
    assert json.loads((tmp_path / "info.json").read_text())["0_0"] == {"n": 0}
    with readers.locked(spark, path):
        with pytest.raises(readers.Busy):
            with readers.locked(spark, path, seconds=0.1):
                pass
        with readers.locked(spark, path, seconds=5, stale=-1):  # a lock that its writer left behind
            pass
    with pytest.raises(FileNotFoundError):
        readers.upsert_dataset(path + "x", "a", {}, create=False, spark=spark)
