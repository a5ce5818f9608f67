"""Whole runs: the tiny smoke run, the run from trajectories and the staged run with gates and manifests."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import UtilityConfig
from ..functions import utility as ut
from ..functions.text import normalize, overreach_basic, strip
from ..operators import execute, pairs, states, stats, training_rows, turns
from ..sources import readers
from ..sources.tables import stored

#: JSON-lines schemas of the two inputs; test arguments are any JSON, so they stay text.
TASK = T.StructType([T.StructField(c, T.StringType()) for c in ("task_id", "entry_point", "prompt", "tests")])
TRAJECTORY = T.StructType([T.StructField(c, k) for c, k in (("trajectory_id", T.StringType()), ("task_id", T.StringType()), ("rounds", T.IntegerType()), ("plan", T.StringType()), ("code", T.StringType()), ("planner_tokens", T.IntegerType()), ("coder_tokens", T.IntegerType()))])


def leader_preferences(scored: DataFrame, cfg: UtilityConfig) -> DataFrame:
    """scored: task_id, ord, trajectory_id, leader_utility, plan. Pairs with plans, ids, utilities, weight and ord."""
    narrow = scored.select("task_id", "ord", "trajectory_id", "leader_utility")
    p = pairs.weighted(pairs.pair_within(narrow, "task_id", "leader_utility", cfg.leader_margin), cfg)
    p = p.select("task_id", F.col("chosen.trajectory_id").alias("chosen_id"), F.col("rejected.trajectory_id").alias("rejected_id"), F.col("chosen.leader_utility").alias("chosen_utility"), F.col("rejected.leader_utility").alias("rejected_utility"), "utility_delta", "weight", "ord_a", "ord_b")
    plans = scored.select("trajectory_id", "plan")
    p = p.join(plans.select(F.col("trajectory_id").alias("chosen_id"), F.col("plan").alias("chosen")), "chosen_id").join(plans.select(F.col("trajectory_id").alias("rejected_id"), F.col("plan").alias("rejected")), "rejected_id")
    first = scored.groupBy("task_id").agg(F.min("ord").alias("task_ord"))
    return p.join(first, "task_id").withColumn("order", F.struct("task_ord", "ord_a", "ord_b"))


def clean(preferences: DataFrame) -> DataFrame:
    """Without chosen plans that overstep; of equal ones (normalised) the first stays."""
    kept = preferences.where(~overreach_basic(F.col("chosen"))).withColumn("k", normalize(F.col("chosen")))
    return pairs.first_of_each(kept, ["k"], ["order"]).drop("k")


def follower_preferences(candidates: DataFrame, cfg: UtilityConfig) -> DataFrame:
    """candidates: state_id, task_id, ord (each once in a state), code, pass_rate, coder_tokens, incentive.

    Pairs are made of narrow rows; the code is joined to them by state and ordinal.
    """
    u = ut.follower_utility(F.col("pass_rate"), F.col("coder_tokens"), F.col("incentive"), cfg)
    rows = candidates.select("state_id", "task_id", "ord", u.alias("follower_utility"))
    p = pairs.weighted(pairs.pair_within(rows, "state_id", "follower_utility", cfg.follower_margin), cfg)
    p = p.select("state_id", F.col("chosen.task_id").alias("task_id"), F.col("chosen.ord").alias("__c"), F.col("rejected.ord").alias("__r"), F.col("chosen.follower_utility").alias("chosen_utility"), F.col("rejected.follower_utility").alias("rejected_utility"), "utility_delta", "weight", "ord_a", "ord_b")
    code = lambda at, name: candidates.select("state_id", F.col("ord").alias(at), F.col("code").alias(name))
    p = p.join(code("__c", "chosen"), ["state_id", "__c"]).join(code("__r", "rejected"), ["state_id", "__r"])
    once = pairs.first_of_each(p, ["state_id", strip(F.col("chosen")), strip(F.col("rejected"))], ["ord_a", "ord_b"])
    return once.select("state_id", "task_id", "chosen", "rejected", "chosen_utility", "rejected_utility", "utility_delta", "weight")


def tiny(spark: SparkSession, tasks: DataFrame, trajectories: DataFrame, cfg: UtilityConfig, seconds: float = 2.0) -> dict[str, DataFrame]:
    """Tasks (task_id, entry_point, tests as JSON) and trajectories (TRAJECTORY and ord): run, score, pair, clean.

    A trajectory of an unknown task makes the run fail.
    """
    known = trajectories.join(tasks.select("task_id", "entry_point", "tests"), "task_id", "left")
    known = known.where(F.assert_true(F.col("entry_point").isNotNull(), F.lit("a trajectory of an unknown task")).isNull())
    ran = execute.execute(known, seconds=seconds)
    tokens = F.coalesce("planner_tokens", F.lit(0)) + F.coalesce("coder_tokens", F.lit(0))
    rate = F.col("feedback.pass_rate")
    scored = ran.withColumns({"pass_rate": rate, "total_tokens": tokens, "leader_utility": ut.leader_utility(rate, F.coalesce("rounds", F.lit(1)), tokens, cfg)})
    scored = stored(scored)  # run once, read by several outputs
    leader = leader_preferences(scored, cfg)
    candidates = scored.select(F.concat("task_id", F.lit("_initial")).alias("state_id"), "task_id", "ord", "trajectory_id", "code", "pass_rate", F.coalesce("coder_tokens", F.lit(0)).alias("coder_tokens"), F.lit(0.0).alias("incentive"), F.lit("").alias("prompt"))
    return {"scored": scored, "leader": leader, "clean": clean(leader), "follower": follower_preferences(candidates, cfg)}


def sampled(rows: DataFrame, cfg: UtilityConfig, max_tasks: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Trajectories, limited and with what is missing filled in from their turns."""
    t = turns.normalized(states.limited(rows, max_tasks, max_rows))
    given = F.col("leader_utility") if "leader_utility" in rows.columns else F.lit(None).cast("double")
    own = ut.leader_utility(F.col("pass_rate"), F.col("rounds"), F.col("total_tokens"), cfg)
    return t.withColumn("leader_utility", F.coalesce(given, own))


def turn_candidates(trajectories: DataFrame) -> DataFrame:
    """The code of every turn as a candidate of its state."""
    flat = trajectories.select("task_id", "trajectory_id", "state_text", F.col("ord").alias("traj_ord"), F.explode("turns").alias("t"))
    prompt = F.concat(F.lit("Task state:\n"), F.coalesce("state_text", F.lit("")), F.lit("\n\nPlanner guidance:\n"), F.col("t.plan"), F.lit(training_rows.FOLLOWER_ASK))
    return flat.select(F.concat("task_id", F.lit("_round"), F.col("t.round").cast("string")).alias("state_id"), "task_id", (F.col("traj_ord") * 1000 + F.col("t.round")).alias("ord"), "trajectory_id", F.col("t.code").alias("code"), F.col("t.pass_rate").alias("pass_rate"), F.col("t.code_tokens").alias("coder_tokens"), F.lit(0.0).alias("incentive"), prompt.alias("prompt"))


def from_trajectories(rows: DataFrame, cfg: UtilityConfig, max_tasks: int | None = None, max_rows: int | None = None) -> dict[str, DataFrame]:
    """Sampled trajectories with turns: limit, fill in, pair, clean, candidates of every turn, training rows."""
    t = sampled(rows, cfg, max_tasks, max_rows)
    leader, candidates = leader_preferences(t, cfg), turn_candidates(t)
    cleaned = clean(leader)
    return {"trajectories": t, "leader": leader, "clean": cleaned, "candidates": candidates, "follower": follower_preferences(candidates, cfg), "leader_rows": training_rows.leader_rows(cleaned, t.select("trajectory_id", "state_text"))}


@dataclass
class Stage:
    """A step that writes one table.

    It gets the tables of the stages before it. needs: those that it reads (None: all before it); of: what else its
    rows hang on, as settings or fingerprints of sources. Its table is taken as it is where it was made whole of the
    same ``of`` and of tables made of the same.
    """

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    rules: list[tuple[str, float | None, float | None]] = field(default_factory=list)
    summary: Callable[[DataFrame], DataFrame] | None = None
    needs: tuple[str, ...] | None = None
    of: Any = None


def source_fingerprint(df: DataFrame) -> str:
    """A digest of the names, lengths and times of the files that a table is read from; without files, of its plan."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        s = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return _digest(sorted(seen) or df.semanticHash())


def _digest(value: Any) -> str:
    """Of settings: dataclasses count with their fields, anything else as JSON or by its repr."""
    plain = lambda v: asdict(v) if is_dataclass(v) else repr(v)
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=plain).encode()).hexdigest()


def run_stages(spark: SparkSession, stages: list[Stage], out: str, resume: bool = True, gates: bool = True) -> dict[str, Any]:
    """Runs the stages in order, each with the tables of those before; returns the manifest, also written when one fails.

    A stage's table is <out>/<name>, its fingerprint <out>/<name>/_fingerprint. With ``resume``, a stage whose table is
    whole and has the fingerprint that it would get now is skipped: after a change of settings or sources exactly the
    stages that hang on it run again. An empty table, or a gate that fails, ends the run.
    """
    manifest: dict[str, Any] = {"stages": {}, "gates": [], "ok": False}
    tables: dict[str, DataFrame] = {}
    prints: dict[str, str] = {}
    try:
        for s in stages:
            needs = tuple(tables) if s.needs is None else s.needs
            if unknown := set(needs) - set(tables):
                raise ValueError(f"{s.name} needs {sorted(unknown)}, which no stage before it makes")
            path, began = f"{out}/{s.name}", time.time()
            prints[s.name] = now = _digest([s.name, s.of, [prints[n] for n in needs]])
            whole = readers.exists(spark, f"{path}/_SUCCESS")
            done = resume and whole and readers.read_text(spark, f"{path}/_fingerprint") == now
            if not done:
                s.run({n: tables[n] for n in needs}).write.mode("overwrite").parquet(path)
                readers.write_text(spark, f"{path}/_fingerprint", now)
            tables[s.name] = df = spark.read.parquet(path)
            manifest["stages"][s.name] = {"skipped": done, "rows": df.count(), "seconds": round(time.time() - began, 3), "fingerprint": now}
            if df.isEmpty():
                raise RuntimeError(f"{s.name} has no rows")
            if s.rules and gates:
                summary = s.summary(df) if s.summary else df.agg(F.count("*").alias("rows"))
                got = stats.health_gates(summary, [(s.name, *r) for r in s.rules]).collect()
                manifest["gates"] += [r.asDict() for r in got]
                if bad := [f"{r.metric} {r.failed}" for r in got if r.failed]:
                    raise RuntimeError(f"health gate failed: {s.name}: {', '.join(bad)}")
        manifest["ok"] = True
    finally:
        text = spark.createDataFrame([(json.dumps(manifest),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return manifest


def verify(preferences: DataFrame, cleaned: DataFrame) -> dict[str, int]:
    """How many rows break what must hold: direction of utilities, no overstepping plan among the clean, counts."""
    wrong = preferences.where(F.col("chosen_utility") <= F.col("rejected_utility")).count()
    return {"wrong_direction": wrong, "overreach": cleaned.where(overreach_basic(F.col("chosen"))).count(), "empty": int(preferences.isEmpty())}


def check(preferences: DataFrame, cleaned: DataFrame, follower: DataFrame, candidates: DataFrame) -> DataFrame:
    """What must hold of a run's tables, one row each: rule, broken (how many rows break it; 0 where it holds).

    Preferences point to the higher utility; no clean plan oversteps; both sides of a follower pair have code, not the
    same, that was written for one state; none of the tables is empty.
    """
    code = candidates.groupBy("state_id", "code").agg(F.count("*").alias("n"))
    sides = [code.select("state_id", F.col("code").alias(side), F.col("n").alias(f"n_{side}")) for side in ("chosen", "rejected")]
    found = follower.join(sides[0], ["state_id", "chosen"], "left").join(sides[1], ["state_id", "rejected"], "left")
    missing = F.col("n_chosen").isNull() | F.col("n_rejected").isNull()
    counted = [
        (preferences, "leader_direction", F.col("chosen_utility") <= F.col("rejected_utility")),
        (cleaned, "overreach", overreach_basic(F.col("chosen"))),
        (follower, "follower_direction", F.col("chosen_utility") <= F.col("rejected_utility")),
        (follower, "identical_code", F.col("chosen") == F.col("rejected")),
        (found, "other_state", missing),
    ]
    out = None
    for df, rule, broken in counted:
        one = df.agg(F.count_if(broken).alias("broken")).select(F.lit(rule).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    for name, df in (("preferences", preferences), ("cleaned", cleaned), ("follower", follower), ("candidates", candidates)):
        out = out.unionByName(df.agg((F.count("*") == 0).cast("bigint").alias("broken")).select(F.lit(f"no_{name}").alias("rule"), "broken"))
    return out


def staged(spark: SparkSession, trajectories: DataFrame, out: str, cfg: UtilityConfig, rules: dict[str, list[tuple[str, float | None, float | None]]] | None = None, resume: bool = True) -> dict[str, Any]:
    """The run from trajectories as stages with tables of their own, gates (``rules`` by stage) and a manifest.

    A stage reads the tables of those before it: pairs and candidates are made once, and a run that is started again
    reads what is on disk. Rules and gates are no part of a stage's fingerprint.
    """
    source, t = source_fingerprint(trajectories), sampled(trajectories, cfg)
    utility, margins = {"rounds": cfg.lambda_round, "tokens": cfg.lambda_token}, {"weights": (cfg.weight_min, cfg.weight_max, cfg.weight_power)}
    texts = t.select("trajectory_id", "state_text")
    own = {
        "leader": ((), {"source": source, **utility, **margins, "margin": cfg.leader_margin}, lambda _: leader_preferences(t, cfg)),
        "clean": (("leader",), None, lambda made: clean(made["leader"]).drop("order")),
        "candidates": ((), {"source": source}, lambda _: turn_candidates(t)),
        "follower": (("candidates",), {**utility, **margins, "margin": cfg.follower_margin}, lambda made: follower_preferences(made["candidates"], cfg)),
        "leader_rows": (("clean",), {"source": source}, lambda made: training_rows.leader_rows(made["clean"], texts)),
    }
    stages = [Stage(name, run, (rules or {}).get(name, []), needs=needs, of=of) for name, (needs, of, run) in own.items()]
    return run_stages(spark, stages, out, resume, gates=bool(rules))


def ablation(runs: DataFrame) -> DataFrame:
    """runs: variant, task_id, passed, assert_rate, tokens, rounds. A row for each variant, by its utility."""
    cfg = UtilityConfig()
    n, p = F.count("*"), F.count_if("passed")
    utility = F.avg("assert_rate") - cfg.lambda_round * F.avg("rounds") - cfg.lambda_token * F.avg("tokens")
    table = runs.groupBy("variant").agg(n.alias("num_tasks"), p.alias("final_passed"), (p / n).alias("final_pass_rate"), F.avg("assert_rate").alias("avg_assert_pass_rate"), F.avg("tokens").alias("avg_total_tokens"), utility.alias("leader_utility"))
    return table.orderBy(F.desc("leader_utility"), "variant")
