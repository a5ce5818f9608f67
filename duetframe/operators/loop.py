"""The interaction loop: round by round plan, code, run, feedback, with the state of each trajectory carried in a table.

A round is a handful of column expressions around two calls of a generator and one of an executor, all of them
DataFrame to DataFrame:

* ``generate(requests)`` adds generated_text, prompt_tokens and completion_tokens to requests (run_id, round, sample,
  role, model, system, user, temperature, seed and columns to be kept);
* ``execute(candidates)`` adds feedback (functions.feedback.FEEDBACK, further fields allowed) to rows with code,
  code_type and entry_point.

Each round is written as a table, with the state that the next one starts from; a trajectory that has ended isn't read
again. A run that is started again goes on after the last round that is whole, and a round that had to be made again
makes all later ones be made again too, as they start from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IncentiveConfig, UtilityConfig
from ..functions import prompts
from ..functions.feedback import EVALUATION, FEEDBACK, FIELDS, LEADER, Compact, compact_feedback
from ..functions.text import effort_tokens, extract_code, role_boundary, strip
from ..functions.utility import approx_tokens, budget, calibrated_estimate, clamp01, leader_utility
from ..sources.readers import exists
from ..sources.tables import stored, workspace
from .turns import training_text

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LoopConfig:
    """best_so_far: rounds start from, and the run ends with, the best turn rather than the last one.

    repair_samples: candidates of a round after the first, of which the best one is the turn; early_rounds: rounds that
    are asked of the model ``coder_early``; budget: of the whole trajectory, else (None) by the first plan's effort.
    """

    max_rounds: int = 4
    stop_on_pass: bool = True
    best_so_far: bool = False
    repair_samples: int = 1
    early_rounds: int = 0
    temperature: float = 0.7
    repair_temperature: float | None = None
    seed: int = 0
    profile: prompts.Profile = prompts.SAMPLING
    feedback: Compact = LEADER
    incentive: bool = True
    budget: float | None = None
    incentives: IncentiveConfig = field(default_factory=IncentiveConfig)
    tokens: Callable[[Column], Column] = approx_tokens


#: What a round hands on, beside the run's own columns.
CARRIED = ("previous_code", "previous_feedback", "best_pass_rate", "best_key", "total_budget")
_KEY = "struct<pass_rate:double,passed:boolean,tokens:int>"


def evaluation(max_rounds: int = 4, profile: prompts.Profile = prompts.ALIGNED, **more) -> LoopConfig:
    """As role evaluation runs it: its wording of feedback and requests, a budget that is given."""
    return LoopConfig(max_rounds=max_rounds, profile=profile, feedback=EVALUATION, **more)


def _seeds(n: int, cfg: LoopConfig) -> Column:
    return (F.lit(cfg.seed) + 1000 * F.col("ord") + 100 * F.col("sample_index") + 10 * n).cast("bigint")


def _ask(rows: DataFrame, role: str, model: str, said: Column, temperature: Column, seed: Column) -> DataFrame:
    rows = rows.withColumn("__m", said)
    return rows.withColumns({"role": F.lit(role), "model": F.lit(model), "system": F.col("__m.system"), "user": F.col("__m.user"), "temperature": temperature.cast("double"), "seed": seed}).drop("__m")


_ASKED = ("role", "model", "system", "user", "temperature", "seed")
_SAID = ("generated_text", "prompt_tokens", "completion_tokens")


def key_of(pass_rate: Column, passed: Column, tokens: Column) -> Column:
    """What the better of two turns has more of: pass rate, passed, fewer tokens."""
    return F.struct(clamp01(F.coalesce(pass_rate, F.lit(0.0))).alias("pass_rate"), F.coalesce(passed, F.lit(False)).alias("passed"), (-tokens).cast("int").alias("tokens"))


def play_round(state: DataFrame, n: int, cfg: LoopConfig, generate: Step, execute: Step) -> DataFrame:
    """One round of the trajectories in ``state`` (the run's columns and CARRIED): their turns with the state after it.

    The run's columns are run_id, task_id, prompt, entry_point, ord, sample_index and test_tokens; others are kept for
    the executor and dropped afterwards.
    """
    c = F.col
    round_ = F.lit(n)
    state = state.withColumns({"round": round_, "sample": F.lit(0), "feedback_text": compact_feedback(c("previous_feedback"), cfg.feedback)})
    heat = F.coalesce(c("planner_temperature"), F.lit(cfg.temperature)) if "planner_temperature" in state.columns else F.lit(cfg.temperature)
    asked = prompts.planner_message(cfg.profile, round_, c("prompt"), c("previous_code"), c("feedback_text"))
    plans = generate(_ask(state, "planner", "planner", asked, heat, _seeds(n, cfg)))
    plans = plans.withColumnsRenamed({"generated_text": "plan", "prompt_tokens": "planner_prompt_tokens", "completion_tokens": "planner_completion_tokens", "user": "planner_request"}).drop(*set(_ASKED) - {"user"})
    plans = plans.withColumn("plan_tokens", cfg.tokens(c("plan")))
    if not cfg.incentive:
        pay, money = F.lit(prompts.NO_INCENTIVE), F.lit(0.0)
    else:
        effort = calibrated_estimate(effort_tokens(c("plan")).cast("int"), c("plan_tokens"), cfg.tokens(c("prompt")), c("test_tokens"))
        money = F.coalesce(c("total_budget"), F.lit(cfg.budget).cast("double"), budget(effort, cfg.incentives)["budget"])
        pay = prompts.incentive_rule(c("total_budget"), F.lit(cfg.incentives.max_step), c("best_pass_rate"))
    plans = plans.withColumn("total_budget", money)
    samples = cfg.repair_samples if n > 1 else 1
    if samples > 1:
        plans = plans.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    asked = prompts.coder_message(cfg.profile, round_, c("entry_point"), c("prompt"), c("plan"), c("previous_code"), c("feedback_text"), pay)
    heat = F.lit(cfg.repair_temperature if n > 1 and cfg.repair_temperature is not None else cfg.temperature)
    codes = generate(_ask(plans, "coder", "coder_early" if n <= cfg.early_rounds else "coder", asked, heat, _seeds(n, cfg) + 1 + c("sample")))
    codes = codes.withColumnsRenamed({"prompt_tokens": "coder_prompt_tokens", "completion_tokens": "coder_completion_tokens", "user": "coder_request"}).drop(*set(_ASKED) - {"user"})
    codes = codes.withColumn("__code", extract_code(c("generated_text"), c("entry_point"), c("prompt"))).withColumns({"code": c("__code.code"), "code_type": c("__code.code_type")}).drop("__code")
    # what the models said is written down: nothing that reads it again asks them again
    ran = execute(stored(codes.withColumn("code_tokens", cfg.tokens(c("code")))))
    ran = ran.withColumns({"pass_rate": clamp01(F.coalesce(c("feedback.pass_rate"), F.lit(0.0))), "passed": F.coalesce(c("feedback.passed"), F.lit(False))})
    turn = ran.withColumns({"key": key_of(c("pass_rate"), c("passed"), c("code_tokens")), "candidates": F.lit(samples)})
    if samples > 1:
        # the best of the candidates, of equal ones the first; what was spent is that of all
        first = F.struct("key", (-c("sample")).alias("order"))
        spent = [F.sum(x).cast("int").alias(x) for x in ("coder_prompt_tokens", "coder_completion_tokens")]
        best = turn.drop("coder_prompt_tokens", "coder_completion_tokens")
        turn = turn.groupBy("run_id").agg(F.max_by(F.struct(*best.columns), first).alias("t"), *spent).select("t.*", "coder_prompt_tokens", "coder_completion_tokens")
    gain = F.greatest(F.lit(0.0), c("pass_rate") - c("best_pass_rate"))
    better = c("best_key").isNull() | (c("key") > c("best_key"))
    takes = better if cfg.best_so_far else F.lit(True)
    # pay first: it looks at the best rate before this turn
    turn = turn.withColumns({"delta_best": gain, "incentive": F.least(F.lit(cfg.incentives.max_step), c("total_budget") * gain) if cfg.incentive else F.lit(0.0), "role_boundary_penalty": role_boundary(c("plan"))["penalty"]})
    turn = turn.withColumns(
        {
            "selected": better,
            "best_pass_rate": F.greatest("best_pass_rate", "pass_rate"),
            "previous_code": F.when(takes, c("code")).otherwise(c("previous_code")),
            "previous_feedback": F.when(takes, _narrow(c("feedback"))).otherwise(c("previous_feedback")),
            "best_key": F.when(better, c("key")).otherwise(c("best_key")),
            "ended": c("passed") if cfg.stop_on_pass else F.lit(False),
        }
    )
    turn = turn.withColumn("feedback", _narrow(c("feedback")))
    return turn.select(*TURN, *CARRIED, "ended", "selected")


def _narrow(feedback: Column) -> Column:
    """The fields of FEEDBACK, in its order (a result may have more)."""
    return F.struct(*(feedback[name].alias(name) for name in FIELDS))


#: Columns of a turn.
TURN = ("run_id", "round", "sample", "candidates", "plan", "planner_request", "planner_prompt_tokens", "planner_completion_tokens", "plan_tokens", "coder_request", "generated_text", "coder_prompt_tokens", "coder_completion_tokens", "code", "code_type", "code_tokens", "passed", "pass_rate", "delta_best", "incentive", "role_boundary_penalty", "feedback")


def play(runs: DataFrame, cfg: LoopConfig, generate: Step, execute: Step, out: str | None = None, resume: bool = True) -> DataFrame:
    """All turns of all runs (TURN, CARRIED after the turn, ended, selected).

    runs has a row for each trajectory: run_id, task_id, prompt, entry_point, and optionally ord, sample_index (0),
    test_tokens (0), planner_temperature and total_budget; what else the executor needs stays. A null prompt or entry
    point is empty, run ids are each there once, and no runs have no turns. With ``out`` the rounds
    are tables <out>/round_01 and so on, which a later call goes on from; else they are kept for the session.
    """
    spark = runs.sparkSession
    missing = {"ord": F.lit(0), "sample_index": F.lit(0), "test_tokens": F.lit(0), "total_budget": F.lit(None).cast("double")}
    runs = runs.withColumns({k: v for k, v in missing.items() if k not in runs.columns} | {k: F.coalesce(k, F.lit("")) for k in ("prompt", "entry_point")})
    begin = {"previous_code": F.lit(None).cast("string"), "previous_feedback": F.lit(None).cast(FEEDBACK), "best_pass_rate": F.lit(0.0), "best_key": F.lit(None).cast(_KEY)}
    state, rounds, again = runs.withColumns(begin), [], not resume
    for n in range(1, cfg.max_rounds + 1):
        path = out and f"{out}/round_{n:02d}"
        if path and not again and exists(spark, f"{path}/_SUCCESS"):
            turns = spark.read.parquet(path)
        else:
            again = True  # rounds after this one start from it
            with workspace(spark) as keep:
                turns = play_round(state, n, cfg, generate, execute)
                if path:
                    turns.write.mode("overwrite").parquet(path)
                    turns = spark.read.parquet(path)
                else:
                    turns = keep(turns)
        rounds.append(turns)
        going = turns.where(~F.col("ended"))
        if n == cfg.max_rounds or going.isEmpty():
            if path:
                _drop_later(spark, out, n)
            break
        state = runs.drop("total_budget").join(going.select("run_id", *CARRIED), "run_id")
    whole = rounds[0]
    for t in rounds[1:]:
        whole = whole.unionByName(t)
    return whole


def _drop_later(spark: SparkSession, out: str, n: int) -> None:
    """Rounds beyond the last one are those of an earlier, longer run."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in files.listStatus(hadoop):
        name = f.getPath().getName()
        if name.startswith("round_") and name[6:].isdigit() and int(name[6:]) > n:
            files.delete(f.getPath(), True)


def outcomes(turns: DataFrame, runs: DataFrame, cfg: LoopConfig, utility: UtilityConfig = UtilityConfig(), mode: str = "outputs_only") -> DataFrame:
    """One row for each run that has turns: rounds used, how it began and ended, tokens, pay, cost and utility.

    The final turn is the best (best_so_far; of equal ones the first) or the last one.
    """
    c = F.col
    final = F.struct("round", "code", "code_type", "generated_text", "passed", "pass_rate", "feedback")
    order = F.struct(key_of(c("pass_rate"), c("passed"), c("code_tokens")), -c("round")) if cfg.best_so_far else c("round")
    total = lambda *names: F.sum(sum((c(n) for n in names[1:]), c(names[0]))).cast("bigint")
    t = turns.groupBy("run_id").agg(
        F.max("round").alias("rounds"),
        F.bool_or((c("round") == 1) & c("passed")).alias("first_round_passed"),
        F.max_by(final, order).alias("final"),
        F.min_by("plan", "round").alias("plan"),
        total("planner_prompt_tokens", "coder_prompt_tokens").alias("context_tokens"),
        total("plan_tokens", "code_tokens").alias("communication_tokens"),
        F.sum("incentive").alias("incentive_total"),
        F.sum("role_boundary_penalty").alias("role_boundary_penalty_total"),
        F.max("pass_rate").alias("best_pass_rate"),
        F.max("total_budget").alias("incentive_budget"),
        F.collect_list(F.struct("round", "plan")).alias("plans"),
    )
    t = t.select("*", c("final.round").alias("selected_round"), c("final.passed").alias("passed"), c("final.pass_rate").alias("pass_rate"), c("final.code").alias("code"), c("final.feedback").alias("feedback"), training_text(c("plans")).alias("planner_training_text")).drop("final", "plans")
    base = c("communication_tokens") + (c("context_tokens") if mode == "context_and_outputs" else 0)
    t = t.withColumn("leader_utility", leader_utility(c("pass_rate"), c("rounds"), base, utility, c("incentive_total"), c("role_boundary_penalty_total")))
    known = runs.select("run_id", "task_id", prompts.leader_state(c("task_id"), c("entry_point"), c("prompt")).alias("state_text"))
    return known.join(t, "run_id")


def said_by(answer: Callable[[dict], str], tokens: Callable[[str], int] = lambda s: -(-len(s) // 4)) -> Step:
    """A generator from a function of one request (a dict of its columns): what a model server's client would be.

    The function runs on the workers, a batch of requests at a time. Its text is stripped.
    """
    def generate(requests: DataFrame) -> DataFrame:
        names = requests.columns
        asked = [names.index(n) for n in ("run_id", "round", "sample", *_ASKED)]

        def run(batches):
            for b in batches:
                rows = [dict(zip([names[i] for i in asked], r)) for r in zip(*(b.column(i).to_pylist() for i in asked))]
                texts = [answer(r).strip() for r in rows]
                counts = [tokens(r["system"]) + tokens(r["user"]) for r in rows], [tokens(t) for t in texts]
                made = [pa.array(texts, pa.string()), *(pa.array(x, pa.int32()) for x in counts)]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], schema=pa.schema([*b.schema, *(pa.field(n, a.type) for n, a in zip(_SAID, made))]))

        kinds = (T.StringType(), T.IntegerType(), T.IntegerType())
        return requests.mapInArrow(run, T.StructType([*requests.schema.fields, *map(T.StructField, _SAID, kinds)]))

    return generate
