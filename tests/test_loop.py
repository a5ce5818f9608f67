"""The loop against a plain one over the same scripted model, and what a run that was cut short goes on from."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from duetframe.functions import feedback as fb
from duetframe.functions import prompts
from duetframe.operators import execute as ex
from duetframe.operators.loop import LoopConfig, evaluation, outcomes, play, said_by
from duetframe.config import IncentiveConfig
from tests.test_feedback import plain

TESTS = [{"args": [i], "expected": i + 1} for i in range(4)]
TASKS = [(f"r{i}", f"HumanEval/{i}", f"def f{i}(x):\n    # add one, case {i}\n", f"f{i}", i, i % 2, json.dumps(TESTS)) for i in range(12)]
SHAPE = "run_id string, task_id string, prompt string, entry_point string, ord int, sample_index int, tests string"


def answer(request):
    """A model whose words hang on every byte of its request: plans with an effort, code that is right for some arguments."""
    h = hashlib.sha256("|".join(str(request[k]) for k in ("role", "model", "system", "user", "temperature", "seed")).encode()).digest()
    if request["role"] == "planner":
        return f"Estimated effort tokens: {60 + h[0] * 3}\n" + ("assert it\n" if h[1] % 3 == 0 else "add one\n") + h.hex()[: 4 + h[2] % 8] + "\n"
    name = request["system"].rsplit("function ", 1)[1].split(" ")[0]
    body = ("return x + 1", f"return x + (x < {h[1] % 5})", "raise ValueError('é')", "retur x", f"return x + 1 if x % 2 == {h[1] % 2} else {h[2] % 3}")[h[0] % 5]
    return f"Sure:\n```python\ndef {name}(x):\n    {body}{'  # ' + h.hex()[:3] if h[3] % 2 else ''}\n```"


def tokens(text):
    return math.ceil(len(text or "") / 4)


def plain_loop(run, cfg, runner):
    """One trajectory, turn by turn."""
    run_id, _, prompt, name, ord_, sample_index, tests = run
    turns, code, feedback, best, best_key, budget = [], None, None, 0.0, None, cfg.budget
    profile = cfg.profile
    for n in range(1, cfg.max_rounds + 1):
        said = plain(feedback or dict.fromkeys(KEYS), cfg.feedback)
        seed = cfg.seed + 1000 * ord_ + 100 * sample_index + 10 * n
        again = f"Task:\n{prompt}\n\nPrevious code:\n{code or ''}\n\nExecution feedback:\n{said}"
        asked = profile.plan_ask + prompt if n == 1 else profile.plan_again + again
        plan = answer({"role": "planner", "model": "planner", "system": profile.planner_role, "user": asked, "temperature": cfg.temperature, "seed": seed}).strip()
        if budget is None:
            stated = int(plan.split("\n")[0].split(": ")[1])
            estimate = int(max(80, min(800, max(stated, int(tokens(plan) + 0.25 * tokens(prompt))))))
            c = cfg.incentives
            budget = min(c.most, c.base * max(1 / c.max_multiplier, min(c.max_multiplier, math.exp(c.gamma * max(-3, min(3, (estimate - c.reference) / c.scale))))))
        pay = prompts.NO_INCENTIVE
        if cfg.incentive:
            pay = f"Incentive rule: execution improvements are rewarded by incremental pass-rate gain. Remaining trajectory incentive budget is about {budget:.4f}; per-step payment is capped at {cfg.incentives.max_step:.4f}; current best pass rate is {best:.3f}."
        system = profile.coder_role + f" Define the function {name} exactly."
        if n == 1:
            user = f"Task:\n{prompt}\n\nPlanner guidance:\n{plan}\n\n" + (pay + "\n\n" if profile.incentive_first else "") + "Now write the complete Python function."
        else:
            user = f"{again}\n\nPlanner repair guidance:\n{plan}\n\n{pay}\n\n{profile.code_again}"
        heat = cfg.repair_temperature if n > 1 and cfg.repair_temperature is not None else cfg.temperature
        options = []
        for sample in range(cfg.repair_samples if n > 1 else 1):
            text = answer({"role": "coder", "model": "coder_early" if n <= cfg.early_rounds else "coder", "system": system, "user": user, "temperature": heat, "seed": seed + 1 + sample})
            mine = text.split("```python\n")[1].split("```")[0].strip() + "\n"
            got = runner.tests(mine, name, json.loads(tests))
            options.append((got["pass_rate"], got["passed"], -tokens(mine), sample, mine, got))
        top = max(options, key=lambda o: o[:3])
        key = top[:3]
        gain = max(0.0, top[0] - best)
        turns.append((run_id, n, top[3], plan, asked, user, top[4], top[1], top[0], round(min(cfg.incentives.max_step, budget * gain) if cfg.incentive else 0.0, 9)))
        if best_key is None or key > best_key:
            best_key, best_at = key, n
            code, feedback = top[4], top[5]
        elif not cfg.best_so_far:
            code, feedback = top[4], top[5]
        best = max(best, top[0])
        if top[1] and cfg.stop_on_pass:
            break
    return turns, best_at


KEYS = fb.FIELDS
WAYS = {
    "sampling": LoopConfig(max_rounds=3, seed=13),
    "on_after_a_pass": LoopConfig(max_rounds=3, stop_on_pass=False, seed=2, incentives=IncentiveConfig(max_step=0.01)),
    "evaluation": evaluation(4, best_so_far=True, repair_samples=3, repair_temperature=0.2, early_rounds=2, budget=0.03, seed=5),
    "plain_words": evaluation(3, prompts.PLAIN, incentive=False, repair_samples=2, seed=6),
}


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(TASKS, SHAPE).repartition(3)


def execute(df):
    return ex.execute(df, seconds=10.0, once=True)


@pytest.mark.parametrize("way", WAYS)
def test_loop_against_a_plain_one(runs, way):
    cfg = WAYS[way]
    turns = play(runs, cfg, said_by(answer), execute)
    got = sorted((r.run_id, r.round, r.sample, r.plan, r.planner_request, r.coder_request, r.code, r.passed, r.pass_rate, round(r.incentive, 9)) for r in turns.collect())
    with ex.Runner(10.0) as runner:
        want = [plain_loop(t, cfg, runner) for t in TASKS]
    assert got == sorted(t for ts, _ in want for t in ts)
    assert max(t[1] for t in got) > 1 and any(t[7] for t in got)
    ends = {r.run_id: r for r in outcomes(turns, runs, cfg).collect()}
    for (run_id, *_), (ts, best_at) in zip(TASKS, want):
        r = ends[run_id]
        final = ts[best_at - 1] if cfg.best_so_far else ts[-1]
        assert (r.rounds, r.selected_round, r.first_round_passed, r.passed, r.pass_rate, r.code) == (len(ts), final[1], ts[0][7], final[7], final[8], final[6])
        assert r.planner_training_text.startswith("Initial plan:\n" + ts[0][3])


def test_goes_on_after_the_last_whole_round(spark, runs, tmp_path):
    cfg, out, asked = WAYS["sampling"], f"{tmp_path}/run", []

    def counted(requests):
        asked.append(requests.select("round").first()["round"])
        return said_by(answer)(requests)

    whole = sorted(map(str, play(runs, cfg, counted, execute, out).collect()))
    assert sorted(set(asked)) == [1, 2, 3]
    asked.clear()
    assert sorted(map(str, play(runs, cfg, counted, execute, out).collect())) == whole and asked == []
    # a round that was cut short has no _SUCCESS: it and what started from it are made again
    (tmp_path / "run/round_02/_SUCCESS").unlink()
    assert sorted(map(str, play(runs, cfg, counted, execute, out).collect())) == whole
    assert sorted(set(asked)) == [2, 3]
    # a shorter run drops the rounds that no longer belong to it
    assert max(r.round for r in play(runs, LoopConfig(max_rounds=1, seed=13), counted, execute, out).collect()) == 1
    assert not (tmp_path / "run/round_03").exists()


def test_empty_and_odd_runs(spark, runs):
    cfg = WAYS["sampling"]
    assert play(runs.limit(0), cfg, said_by(answer), execute).collect() == []
    odd = spark.createDataFrame([("a", None, None, "f", "x", 1), ("b", "t", "", "f", None, 2)], "run_id string, task_id string, prompt string, entry_point string, tests string, code_of_conduct int")
    got = play(odd.withColumn("tests", F.lit(None).cast("string")), cfg, said_by(answer), execute).collect()
    assert {r.run_id for r in got} == {"a", "b"} and not any(r.passed for r in got)
    assert max(r.round for r in got) == 3


def test_executor_limits_and_speed(spark):
    """Candidates that hang, eat memory, kill the server or leave children; equal ones once; ten times a new interpreter's pace."""
    import subprocess
    import sys
    import time

    tests = [{"args": [1], "expected": 2}]
    with ex.Runner(1.0) as r:
        good = "import math\ndef f(x): return x + 1"
        assert r.tests(good, "f", tests)["passed"]
        began = time.time()
        assert r.tests("while True: pass", "f", tests)["timeout"] and time.time() - began < 5
        assert r.tests("import time\ntime.sleep(60)", "f", tests)["timeout"]
        assert r.tests("x = bytearray(3 << 30)", "f", tests)["error_type"] == "MemoryError"
        assert r.tests("import os\nos.kill(os.getppid(), 9)", "f", tests)["error_type"] == "empty_executor_result"
        assert r.tests("raise SystemExit", "f", tests)["error_type"] == "empty_executor_result"
        assert r.tests("def f(x): return [x] * 5000000", "f", tests)["error_type"] == "result_too_large"
        assert r.tests("import sys\nsys.stderr.write('é\\n')\n" + good, "f", tests)["stderr"] == "é\n"
        assert r.tests("import subprocess\nsubprocess.Popen(['sleep', '987'])\n" + good, "f", tests)["passed"]
        time.sleep(0.2)
        assert "sleep 987" not in subprocess.run(["ps", "-eo", "args"], capture_output=True, text=True).stdout
        began = time.time()
        for _ in range(100):
            assert r.tests(good, "f", tests)["passed"]
        own = (time.time() - began) / 100
    began = time.time()
    for _ in range(5):
        subprocess.run([sys.executable, "-I", "-c", "import json, resource, sys"], check=True)
    assert own < (time.time() - began) / 5 / 2
    df = spark.createDataFrame([(i, good if i % 2 else None, "f", json.dumps(tests)) for i in range(20)] + [(99, "", "f", json.dumps(tests))], "i int, code string, entry_point string, tests string")
    both = [sorted((r.i, r.feedback.passed, r.feedback.error_type) for r in ex.execute(df, seconds=10.0, once=once).collect()) for once in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 21
