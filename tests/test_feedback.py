import hashlib
import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duetframe.functions import feedback as fb
from duetframe.functions.jsontext import indented, json_double, json_string

TEXTS = ["", "plain", 'quote " and \\ back', "line\nline\r\n\ttab", "\x00\x01\x1f\x7f\b\f", "é ß 漢 \U0001f600", "a\u2028b\x85c"]


def test_strings_and_doubles(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", json_string(F.col("t")).alias("j")).collect()
    assert [r.j for r in rows] == [json.dumps(r.t, ensure_ascii=False) for r in rows]
    xs = [0.0, -0.0, 1.0, 0.1, 1 / 3, 2 / 3, 1e-3, 5e-4, 1.5e-4, 1e-4, 9.9e-5, 1e-5, 1.25e-7, 1e-300, 123.0, 9999999.0, 1e7, 12345678.5, 1e15, 123456789012345.0, 1e16, 1.5e16, 1e22, 1.7e308, -2.5, -1e-7, -12345678.25, math.inf, -math.inf]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", json_double(F.col("x")).alias("j")).collect()
    assert [r.j for r in rows] == [json.dumps(r.x) for r in rows]


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9999, 9999) | st.sampled_from([0.5, 1e-7, 3.0]) | st.text(alphabet='ab"\\{}[],: é\n', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="ab:", max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(JSON, min_size=1, max_size=20))
def test_any_json_set_out_over_lines(spark, values):
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", indented(F.col("t")).alias("j")).collect()}
    assert got == {i: json.dumps(v, ensure_ascii=False, indent=2) for i, v in enumerate(values)}


def plain(f, how):
    """The five ways to write a feedback, in plain Python."""
    rate = f["pass_rate"]
    if how.clamped:
        rate = max(0.0, min(1.0, float(rate if rate is not None else 0.0)))
    out = {"passed": f["passed"], "pass_rate": rate, "passed_tests": f["passed_tests"], "total_tests": f["total_tests"]}
    error = {"error_type": f["error_type"], "error_message": f["error_message"]}
    out |= error | {"timeout": f["timeout"]} if how.timeout_last else {"timeout": f["timeout"]} | error
    failed = [a for a in json.loads(f["assert_results"] or "[]") if not a.get("passed")]
    if failed and how.most_asserts:
        out["failed_asserts"] = failed[: how.most_asserts]
    err = (f["stderr"] or "").strip()
    if err and how.stderr_lines:
        out["stderr_tail"] = err.splitlines()[-how.stderr_lines :]
    return json.dumps(out, ensure_ascii=False, indent=2)


ASSERTS = [{"assert": f"assert f({i}) == 'é\"'", "passed": i % 3 == 0, "n": [i, {"x": 0.5}], "error": None} for i in range(20)]
FEEDBACKS = [
    {"passed": False, "pass_rate": 7 / 20, "passed_tests": 7, "total_tests": 20, "timeout": False, "error_type": None, "error_message": None, "assert_results": json.dumps(ASSERTS, ensure_ascii=False), "stderr": " \n".join(f"line {i}" for i in range(12)) + "\n\n"},
    {"passed": True, "pass_rate": 1.0, "passed_tests": 2, "total_tests": 2, "timeout": False, "error_type": None, "error_message": None, "assert_results": json.dumps([{"passed": True}] * 2), "stderr": "   "},
    {"passed": False, "pass_rate": 1.5, "passed_tests": None, "total_tests": 0, "timeout": True, "error_type": "SyntaxError", "error_message": 'bad "x"\n\tat é', "assert_results": "[]", "stderr": "\u3000one\rtwo\x0bthree\u2028four\u00a0"},
    {"passed": None, "pass_rate": None, "passed_tests": 0, "total_tests": 0, "timeout": None, "error_type": "", "error_message": "", "assert_results": json.dumps([{}, {"passed": 0}, {"passed": None, "args": []}, {"passed": ""}, {"passed": 1}]), "stderr": None},
]
WAYS = [fb.LEADER, fb.FOLLOWER, fb.ROUNDS, fb.EVALUATION, fb.BASELINE]


@pytest.fixture(scope="module")
def feedbacks(spark):
    fields = fb.FEEDBACK[7:-1].replace(":", " ")
    names = [x.split()[0] for x in fields.split(",")]
    df = spark.createDataFrame([(i, *(f[n] for n in names)) for i, f in enumerate(FEEDBACKS)], "i int, " + fields)
    return df.select("i", F.struct(*names).alias("f"))


@pytest.mark.parametrize("how", WAYS, ids=["leader", "follower", "rounds", "evaluation", "baseline"])
def test_compact_feedback(feedbacks, how):
    got = {r.i: r.t for r in feedbacks.select("i", fb.compact_feedback(F.col("f"), how).alias("t")).collect()}
    assert got == {i: plain(f, how) for i, f in enumerate(FEEDBACKS)}


def test_no_feedback_at_all(spark):
    df = spark.range(1).select(F.lit(None).cast(fb.FEEDBACK).alias("f"))
    for how in WAYS:
        assert df.select(fb.compact_feedback(F.col("f"), how).alias("t")).first().t == plain(dict.fromkeys(FEEDBACKS[0]), how)


def test_signature(feedbacks):
    text = fb.compact_feedback(F.col("f"))
    code = F.when(F.col("i") > 0, F.concat(F.lit('def f():\n\treturn "é"\n#'), F.col("i").cast("string")))
    got = {r.i: r.s for r in feedbacks.select("i", fb.state_signature(F.when(F.col("i") < 3, F.lit('HumanEval/"1"')), code, text).alias("s")).collect()}
    want = {}
    for i, f in enumerate(FEEDBACKS):
        whole = {"task_id": 'HumanEval/"1"' if i < 3 else None, "previous_code": f'def f():\n\treturn "é"\n#{i}' if i else "", "previous_feedback": plain(f, fb.ROUNDS)}
        want[i] = hashlib.sha256(json.dumps(whole, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert got == want


def test_repairs_need_the_same_failed_asserts(spark):
    """Two turns that differ in one failed assert only start from different states; training rows show what the chosen side saw."""
    from duetframe.operators import training_rows as rows

    base = dict(FEEDBACKS[0])
    other = json.dumps([{**a, "n": None} if i == 1 else a for i, a in enumerate(ASSERTS)], ensure_ascii=False)
    late = json.dumps([{**a, "n": None} if i == 19 else a for i, a in enumerate(ASSERTS)], ensure_ascii=False)  # beyond the first six failed ones
    first = {"a": base["assert_results"], "b": base["assert_results"], "c": other, "d": late}
    names = list(fb.FIELDS)
    kinds = fb.FEEDBACK[7:-1].replace(":", " ")
    df = spark.createDataFrame([(t, *((base | {"assert_results": first[t]})[n] for n in names)) for t in first], f"trajectory_id string, {kinds}")
    text = fb.compact_feedback(F.struct(*names))
    turns = df.select("trajectory_id", F.lit(2).alias("round"), F.concat(F.lit("plan "), "trajectory_id").alias("plan"), F.lit("code").alias("previous_code"), text.alias("previous_feedback"), F.lit("state").alias("state_text"))
    turns = turns.withColumn("signature", fb.state_signature(F.lit("t"), F.col("previous_code"), F.col("previous_feedback")))
    pairs = spark.createDataFrame([("t", "a", "b", 0.1), ("t", "a", "c", 0.2), ("t", "a", "d", 0.3), ("t", "b", "b", 0.4)], "task_id string, chosen_id string, rejected_id string, utility_delta double")
    got = {(r.chosen_id, r.rejected_id): r.kept for r in rows.repair_examples(pairs, turns).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("a", "d"): True, ("b", "b"): False}
    made = {r.metadata.rejected_trajectory_id: r for r in rows.repair_rows(pairs, turns).collect()}
    assert set(made) == {"b", "d"}
    human = f"Task state:\nstate\n\nPrevious code:\ncode\n\nExecution feedback:\n{plain(base, fb.ROUNDS)}\n\nGive a concise repair plan for the coder. Do not write code."
    assert made["b"].conversations[1].value == human and made["b"].chosen.value == "plan a\n" and made["d"].metadata.utility_delta == 0.3
    assert made["b"].metadata.stage == "leader_repair_strict" and made["b"].metadata.round == 2
