"""What came of running a candidate, as the compact JSON text that requests show and signatures hash.

A feedback is a struct of passed, pass_rate, passed_tests, total_tests, timeout, error_type, error_message,
assert_results (a JSON array of objects with ``passed``) and stderr; one that is null counts as an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import bound, indented, json_array, json_object, json_string, json_value
from .utility import clamp01

#: Names and kinds of a feedback's plain fields.
KINDS = {"passed": "boolean", "pass_rate": "double", "passed_tests": "int", "total_tests": "int", "timeout": "boolean", "error_type": "string", "error_message": "string"}
FEEDBACK = "struct<passed:boolean,pass_rate:double,passed_tests:int,total_tests:int,timeout:boolean,error_type:string,error_message:string,assert_results:string,stderr:string>"
FIELDS = tuple(x.split(":")[0] for x in FEEDBACK[7:-1].split(","))
#: White space in Python's sense, and what ends a line there.
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@dataclass(frozen=True)
class Compact:
    """How a feedback is written: pass rate clamped or as it is, timeout before or after the error, how many failed asserts, lines of stderr."""

    clamped: bool = False
    timeout_last: bool = False
    most_asserts: int = 6
    stderr_lines: int = 0


#: Sampling of planners and of coders, conversion of rounds, evaluation, baselines.
LEADER = FOLLOWER = Compact(clamped=True)
ROUNDS = Compact()
EVALUATION = Compact(timeout_last=True, most_asserts=8, stderr_lines=8)
BASELINE = Compact(timeout_last=True, most_asserts=0)


def failed_asserts(results: Column) -> Column:
    """The objects of a JSON array whose ``passed`` is missing, null, false, 0 or empty: an array of JSON texts."""
    items = F.from_json(results, "array<string>")
    said = lambda x: F.coalesce(F.get_json_object(x, "$.passed"), F.lit(""))
    return F.filter(items, lambda x: said(x).isin("", "false", "null", "0", "0.0", "[]", "{}"))


def last_lines(text: Column, n: int) -> Column:
    """The last lines of a text without white space around it; an empty array of one without text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SPACE}+|{_SPACE}+$", "")
    tail = lambda lines: F.slice(lines, F.greatest(F.lit(1), F.size(lines) - (n - 1)), F.lit(n))
    return bound(bare, lambda b: F.when(b != "", bound(F.split(b, _LINE_END), tail)).otherwise(F.array().cast("array<string>")))


def compact_feedback(feedback: Column, how: Compact = ROUNDS) -> Column:
    """The feedback as JSON over lines; failed_asserts and stderr_tail stand in it only where there are any."""
    names = [n for n in KINDS if n != "timeout"]
    names = [*names, "timeout"] if how.timeout_last else [*names[:4], "timeout", *names[4:]]
    fields = []
    for name in names:
        value = feedback[name]
        if name == "pass_rate" and how.clamped:
            value = clamp01(F.coalesce(value, F.lit(0.0)))
        fields.append((name, json_value(value, KINDS[name])))
    if how.most_asserts:
        failed = F.coalesce(F.slice(failed_asserts(feedback["assert_results"]), 1, how.most_asserts), F.array().cast("array<string>"))
        fields.append(("failed_asserts", bound(failed, lambda f: F.when(F.size(f) > 0, json_array(F.transform(f, lambda x: indented(x, 2)), 1)))))
    if how.stderr_lines:
        lines = last_lines(feedback["stderr"], how.stderr_lines)
        fields.append(("stderr_tail", bound(lines, lambda f: F.when(F.size(f) > 0, json_array(F.transform(f, json_string), 1)))))
    return json_object(fields, 0)


def state_signature(task_id: Column, previous_code: Column, previous_feedback: Column) -> Column:
    """SHA-256 of what a repair starts from: task, code before and the compact text of what came of it, as JSON with sorted keys.

    A task that isn't named is null in it; code that isn't there is empty.
    """
    code = F.coalesce(previous_code, F.lit(""))
    whole = json_object([("previous_code", json_string(code)), ("previous_feedback", json_string(previous_feedback)), ("task_id", json_value(task_id, "string"))])
    return F.sha2(whole.cast("binary"), 256)
