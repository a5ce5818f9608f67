"""Candidate code run against tests, each candidate in a process of its own with limits on time and memory.

A task starts one small server process, which forks a child for each candidate: a fork costs a millisecond or two, a new
interpreter some thirty. A child that outlives its time is killed with all that it has started; a server that dies or
hangs is replaced, and the candidate that it died of counts as vanished.
"""

from __future__ import annotations

import ast
import json
import os
import select
import struct
import subprocess
import sys
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Address space of a child, and bytes of its result and of its stderr (its end) that are kept.
MOST_MEMORY, MOST_RESULT, MOST_STDERR = 1 << 30, 8 << 20, 1 << 14
#: The server: jobs {code, entry_point, tests or asserts, seconds} come in with their length in front, answers
#: {state, result, stderr} go out the same way.
_SERVER = """
import json, os, resource, select, signal, struct, sys, time
MEMORY, RESULT, STDERR = map(int, sys.argv[1:4])

def tests_of(space, job):
    f = space.get(job["entry_point"])
    if not callable(f):
        return {"error_type": "missing_entry_point", "error_message": job["entry_point"]}
    rows = []
    for t in job["tests"]:
        row = {"args": t.get("args", []), "expected": t.get("expected"), "actual": None, "passed": False}
        try:
            row["actual"] = f(*row["args"]); row["passed"] = bool(row["actual"] == row["expected"])
        except Exception as e:
            row["error"] = repr(e)
        rows.append(row)
    return {"assert_results": rows}

def asserts_of(space, job):
    if job["entry_point"]:
        space["candidate"] = space[job["entry_point"]]
    rows = []
    for t in job["asserts"]:
        row = {"assert": t, "passed": False}
        try:
            exec(t, space, space); row["passed"] = True
        except Exception as e:
            row["error"] = repr(e)
        rows.append(row)
    return {"assert_results": rows}

def child(job, out):
    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    resource.setrlimit(resource.RLIMIT_CPU, (int(job["seconds"]) + 1,) * 2)
    try:
        space = {"__name__": "candidate"}
        exec(job["code"], space, space)
        got = (tests_of if "tests" in job else asserts_of)(space, job)
    except Exception as e:
        got = {"error_type": type(e).__name__, "error_message": str(e)}
    sys.stdout.flush(); sys.stderr.flush()
    text = json.dumps(got, default=repr, ensure_ascii=False).encode("utf-8", "replace")
    with os.fdopen(out, "wb") as f:
        f.write(text)

def run(job):
    r, w = os.pipe(); er, ew = os.pipe()
    pid = os.fork()
    if not pid:
        try:
            os.setsid()
            os.close(r); os.close(er)
            null = os.open(os.devnull, os.O_RDWR)
            os.dup2(null, 0); os.dup2(ew, 1); os.dup2(ew, 2)
            child(job, w)
        finally:
            os._exit(0)
    os.close(w); os.close(ew)
    end, result, err, state, open_ = time.monotonic() + job["seconds"], b"", b"", "ended", {r, er}
    while r in open_:
        left = end - time.monotonic()
        ready = select.select(list(open_), [], [], max(0, left))[0] if left > 0 else []
        if not ready:
            state = "timeout"; break
        for fd in ready:
            data = os.read(fd, 65536)
            if not data:
                open_.discard(fd)
            elif fd == r:
                result += data
            else:
                err = (err + data)[-STDERR:]
        if len(result) > RESULT:
            state = "too_large"; break
    if state == "ended" and er in open_ and select.select([er], [], [], 0)[0]:
        err = (err + os.read(er, 65536))[-STDERR:]
    try:
        os.killpg(pid, signal.SIGKILL)
    except OSError:
        try:
            os.kill(pid, signal.SIGKILL)
        except OSError:
            pass
    os.waitpid(pid, 0)
    os.close(r); os.close(er)
    return {"state": state, "result": result.decode("utf-8", "replace") if state == "ended" else "", "stderr": err.decode("utf-8", "replace")}

source, sink = sys.stdin.buffer, sys.stdout.buffer
while True:
    size = source.read(4)
    if len(size) < 4:
        break
    answer = json.dumps(run(json.loads(source.read(struct.unpack("<I", size)[0])))).encode()
    sink.write(struct.pack("<I", len(answer)) + answer); sink.flush()
"""
RESULT = T.StructType(
    [
        T.StructField("passed", T.BooleanType()),
        T.StructField("pass_rate", T.DoubleType()),
        T.StructField("passed_tests", T.IntegerType()),
        T.StructField("total_tests", T.IntegerType()),
        T.StructField("timeout", T.BooleanType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("assert_results", T.StringType()),
        T.StructField("stderr", T.StringType()),
    ]
)
_KIND = pa.struct([("passed", pa.bool_()), ("pass_rate", pa.float64()), ("passed_tests", pa.int32()), ("total_tests", pa.int32()), ("timeout", pa.bool_()), ("error_type", pa.string()), ("error_message", pa.string()), ("assert_results", pa.string()), ("stderr", pa.string())])


class Runner:
    """A server process and the client's side of it; use it as a context. It starts with the first job."""

    def __init__(self, seconds: float = 2.0):
        self.seconds, self.server = seconds, None

    def __enter__(self) -> Runner:
        return self

    def __exit__(self, *_) -> None:
        if self.server:
            self.server.kill()
            self.server.wait()
            self.server.stdin.close()
            self.server.stdout.close()
            self.server = None

    def _answer(self, job: dict) -> dict | None:
        """What the server says of the job; None if it died or hung."""
        if not self.server:
            args = [sys.executable, "-I", "-c", _SERVER, *map(str, (MOST_MEMORY, MOST_RESULT, MOST_STDERR))]
            self.server = subprocess.Popen(args, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={}, start_new_session=True)
        text = json.dumps(job).encode()
        end = time.monotonic() + self.seconds + 10
        try:
            self.server.stdin.write(struct.pack("<I", len(text)) + text)
            self.server.stdin.flush()
            got, need = b"", 4
            while len(got) < need:
                left = end - time.monotonic()
                if left <= 0 or not select.select([self.server.stdout], [], [], left)[0]:
                    raise TimeoutError
                data = os.read(self.server.stdout.fileno(), 1 << 20)
                if not data:
                    raise EOFError
                got += data
                if len(got) >= 4:
                    need = 4 + struct.unpack("<I", got[:4])[0]
            return json.loads(got[4:])
        except (OSError, EOFError, TimeoutError, ValueError):
            self.server.kill()
            self.__exit__()
            return None

    def run(self, job: dict, total: int) -> dict:
        base = {"passed": False, "pass_rate": 0.0, "passed_tests": 0, "total_tests": total, "timeout": False, "error_type": None, "error_message": None, "assert_results": "[]", "stderr": ""}
        said = self._answer(job | {"seconds": self.seconds})
        if said is None:
            return base | {"error_type": "empty_executor_result"}
        base["stderr"] = said["stderr"]
        if said["state"] == "timeout":
            return base | {"timeout": True}
        if said["state"] == "too_large":
            return base | {"error_type": "result_too_large"}
        try:
            result = json.loads(said["result"])
        except ValueError:
            return base | {"error_type": "empty_executor_result"}
        rows = result.get("assert_results", [])
        n = sum(r["passed"] for r in rows)
        return base | {"passed": n == total > 0, "pass_rate": n / total if total else 0.0, "passed_tests": n, "error_type": result.get("error_type"), "error_message": result.get("error_message"), "assert_results": json.dumps(rows, ensure_ascii=False)}

    def tests(self, code: str | None, entry_point: str | None, tests: list[dict]) -> dict:
        return self.run({"code": code or "", "entry_point": entry_point or "", "tests": tests}, len(tests))

    def asserts(self, code: str | None, entry_point: str | None, test: str | None) -> dict:
        found = asserts_of(test)
        return self.run({"code": code or "", "entry_point": entry_point or "", "asserts": found}, len(found))


def run_tests(code: str | None, entry_point: str | None, tests: list[dict], seconds: float = 2.0) -> dict:
    """One candidate: passed only if there are tests and all hold; a timeout or a process that vanishes counts as 0."""
    with Runner(seconds) as r:
        return r.tests(code, entry_point, tests)


def execute(df: DataFrame, code: str = "code", entry_point: str = "entry_point", tests: str = "tests", seconds: float = 2.0, once: bool = False) -> DataFrame:
    """Adds feedback (RESULT) to every row; tests is a JSON list of {args, expected}.

    once: of rows with equal code, entry point and tests one is run, and all get what came of it. The rows are read twice
    for that, so store them before if making them is dear.
    """
    return _with_feedback(df, (code, entry_point, tests), lambda r, c, e, t: r.tests(c, e, json.loads(t or "[]")), seconds, once)


def _with_feedback(df: DataFrame, of: tuple[str, ...], run_one, seconds: float, once: bool) -> DataFrame:
    if once:
        # a null and an empty text do the same
        told = F.sha2(F.concat_ws("\0", *(F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in of)), 256)
        keyed = df.withColumn("__told", told)
        each = keyed.groupBy("__told").agg(*(F.first(c).alias(c) for c in of))
        ran = _run_all(each, of, run_one, seconds).select("__told", "feedback")
        return keyed.join(ran, "__told").drop("__told")
    return _run_all(df, of, run_one, seconds)


def _run_all(df: DataFrame, of: tuple[str, ...], run_one, seconds: float) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("feedback", RESULT)])
    at = [df.columns.index(c) for c in of]

    def run(batches):
        with Runner(seconds) as r:
            for b in batches:
                got = [run_one(r, *row) for row in zip(*(b.column(i).to_pylist() for i in at))]
                yield b.append_column("feedback", pa.array(got, _KIND))

    return df.mapInArrow(run, schema)


def asserts_of(test: str | None) -> list[str]:
    """The assert statements of a test's source, in order, wherever they stand; none if it can't be parsed."""
    try:
        return [ast.unparse(n) for n in ast.walk(ast.parse(test or "")) if isinstance(n, ast.Assert)]
    except (SyntaxError, ValueError):
        return []


def run_asserts(code: str | None, entry_point: str | None, test: str | None, seconds: float = 2.0) -> dict:
    """As run_tests, with the tests given as source whose assert statements call the function (also as ``candidate``)."""
    with Runner(seconds) as r:
        return r.asserts(code, entry_point, test)


def execute_asserts(df: DataFrame, code: str = "code", entry_point: str = "entry_point", test: str = "test", seconds: float = 2.0, once: bool = False) -> DataFrame:
    """Adds feedback (RESULT) to every row; test is source with assert statements. once: as in execute."""
    return _with_feedback(df, (code, entry_point, test), lambda r, c, e, t: r.asserts(c, e, t), seconds, once)


def count_asserts(source: str | None) -> int:
    try:
        return sum(isinstance(n, ast.Assert) for n in ast.walk(ast.parse(source or "")))
    except (SyntaxError, ValueError):
        return 0


def with_assert_count(df: DataFrame, source: str = "test", easy: int = 4, medium: int = 9) -> DataFrame:
    """Adds n_asserts (assert statements anywhere in the code; 0 if it can't be parsed) and difficulty."""
    schema = T.StructType([*df.schema.fields, T.StructField("n_asserts", T.IntegerType())])
    at = df.columns.index(source)

    def run(batches):
        for b in batches:
            yield b.append_column("n_asserts", pa.array([count_asserts(s) for s in b.column(at).to_pylist()], pa.int32()))

    n = F.col("n_asserts")
    return df.mapInArrow(run, schema).withColumn("difficulty", F.when(n <= easy, "easy").when(n <= medium, "medium").otherwise("hard"))


def with_pretty_json(df: DataFrame, of: list[str], name: str = "json") -> DataFrame:
    """Adds the named columns as JSON with an indent of 2, keys in the order given, nulls kept, non-ASCII kept."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    at = [df.columns.index(c) for c in of]

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in at))
            yield b.append_column(name, pa.array([json.dumps(dict(zip(of, r)), ensure_ascii=False, indent=2, default=str) for r in rows], pa.string()))

    return df.mapInArrow(run, schema)
