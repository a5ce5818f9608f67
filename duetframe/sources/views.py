"""Views of the given tables as trajectories, turns, texts, tasks, candidates and runs.

Each is one SELECT that Spark and DuckDB both read ({div} is integer division); queries take the view as a DataFrame,
their oracles as a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read

SQL = {
    "v_traj": (
        ("lineitem",),
        """SELECT task_id, ord, concat(k, '_', ord) AS trajectory_id, pass_rate, pass_rate >= 1.0 AS passed, rounds, planner_tokens,
  coder_tokens, context_tokens, incentive_total, role_penalty, plan, code
FROM (SELECT task_id, k, CAST(row_number() OVER (PARTITION BY task_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS ord,
  pass_rate, rounds, planner_tokens, coder_tokens, context_tokens, incentive_total, role_penalty, plan, code
 FROM (SELECT concat('t', l_orderkey) AS task_id, l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
   round(l_discount * 10, 4) AS pass_rate, CAST(1 + l_linenumber % 4 AS INT) AS rounds, CAST(l_quantity AS INT) * 3 AS planner_tokens,
   CAST(l_quantity AS INT) * 7 AS coder_tokens, CAST(floor(l_extendedprice / 100) AS INT) AS context_tokens, l_tax AS incentive_total,
   CASE l_returnflag WHEN 'R' THEN CAST(0.08 AS DOUBLE) WHEN 'A' THEN CAST(0.03 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS role_penalty,
   concat('Plan ', l_partkey % 13, ' for ', l_linenumber) AS plan, concat('def f(): return ', l_partkey % 3) AS code FROM {lineitem}) a) b""",
    ),
    "v_turn": (
        ("events",),
        """SELECT concat('u', user_id) AS task_id, concat(user_id, '_', (rn - 1) {div} 4) AS trajectory_id, CAST((rn - 1) % 4 + 1 AS INT) AS round,
  k / 99.0e0 AS pass_rate, k >= 90 AS passed, CAST(floor(abs(value) * 10) AS INT) AS code_tokens, CAST(k % 40 AS INT) AS plan_tokens,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 1 THEN 'SyntaxError' ELSE 'IndentationError' END END AS error_type,
  concat(' Plan ', event_type, ' ', k % 20, ' ') AS plan, concat('code ', k % 7) AS code, k * 0.001e0 AS incentive, event_id AS ord
FROM (SELECT user_id, event_type, value, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events}) a""",
    ),
    "v_feed": (
        ("events",),
        """SELECT a.*, k % 3 / 2.0e0 AS fb_rate, CAST(k % 3 AS INT) AS passed_tests, CAST(2 AS INT) AS total_tests, k % 11 = 0 AS timeout,
  CASE WHEN error_type IS NOT NULL THEN concat('bad "', error_type, '"', chr(10), chr(9), 'é') END AS error_message,
  concat('[', concat_ws(', ', {asserts}), ']') AS assert_results,
  CASE ord % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat('warn ', code, chr(10)) ELSE concat('  a', chr(10), 'b', chr(10), 'c', chr(10), 'd', chr(10), 'e', chr(10), 'f', chr(10), 'g', chr(10), 'h', chr(10), '"i"', chr(10), 'j', chr(10)) END AS stderr
FROM (SELECT t.*, CAST(round(pass_rate * 99) AS INT) AS k FROM ({v_turn}) t) a""",
    ),
    "v_text": (
        ("documents", "labels"),
        """SELECT d.doc_id AS ord, d.source AS task_id, concat(CASE d.doc_id % 13 WHEN 0 THEN 'Estimated effort tokens: ' WHEN 1 THEN 'estimated total tokens = ' ELSE 'Steps ' END, d.n_chars % 900, ' ',
  d.text,
  CASE d.doc_id % 12 WHEN 0 THEN ' ```python x``` ' WHEN 1 THEN ' def solve (a)' WHEN 2 THEN ' assert x' WHEN 3 THEN ' some test cases' WHEN 4 THEN ' Here is the final code' WHEN 5 THEN ' corrected code: y'
   WHEN 6 THEN '\n  Code : z' WHEN 7 THEN ' python function' ELSE ' done' END) AS plan,
  d.text AS rejected, coalesce(l.quality, 0) = 1 AS passed, l.quality IS NOT NULL AS has_metrics, d.n_chars % 11 / 10.0e0 AS pass_rate,
  d.n_chars % 97 / 100.0e0 AS utility_delta, d.n_chars % 31 / 10.0e0 AS weight, d.n_chars % 7 / 10.0e0 - 0.1e0 AS chosen_utility
FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    ),
    "v_task": (
        ("customer",),
        """SELECT concat('u', c_custkey) AS task_id, c_custkey AS ord, concat('Task ', c_name, ' ', c_mktsegment) AS prompt, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('s', c_custkey) END AS source_task_id,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'train' WHEN c_custkey % 4 = 2 THEN 'valid' ELSE 'test' END AS split,
  CAST(c_custkey % 700 AS INT) AS prompt_tokens, CAST(abs(floor(c_acctbal)) AS INT) % 900 AS test_tokens, CAST(c_custkey % 50 AS INT) AS plan_tokens,
  CASE WHEN c_custkey % 5 > 1 THEN CAST(c_custkey % 1000 AS INT) END AS stated_effort
FROM {customer}""",
    ),
    "v_cand": (
        ("lineitem",),
        """SELECT state_id, task_id, CAST(row_number() OVER (PARTITION BY state_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS BIGINT) AS ord, concat(state_id, '_', row_number() OVER (PARTITION BY state_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice)) AS candidate_id,
  round, pass_rate, pass_rate >= 0.8e0 AS passed, best_before, code_tokens, budget, max_step, code, incentive
FROM (SELECT concat('s', l_suppkey, '_', l_orderkey % 97) AS state_id, concat('u', l_suppkey) AS task_id, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice,
  CAST(1 + l_orderkey % 97 % 3 AS INT) AS round, round(l_discount * 10, 4) AS pass_rate, l_orderkey % 97 % 5 / 10.0e0 AS best_before, CAST(l_quantity AS INT) AS code_tokens, l_tax AS incentive,
  0.05e0 AS budget, 0.04e0 AS max_step, concat(' return ', l_partkey % 2, ' ') AS code FROM {lineitem}) a""",
    ),
    "v_msg": (
        ("conversations",),
        """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS sender, role, text AS content FROM {conversations}""",
    ),
    "v_gen": (
        ("lineitem",),
        """SELECT task_id, call, prompt_tokens, completion_tokens, pass_rate, pass_rate >= 0.8e0 AS passed, concat('def f', call, '(x): return ', prompt_tokens) AS text
FROM (SELECT concat('t', l_orderkey) AS task_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INT) AS call,
  CAST(l_quantity AS INT) AS prompt_tokens, CAST(l_quantity AS INT) * 2 AS completion_tokens, round(l_discount * 10, 4) AS pass_rate FROM {lineitem}) a""",
    ),
    "v_run": (
        ("part",),
        """SELECT p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'direct_prompt' WHEN 1 THEN 'self_consistency_3' WHEN 2 THEN 'self_repair' WHEN 3 THEN 'agentcoder' ELSE 'other' END AS method,
  CAST(p_size * 61 AS INT) AS budget, p_retailprice AS tokens, p_partkey % 17 AS final_passed, p_retailprice / 2500 AS assert_rate, p_partkey % 3 = 0 AS has_summary, p_partkey % 11 = 0 AS has_failed,
  CASE WHEN p_partkey % 7 = 0 THEN 'round2' ELSE 'round4' END AS setting, p_brand AS variant
FROM {part}""",
    ),
}

#: What the i-th assert of a turn in v_feed says: ten of them where k % 3 is 0, else three; which fail is a matter of ord's parity.
_ASSERT = """CASE WHEN {i} < CASE WHEN k % 3 = 0 THEN 10 ELSE 3 END THEN concat(chr(123), '"assert": "assert f({i}) == ', chr(92), '"é', chr(92), '"", "passed": ', CASE WHEN ({i} + ord % 2) % 3 > 1 THEN 'true' ELSE 'false, "error": "AssertionError()"' END, chr(125)) END"""
_FEED = SQL["v_feed"][1].replace("{asserts}", ", ".join(_ASSERT.format(i=i) for i in range(10)))
SQL["v_feed"] = (SQL["v_feed"][0], _FEED.replace("{v_turn}", SQL["v_turn"][1]))
#: Columns of v_turn that a turn's feedback is made of.
FED = ("passed", "pass_rate", "error_type", "code", "ord")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = SQL[name]
    return spark.sql(sql.replace("{div}", "div"), **{t: read(spark, sf_dir, t) for t in tables})


def with_feedback(turns: DataFrame) -> DataFrame:
    """Rows with the columns FED, and what v_feed adds to them: row by row, so it can wait until turns have been sorted
    and joined by their narrow columns."""
    return turns.sparkSession.sql(_FEED.replace("({v_turn})", "{turns}"), turns=turns)


def duck(name: str) -> str:
    """The view as a common table expression of DuckDB."""
    tables, sql = SQL[name]
    for t in tables:
        sql = sql.replace("{" + t + "}", t)
    return f"{name} AS ({sql.replace('{div}', '//').replace(chr(92) + 'n', chr(10))})"


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(map(duck, names))
