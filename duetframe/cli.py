"""Command line: a registered query, the tiny run, the run from trajectories (whole or in stages), its check, an ablation."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import UtilityConfig, from_section, load, section
from .plans import QUERIES, pipelines
from .sources import readers


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="duetframe")
    sub = ap.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="write a registered query's rows as Parquet")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("tables")
    q.add_argument("out")
    t = sub.add_parser("tiny", help="run candidates against tests, score, pair and clean")
    t.add_argument("tasks")
    t.add_argument("trajectories")
    t.add_argument("out")
    t.add_argument("--config")
    f = sub.add_parser("from-trajectories", help="pair and clean sampled trajectories (Parquet)")
    f.add_argument("trajectories")
    f.add_argument("out")
    f.add_argument("--config")
    g = sub.add_parser("staged", help="as from-trajectories, with a table for each stage, gates and a manifest; goes on where it ended")
    g.add_argument("trajectories")
    g.add_argument("out")
    g.add_argument("--config")
    g.add_argument("--again", action="store_true", help="do stages again that are done")
    v = sub.add_parser("verify", help="check the tables of a staged run; exit 1 if a rule is broken")
    v.add_argument("run")
    b = sub.add_parser("ablation", help="table of variants from their runs (JSON lines), as CSV and Markdown")
    b.add_argument("runs")
    b.add_argument("out")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("duetframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "query":
        QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
        return 0
    if a.command == "verify":
        found = pipelines.check(*(spark.read.parquet(f"{a.run}/{name}") for name in ("leader", "clean", "follower", "candidates"))).collect()  # a row for each rule
        for r in found:
            print(f"{r.rule}\t{r.broken}")
        return int(any(r.broken for r in found))
    if a.command == "ablation":
        shape = T.StructType([T.StructField(c, k) for c, k in (("variant", T.StringType()), ("task_id", T.StringType()), ("passed", T.BooleanType()), ("assert_rate", T.DoubleType()), ("tokens", T.LongType()), ("rounds", T.IntegerType()))])
        table = pipelines.ablation(readers.read_jsonl(spark, a.runs, shape))
        readers.write_csv(table, a.out)
        print(readers.report(table, table.columns, {"final_pass_rate": 2, "avg_assert_pass_rate": 2, "avg_total_tokens": 2, "leader_utility": 2}), end="")
        return 0
    cfg = from_section(UtilityConfig, section(load(a.config), "utility")) if a.config else UtilityConfig()
    if a.command == "staged":
        table = load(a.config) if a.config else {}
        rules = {name: [tuple(rule) for rule in of] for name, of in section(table, "gates").items()}
        made = pipelines.staged(spark, spark.read.parquet(a.trajectories), a.out, cfg, rules, not a.again)
        print(json.dumps(made, indent=2))
        return 0
    if a.command == "tiny":
        tasks = readers.read_jsonl(spark, a.tasks, pipelines.TASK)
        rows = readers.with_ordinal(readers.read_jsonl(spark, a.trajectories, pipelines.TRAJECTORY))
        made = pipelines.tiny(spark, tasks, rows, cfg)
    else:
        made = pipelines.from_trajectories(spark.read.parquet(a.trajectories), cfg)
    for name, df in made.items():
        readers.write_jsonl(df.select(*(F.col(c) for c in df.columns if c != "order")), f"{a.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
