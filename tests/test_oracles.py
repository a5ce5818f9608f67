"""Every registered query that SQL can express against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()


def shown(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shown(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, D)
    rel = duck.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert not [c for c in rel.description if "DECIMAL" in str(c[1]) or "HUGEINT" in str(c[1])]
    want = sorted("|".join(shown(v) for _, v in sorted(zip(cols, r))) for r in rel.fetchall())
    got = sorted("|".join(shown(v) for _, v in sorted(r.asDict(True).items())) for r in df.collect())
    assert got == want


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(ORACLES) <= set(__spark_entry__.queries())
