import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duetframe.llm.vector_codes import ORACLES, codebooks_sha256, decode_vectors, encode_vectors, fit_codebooks, nearest, op11_vector_codes, with_group_error


def brute(x, book):
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 3000), st.sampled_from([1, 5, 300, 2**27]), st.integers(0, 10**6))
def test_nearest_against_all_distances(size, entries, n, top, seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-top, top + 1, (n, size)), rng.integers(-top, top + 1, (entries, size))
    index, distance, came = nearest(x, book)
    want, least = brute(x, book)
    assert (index == want).all() and (distance == least).all()


def test_bounds_leave_entries_out():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(5000, 8)) * 256).astype(np.int64)
    book = x[rng.choice(5000, 64, replace=False)]
    _, _, came = nearest(x, book)
    assert came[0] == 5000 * 64 and came[-1] < came[0] / 4 and came[-1] >= 5000 and came == sorted(came, reverse=True)


def plain(rows, parts=16, entries=64):
    """(vec_id, label, vector) by the contract, in Python integers."""
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    m = len(kept[0][2]) // parts
    cut = lambda v: [v[p * m : p * m + m] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda a, p: min(range(len(books[p])), key=lambda e: (dist(a, books[p][e]), e))
    for _ in range(2):
        got = [[near(cut(v)[p], p) for p in range(parts)] for _, _, v in kept]
        books = [[[sum(c) // len(own) for c in zip(*own)] if (own := [cut(v)[p] for (_, _, v), g in zip(kept, got) if g[p] == e]) else book for e, book in enumerate(books[p])] for p in range(parts)]
    out = []
    for i, lab, v in kept:
        es = [near(cut(v)[p], p) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e in es), sum(dist(cut(v)[p], books[p][e]) for p, e in enumerate(es))))
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    return sorted((i, code, e, total[lab], codebooks_sha256(np.array(books))) for i, lab, code, e in out)


def test_query_against_plain_python_and_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), [float(np.float32(x)) for x in rng.normal(size=32)]) for i in rng.permutation(150)]
    rows += [(200, 1, rows[0][2]), (201, None, rows[1][2]), (202, 1, None), (203, 1, [None, *rows[0][2][1:]]), (204, 1, [float("nan"), *rows[0][2][1:]]), (205, 1, [float("-inf"), *rows[0][2][1:]]), (206, 5, [0.0] * 32), (207, 5, [-1e-9] * 32)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_vector_codes(spark, str(tmp_path))
    want = plain(rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(ORACLES["op11_vector_codes"]).fetchall()) == want


def test_edges(spark):
    shape = "vec_id long, embedding array<double>, label int, error string"
    rows = [(None, [1.0, 2.0], 1, "e"), (1, [0.0, 0.5], None, "e"), (1, [0.0, 0.5], None, "e"), (2, None, 1, "e")]
    df = spark.createDataFrame(rows, shape)
    books = fit_codebooks(df, parts=2)
    assert books.shape == (2, 3, 1)
    coded = with_group_error(encode_vectors(df, books, keep=("label",)))
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted([(None, 1, "0202", 0, 0), (1, None, "0000", 0, 0), (1, None, "0000", 0, 0)], key=repr)
    assert sorted(tuple(r.decoded) for r in decode_vectors(coded, books).collect()) == [(0.0, 0.5), (0.0, 0.5), (1.0, 2.0)]
    none = df.limit(0)
    assert fit_codebooks(none).shape == (16, 0, 0)
    assert with_group_error(encode_vectors(none, fit_codebooks(none), keep=("label",))).collect() == []
    for bad in ([[1.0, 2.0, 3.0]], [[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]], [[1e30, 0.0]]):
        with pytest.raises(ValueError):
            fit_codebooks(spark.createDataFrame([(i, v, 1, "") for i, v in enumerate(bad)], shape), parts=2)
