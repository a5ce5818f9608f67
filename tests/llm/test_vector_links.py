import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duetframe.llm.vector_links import Grid, block_links, fit_grid, op13_vector_links, vector_links


def unit(x):
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def components(linked):
    label = np.arange(len(linked))
    for _ in range(len(linked)):
        label = np.minimum(label, np.where(linked, label, len(label)).min(1, initial=len(label)))
    return label


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 40), st.sampled_from([-0.2, 0.3, 0.8, 0.97]), st.integers(0, 10**6))
def test_blocks_against_all_pairs(r, v, least, seed):
    rng = np.random.default_rng(seed)
    x, y = unit(rng.normal(size=(r, 3))), unit(rng.normal(size=(v, 3)))
    nx, ny = rng.integers(1, 4, r), rng.integers(1, 4, v)
    links, _, of, _ = block_links(x, nx, None, None, least)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    assert (links == linked @ nx).all()
    assert ((of >= 0) == linked.any(1)).all()
    want = components(linked)
    at = np.flatnonzero(of >= 0)
    assert (want[of[at]] == want[at]).all() and len(set(of[at])) == len(set(want[at]))
    if not v:
        return
    lx, ly, of_x, of_y = block_links(x, nx, y, ny, least)
    met = y @ x.T >= least
    assert (lx == ny @ met).all() and (ly == met @ nx).all()
    whole = np.zeros((r + v, r + v), bool)
    whole[r:, :r], whole[:r, r:] = met, met.T
    want, of = components(whole), np.r_[of_x, of_y]
    at = np.flatnonzero(of >= 0)
    assert (whole.any(1) == (of >= 0)).all()
    assert (want[of[at]] == want[at]).all() and len(set(of[at])) == len(set(want[at]))


def multi_sequence(a, b, stop):
    """Cells by rising sum of two sorted sequences, from a heap of the frontier, up to ``stop`` beyond the first."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
    first = heap[0][0]
    while heap and heap[0][0] <= first + stop:
        _, p, q = heapq.heappop(heap)
        out.append((i[p], j[q]))
        for n in ((p + 1, q), (p, q + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[i[n[0]]] + b[j[n[1]]], *n))
    return out


def test_walk_is_a_multi_sequence_traversal():
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(200, 10)))
    grid = fit_grid(x, 12, 0.9)
    home, row, cell = grid.walk(x)
    a, b = grid.distances(x)
    assert (home == grid.home(x)).all()
    for k in range(len(x)):
        assert {i * 12 + j for i, j in multi_sequence(a[k], b[k], grid.stop)} == set(cell[row == k].tolist())
    one = Grid(grid.first[:1], grid.second[:1])
    assert one.walk(x)[0].tolist() == [0] * 200


def planted(rng, cosines, n=1500, size=24):
    """Vectors, of which some have a neighbour at each of the cosines."""
    x = unit(rng.normal(size=(n, size)))
    out = [x]
    for c in cosines:
        base = x[rng.choice(n, 150, replace=False)]
        away = rng.normal(size=base.shape)
        away = unit(away - (away * base).sum(1, keepdims=True) * base)
        out.append((c * base + np.sqrt(1 - c * c) * away) * rng.uniform(0.1, 5, (len(base), 1)))
    return np.concatenate(out)


def brute(x, least=0.9):
    u = unit(x)
    linked = u @ u.T >= least
    np.fill_diagonal(linked, False)
    return linked


def test_recall_at_the_limit(spark):
    """Neighbours just above the limit are the hardest: all nearer ones are found more surely."""
    rng = np.random.default_rng(8)
    for cosines, recall in (((0.901,), 0.9), ((0.95,), 0.97), ((0.99,), 0.99)):
        x = planted(rng, cosines)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
        got = sorted(vector_links(df).collect())
        want = brute(x).sum(1)
        found = np.array([r.n_links for r in got])
        assert (found <= want).all() and found.sum() >= recall * want.sum() > 0


def test_query_against_brute_force(spark, tmp_path):
    """Families of copies, equal vectors, a chain, and rows that link with nothing."""
    rng = np.random.default_rng(9)
    base = unit(rng.normal(size=(6, 16)))
    families = np.concatenate([b + rng.normal(size=(m, 16)) * s for b, m, s in zip(base, (300, 40, 5, 2, 30, 3), (0.05, 0.02, 0.01, 0.001, 0.11, 0.0))])
    angle = np.arange(12) * 0.4
    chain = np.zeros((12, 16))
    chain[:, 0], chain[:, 1] = np.cos(angle), np.sin(angle)
    x = np.concatenate([families, families[:30], chain, rng.normal(size=(700, 16))]).astype(np.float32)
    ids = rng.permutation(len(x)) + 100
    rows = [(int(i), v) for i, v in zip(ids, x.tolist())]
    odd = [(1, None), (2, [0.0] * 16), (3, [None, *x[0].tolist()[1:]]), (4, [float("nan"), *x[0].tolist()[1:]]), (5, [float("inf"), *x[0].tolist()[1:]]), (5, None)]
    spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, node string, n int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_vector_links(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    linked = brute(x.astype(float))
    label = components(linked)
    least = {c: int(ids[label == c].min()) for c in set(label.tolist())}
    want = [(int(i), int(k), least[c], int(i) == least[c]) for i, k, c in zip(ids, linked.sum(1), label.tolist())]
    want += [(i, 0, i, True) for i, _ in odd]
    out = sorted(map(tuple, got.collect()))
    # families this large lie across many cells: their few missed pairs cost links, not components
    assert [(r[0], r[2], r[3]) for r in out] == [(r[0], r[2], r[3]) for r in sorted(want)]
    assert sum(r[1] for r in out) >= 0.98 * sum(r[1] for r in want) and all(a[1] <= b[1] for a, b in zip(out, sorted(want)))


def test_crowded_cell_goes_over_tiles(spark):
    """One family of 1,200 among 300: cut into tiles and chunks, every pair still counted once."""
    rng = np.random.default_rng(10)
    x = np.concatenate([unit(rng.normal(size=(1, 8))) + rng.normal(size=(1200, 8)) * 0.01, rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = sorted(vector_links(df).collect())
    want = brute(x).sum(1)
    found = np.array([r.n_links for r in got])
    assert (found[:1200] == want[:1200]).all() and (found <= want).all()
    assert {r.component_id for r in got[:1200]} == {0}


def test_edges(spark):
    shape = "vec_id long, embedding array<double>, component_id string"
    rows = [(None, [1.0, 0.0], "c"), (1, [2.0, 0.0], "c"), (1, [2.0, 0.0], "c"), (1, [0.0, 1e300], "c"), (7, [1e-300, 1e-300], "c"), (8, None, "c")]
    df = spark.createDataFrame(rows, shape)
    got = sorted(map(tuple, vector_links(df).collect()), key=repr)
    assert got == sorted([(None, 2, 1), (1, 2, 1), (1, 2, 1), (1, 0, 1), (7, 0, 7), (8, 0, 8)], key=repr)
    assert vector_links(df.limit(0)).collect() == []
    assert [tuple(r) for r in vector_links(df.where("vec_id = 8")).collect()] == [(8, 0, 8)]
    with pytest.raises(ValueError):
        vector_links(spark.createDataFrame([(1, [1.0], ""), (2, [1.0, 2.0], "")], shape))
    assert sorted(r.n_links for r in vector_links(spark.createDataFrame([(1, [1.0], ""), (2, [-2.0], ""), (3, [5.0], "")], shape)).collect()) == [0, 1, 1]
