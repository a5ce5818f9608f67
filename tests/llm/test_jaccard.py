import random
import re
from itertools import combinations

import pytest

from duetframe.llm import jaccard
from duetframe.llm.common import connected_components
from duetframe.llm.jaccard import jaccard_groups, keep_one_of_each_group


def sets_of(texts, k):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = min(k, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def brute(rows, k, percent):
    sets = sets_of([t for _, t in rows], k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def brute_links(rows, k, percent):
    sets = sets_of([t for _, t in rows], k)
    n = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            n[i] += 1
            n[j] += 1
    return [(d, x) for (d, _), x in zip(rows, n)]


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    texts = ["", None, "  \n", "one two", "One  TWO", "a b c", "É é", "é é"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t[: -rng.randint(1, 3)] or t
            texts.append(" ".join(t))
    texts += [passage + " " + " ".join(rng.choice(vocab) + str(rng.random()) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    return rows + [(None, "one two three four five six seven eight nine ten eleven"), (None, None), rows[3], rows[5], (rows[6][0], "other text of the same id here")]


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_equals_brute_force(spark, k, percent, seed):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, key string, n int")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(df, k, percent).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(brute(rows, k, percent), key=order)


def test_one_of_each_stays(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x y"), (2, "x y"), (4, ""), (4, ""), (None, "q r s t"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = keep_one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y"), (4, ""), (4, ""), (None, "q r s t"), (5, None)], df.schema).collect()))
    assert jaccard_groups(df.limit(0)).collect() == [] and keep_one_of_each_group(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [1000, 4])
def test_number_of_links_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    monkeypatch.setattr(jaccard, "BESIDE_PIVOT", block)
    rows = made(4)
    df = spark.createDataFrame([(None if i is None else f"d{i}", t, 1, 2) for i, t in rows], "doc_id string, text string, n_links int, node int")
    got = [(r.doc_id, r.n_links) for r in jaccard_groups(df, 3, 80).collect()]
    want = [(None if i is None else f"d{i}", n) for i, n in brute_links(rows, 3, 80)]
    assert sorted(got, key=lambda r: (r[0] or "", r[1])) == sorted(want, key=lambda r: (r[0] or "", r[1]))
    assert max(n for _, n in want) > 8


def test_rows_that_repeat_very_often(spark):
    rows = [(1, "a b c d e f g h i j k")] * 60 + [(2, "a b c d e f g h i j z")] * 40 + [(3, "x y z")] * 20
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(1, 1, 99)] * 60 + [(2, 1, 99)] * 40 + [(3, 3, 19)] * 20
