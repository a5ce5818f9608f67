import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from duetframe.llm import suffix_dedup
from duetframe.llm.suffix_dedup import common_prefixes, op8_suffix_array_dedup, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        out.append((len(d), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def rows_of(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()]


def test_transform():
    rng = np.random.default_rng(4)
    for n, sigma in ((1, 2), (30, 2), (300, 3), (400, 1)):
        text = rng.integers(0, sigma, n)
        text[-1] = 9
        for length in (1, 4, 20):
            order, same = common_prefixes(text, length)
            s = [text[i:].tolist() for i in order]
            assert [x[: length + 1] for x in s] == sorted(x[: length + 1] for x in s)
            assert same.tolist() == [False] + [len(b) >= length and a[:length] == b[:length] for a, b in zip(s, s[1:])]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (40, 60, 90)]
    out = [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 500, "ab" * 400, "Nd, " * 150]
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(5, 150)))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(t))
            p = rng.choice(passage)
            p = p[rng.randrange(60) :] if rng.random() < 0.3 else p
            t = t[:at] + p + t[at:]
        out.append(t)
    near = list(out[20])
    near[len(near) // 2] = "Q"
    return [*out, out[20], "".join(near), out[9] + out[9]]


@pytest.mark.parametrize("how", [{}, {"most_contexts": 2}, {"broadcast_cores": 0}])
def test_equals_brute_force(spark, texts, how):
    df = spark.createDataFrame([(i // 2 if i else None, t, "c", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_bytes int").withColumnRenamed("kept", "core").withColumnRenamed("n_bytes", "name")
    df = df.repartition(3)
    got = rows_of(remove_repeats(df, **how))
    assert sorted(got) == sorted(brute(texts, 200))
    if not how:
        assert remove_repeats(df.limit(0)).collect() == []


def test_long_text(spark, monkeypatch):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [t[:6000] + t[100:700], t[5500:9000], t[0:150] + t[5000:5600]]
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1 << 10)
    suffix_dedup._tables.cache_clear()
    a = [tuple(x.tolist() for x in suffix_dedup.windows(s.encode())) for s in texts]
    monkeypatch.undo()
    suffix_dedup._tables.cache_clear()
    assert all(sum(e - s + 1 for s, e in zip(x[0], x[1])) == len(s) - 199 for x, s in zip(a, texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(rows_of(remove_repeats(df))) == sorted(brute(texts, 200))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_array_dedup(spark, d).collect()}
    assert got == dict(zip(texts, brute(texts.values(), 200)))


@pytest.mark.parametrize("length", [40, 200])
def test_cores_as_one_symbol_give_the_same_and_shorter_texts(length, monkeypatch):
    """Contexts of random texts with much in common, by whole bytes and with the core as one symbol."""
    import numpy as np

    from duetframe.llm import suffix_dedup as sd

    rng = np.random.default_rng(length)
    passages = [rng.integers(97, 101, 3 * length, np.uint8).tobytes() for _ in range(3)]
    found: dict[tuple, dict[bytes, int]] = {}
    for i in range(30):
        p = passages[i % 3]
        cut = int(rng.integers(0, length))
        data = rng.integers(97, 101, 30, np.uint8).tobytes() + p[cut : cut + 2 * length] + rng.integers(97, 101, 30, np.uint8).tobytes()
        for first, last, core, left, right in zip(*(x.tolist() for x in sd.windows(data, length))):
            assert last <= left and right <= first + length and right - left >= sd.least_core(length)
            of = found.setdefault(core, {})
            of[data[first : last + length], left - first] = of.get((data[first : last + length], left - first), 0) + 1
    groups = [(c, n, lo) for of in found.values() if len(of) > 1 for (c, lo), n in of.items()]
    contexts, counts, cores = map(list, zip(*groups))
    seen = []
    monkeypatch.setattr(sd, "common_prefixes", lambda text, n, f=sd.common_prefixes: seen.append((len(text), n)) or f(text, n))
    whole = sd.repeated_starts(contexts, counts, length)
    folded = sd.repeated_starts(contexts, counts, length, cores)
    assert any(m.any() for m in whole) and all((a == b).all() for a, b in zip(whole, folded))
    assert seen[0][0] - seen[1][0] == len(contexts) * (sd.least_core(length) - 1) and seen[1][1] == length - sd.least_core(length) + 1
