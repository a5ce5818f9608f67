import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from duetframe.llm.periodic_runs import _all_runs, find_runs, op12_periodic_runs, runs_of


def brute(w):
    """Runs by the definition: for each period the maximal stretches of equal words at that distance."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and not any(all(w[j] == w[j + p] for j in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def as_words(w):
    return [b"%d" % x for x in w]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_automaton_against_the_definition(w):
    assert runs_of(w) == brute(w)
    assert _all_runs([as_words(w)]) == [brute(w)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 12), st.integers(0, 8)), max_size=8))
def test_planted_periods(parts):
    """Words, several times and a bit: in one text, and as several texts that are filtered together."""
    texts = [[*(p * k), *p[:r]] for p, k, r in parts]
    whole = [x for t in texts for x in t]
    assert runs_of(whole) == brute(whole)
    assert _all_runs([as_words(t) for t in [whole, *texts]]) == [brute(t) for t in [whole, *texts]]


def test_long_texts():
    rng = random.Random(4)
    block = [rng.randrange(300) for _ in range(900)]
    w = [rng.randrange(5000) for _ in range(3000)] + block * 5 + [7] * 3000 + [rng.randrange(2) for _ in range(2000)]
    assert _all_runs([as_words(w), [], as_words(w[3000:7500])])[0] == runs_of(w)
    many = [1] * 200_000
    assert runs_of(many) == [(0, 200_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a  # the Fibonacci word: very many squares, no fourth power
    assert runs_of(b) == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark, tmp_path):
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(words(r.text)) < 1500]
    odd = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "a a a a a a"), (-4, "a a a a a"), (-5, "x y x y x y \x0b x y x y\r x y"), (-6, "ab ba " * 40 + "ab"), (10**12, "é " * 7)]
    rows = real + odd
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10
    spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path)).drop("n_words")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digest(d, t) for d, t in rows), key=repr)
    assert dict(got.dtypes)["exponent_milli"] == "bigint"


def test_operator_and_edges(spark):
    rows = [(1, "so so so so so so it goes", "en"), (1, "so so so so so so it goes", "en"), (None, None, None), (3, "", "en"), (4, "one two three", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = find_runs(df, keep=("lang",))
    assert got.columns == ["doc_id", "lang", "n_words", "runs", "collapsed"]
    out = sorted(((r.doc_id, r.lang, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
    assert out == sorted([(1, "en", 8, [(0, 6, 1)], "so it goes")] * 2 + [(None, None, 0, [], ""), (3, "en", 0, [], ""), (4, None, 3, [], "one two three")], key=repr)
    assert find_runs(df.limit(0)).collect() == []
