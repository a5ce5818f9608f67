import hashlib
import random

from pyspark.sql import functions as F

from duetframe.llm import fingerprints
from duetframe.llm.fingerprints import K, S, likeness, op5_document_fingerprints, syncmers, with_next


def expected_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1])]


def test_next_row(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([rng.randrange(40), rng.randrange(10**12), None]), f"t{i}" if i % 9 else None) for i in range(300)]
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)
    for some in (rows, rows[:1], rows[:2], []):
        for size in (7, 1000):
            monkeypatch.setattr(fingerprints, "BUCKET_ROWS", size)
            df = spark.createDataFrame([(i, t, "n") for i, t in some], "doc_id long, text string, next string")
            got = [tuple(r) for r in with_next(df).collect()]
            assert sorted(got, key=key) == sorted(expected_next(some), key=key)


def test_syncmers_are_closed_and_context_free(spark):
    rng = random.Random(2)
    words = [rng.choice("abc def ghij klmnop q rst uvw").strip() + str(rng.randrange(30)) for _ in range(120)]
    text = " ".join(words)
    df = spark.createDataFrame([(0, text), (1, "zz yy " + text), (2, "ab cd"), (3, ""), (4, None)], "i int, text string")
    df = df.select("i", syncmers(F.col("text")).alias("a"), fingerprints.unit_hashes(F.coalesce("text", F.lit(""))).alias("h"))
    got = {r.i: r for r in df.collect()}
    h = got[0].h
    inner = spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(len(h) - 1)], "i int, x long, y long").select("i", F.xxhash64("x", "y").alias("m")).collect()
    m = [r.m for r in sorted(inner)]
    assert S == 2
    want = [i for i in range(len(h) - K + 1) if min(m[i : i + K - S + 1]) in (m[i], m[i + K - S])]
    assert [a.at for a in got[0].a] == want
    shift = {a.hash for a in got[1].a}
    assert {a.hash for a in got[0].a} <= shift and len(shift) <= len(want) + K
    assert len(got[2].a) == 2 and got[3].a == [] and got[4].a == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op5_document_fingerprints(spark, d).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    for i, t, after in expected_next(rows):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
    by = {}
    for i, t in texts.items():
        assert by.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_likeness(spark):
    df = spark.createDataFrame([([1, 2], [1, 2]), ([], []), ([1], []), ([1, 2, 3], [2, 3, 4])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, 0.5]


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    band = fingerprints.LEAST_BAND + max(len(a), len(b)) // fingerprints.BAND
    place = {x: i for i, x in enumerate(b)}
    n = {}
    for i, x in enumerate(a):
        if x in place:
            at = (place[x] - i) // band
            n[at] = n.get(at, 0) + 1
    matched = max((n[at] + n.get(at + 1, 0) for at in n), default=0)
    return matched / (len(a) + len(b) - len(set(a) & set(b)))


def test_likeness_goes_by_place(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        a = rng.sample(range(-400, 400), rng.choice([0, 1, 3, 30, 200]))
        b = list(a)
        for _ in range(rng.choice([0, 1, 3])):
            i, j = sorted((rng.randrange(len(b) + 1), rng.randrange(len(b) + 1)))
            b = rng.choice([b[:i] + b[j:], b[j:] + b[i:j] + b[:i], b[:i] + rng.sample(range(1000, 2000), 9) + b[i:]])
        rows.append((a, b if rng.random() < 0.9 else rng.sample(range(5000), 7)))
    rows = [(a, list(dict.fromkeys(b))) for a, b in rows]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(abs(r.x - brute_likeness(r.a, r.b)) < 1e-12 for r in got) and len({r.x for r in got}) > 20
    half = list(range(100))
    moved = spark.createDataFrame([(half, half[50:] + half[:50]), (half, half[:50] + [1000, 1001] + half[50:])], "a array<long>, b array<long>")
    turned, longer = (r[0] for r in moved.select(likeness(F.col("a"), F.col("b"))).collect())
    assert turned == 0.5 and longer == 100 / 102


def test_an_edit_inside_unspaced_text_moves_few_anchors(spark):
    rng = random.Random(9)
    text = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(3000))
    df = spark.createDataFrame([(0, text), (1, "一" + text), (2, text[:1500] + "丁" + text[1500:])], "i int, text string")
    df = df.select("i", fingerprints.fingerprint(F.col("text")).alias("p"))
    p = {r.i: r.p for r in df.collect()}
    assert len(p[0]) > 1000 and all(len(set(p[0]) ^ set(p[i])) <= 2 * K for i in (1, 2))


def test_ids_of_any_kind(spark):
    rows = [("b", "x"), ("ab", "y"), ("", "z"), (None, "u"), ("b", "w"), (None, None), ("ä", "v")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id string, text string, bucket int, key string")
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()), reverse=True)
    got = {(r.doc_id, r.text): r.next_text for r in with_next(df).collect()}
    assert len(got) == len(rows)
    ids = [i for i, _ in order]
    of_text = {t or "": i for i, t in rows}
    at, seen = ("ä", "v"), []
    for _ in rows:
        seen.append(at[0])
        at = (of_text[got[at]], got[at])
    assert seen == ids and at == ("ä", "v")
