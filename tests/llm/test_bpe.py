import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from duetframe.llm.bpe import decode_documents, encode_documents, op7_bpe_tables
from duetframe.llm.tokens import codec, default_path

ODD = ["", " ", None, "a", "It's 12²½ ok\x1c\x1d x　y", "<|endoftext|> hi  \n\n  z", "日本語 １２ ४५ ⅷ café é \x85\xa0z _a_b's'S 'll", "w " * 4000, "a" * 3000]


def own(text):
    return codec(default_path()).own.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aZ é'slt 1²\n\t_.-<|endoftext|>", max_size=60)))
def test_codec_equals_library(text):
    c = codec(default_path())
    assert c.encode(text) == own(text)
    assert "".join(c.words(text)) == text
    assert [i for w in c.words(text) for i in c.encode(w)] == own(text)
    assert c.decode(own(text)) == text


def test_both_ways_and_edges(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(1, " ", "x", 0), (1, " ", "x", 0), (None, "null id", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, ids int")
    for limit in (1 << 30, 0):
        got = decode_documents(encode_documents(df, broadcast_bytes=limit)).collect()
        assert sorted((repr(r.doc_id), r.ids, r.text) for r in got) == sorted((repr(i), own(t), t or "") for i, t, *_ in rows)
        assert sorted(map(repr, encode_documents(df, broadcast_bytes=limit, decoded=True).collect())) == sorted(map(repr, got))
        assert encode_documents(df.limit(0), broadcast_bytes=limit).collect() == []


def test_rare_words_are_joined(spark):
    """With room for some words only, the others' ids come by the join, wherever they stand in a text."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", f"rare{rng.randrange(400)}", "日本"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    df = spark.createDataFrame([*rows, *rows[:9]], "doc_id long, text string")
    for limit in (60, 2_000):
        got = encode_documents(df, broadcast_bytes=limit).collect()
        assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, own(t)) for i, t in [*rows, *rows[:9]])


def test_query(spark):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op7_bpe_tables(spark, d).collect()
    assert len(got) == len(want)
    for r in got:
        ids = own(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
