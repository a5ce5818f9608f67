import re
from collections import Counter
from math import log

import pytest

from duetframe.llm import quality
from duetframe.llm.quality import base_counts, judge_quality, keep_good, op6_quality_rules, score_quality


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_kn(texts):
    """Interpolated modified Kneser-Ney over the same codes, by dictionaries."""
    n, bits = quality.ORDER, quality.BITS
    tables = {n: Counter(c for t in texts for c in quality.ngram_codes(t).tolist())}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(c & quality._mask(k) for c in tables[k + 1])
    lower = None
    for k in range(1, n + 1):
        of = Counter(tables[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
        d = [min(max(j + 1 - (j + 2) * y * of[j + 2] / of[j + 1] if of[j + 1] else (j + 1) / 2, 0.05), j + 0.95) for j in range(3)]
        total, off = Counter(), Counter()
        for c, m in tables[k].items():
            total[c >> bits] += m
            off[c >> bits] += d[min(m, 3) - 1]
        p = {c: (m - d[min(m, 3) - 1]) / total[c >> bits] + off[c >> bits] / total[c >> bits] * (lower[c & quality._mask(k - 1)] if lower else 2.0**-bits) for c, m in tables[k].items()}
        lower = p
    return [-sum(log(lower[c]) for c in quality.ngram_codes(t).tolist()) for t in texts]


TEXTS = ["a b c a b c", "", "x  y\n\nx  y\n \n \nz", "w " * 300 + "| # é 日本   q", "one two three\none two three\r\none two three", "a a a a", "\x1c a\x0bb\x85c d"]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    assert base_counts(text) == brute_base(text)


def test_model_equals_brute_force_both_ways(spark):
    rows = [(i, t or None, "en", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", 1), (None, "q r s", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    want = brute_kn([r[1] or "" for r in rows])
    for limit in (1 << 30, 0):
        got = {(r.doc_id, r.nll and round(r.nll, 2)) for r in score_quality(df, broadcast_bytes=limit).collect()}
        assert got == {(r[0], w and round(w, 2)) for r, w in zip(rows, want)}
    judged = judge_quality(score_quality(df)).collect()
    assert len(judged) == len(rows) and all(r.base_failed and not r.kept for r in judged)
    assert judge_quality(score_quality(df.limit(0))).collect() == []
    assert keep_good(df).collect() == [] and keep_good(df).columns == df.columns


def test_unseen_ngrams_back_off(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat " * 4, "en")], "doc_id long, text string, lang string")
    other = spark.createDataFrame([(2, "the mat zzz", "en"), (3, "the cat sat", "en")], "doc_id long, text string, lang string")
    model = quality.kneser_ney(quality.count_ngrams(df.select("text")))
    got = {r.doc_id: r.nll / r.n_grams for r in score_quality(other, model).collect()}
    assert 0 < got[3] < got[2] < 20


def test_keeps_the_clean(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op6_quality_rules(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert len(got) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(r.kept, labels[i]) for i, r in got.items() if i in labels and not r.base_failed]
    assert sum(k for k, y in judged if y) / sum(y for _, y in judged) > 0.97
    assert sum(not k for k, y in judged if not y) / sum(not y for _, y in judged) > 0.6
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}


def judged_with_copies(spark, values, copies):
    """Kept or not by key, of texts of 100 words and 500 characters; the first is there ``copies`` times more."""
    row = lambda i, k, x: (i, "en", k, 100, 400, 0, 0, 0, 500, 500 * (2 + x))
    rows = [row(i, i, x) for i, x in enumerate(values)] + [row(1000 + i, 0, values[0]) for i in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, nll double")
    got = judge_quality(df).collect()
    assert len(got) == len(rows)
    return {r.key: r.kept for r in got}


@pytest.mark.parametrize("copies", [0, 85, 160, 400])
def test_copies_do_not_move_the_limits(spark, copies):
    from statistics import NormalDist

    clean = [NormalDist().inv_cdf((i + 0.5) / 200) / 20 for i in range(200)]
    clean.insert(0, 0.0)
    got = judged_with_copies(spark, [*clean, 5.0, -1.5], copies)
    assert all(got[k] for k in range(201)) and not got[201] and not got[202]


def test_equal_quartiles_still_reject(spark):
    got = judged_with_copies(spark, [0.0] * 60 + [0.01] * 10 + [-0.01] * 10 + [5.0], 0)
    assert [k for k, kept in got.items() if not kept] == [80]
    assert all(judged_with_copies(spark, [0.3] * 7, 3).values())


def test_symbols_tell_characters_apart():
    odd = [chr(c) for c in [*range(0, 0x900), 0x4E00, 0x4E01, 0x5E00, 0x5E01, 0xD800, 0xDFFF, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]]
    seen = {tuple(quality.symbols(c).tolist()) for c in odd}
    assert len(seen) == len(odd) and all(0 <= x < 1 << quality.BITS for t in seen for x in t)
    assert quality.symbols("a一b").tolist() == [97, *quality.symbols("一").tolist(), 98]
    assert quality.ngram_codes("一丁").tolist() != quality.ngram_codes("帀丁").tolist()


def test_foreign_model_is_the_same_sent_or_joined(spark):
    own = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS + ["the cat sat on the mat " * 9, "日本語の文章です。" * 5])], "doc_id long, text string, lang string")
    other = spark.createDataFrame([(1, "the mat zzz 日本", "en"), (2, "the cat sat", "en"), (3, None, "en"), (4, "ééé" * 40, None), (4, "ééé" * 40, None)], "doc_id long, text string, lang string")
    model = quality.kneser_ney(quality.count_ngrams(own.select("text")))
    size = model.count() * 12
    got = []
    for limit in (1 << 30, size // 3, size // 20, 0):
        got.append(sorted((r.doc_id, r.nll) for r in score_quality(other, model, broadcast_bytes=limit).collect()))
    for other_way in got[1:]:
        assert [i for i, _ in other_way] == [i for i, _ in got[0]]
        assert all(abs(a - b) < 1e-9 * max(1, abs(a)) for (_, a), (_, b) in zip(got[0], other_way))
