import zlib

import numpy as np

from duetframe.llm.toxicity import fit_toxicity, op9_toxicity, score_toxicity, train


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, d).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    pairs = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    tp = sum(p and y for p, y in pairs)
    assert tp / sum(y for _, y in pairs) > 0.8 and tp / sum(p for p, _ in pairs) > 0.8


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} good text" + (" vile" if i % 3 == 0 else "")) for i in range(300)], "doc_id long, text string")
    marks = [(i, int(i % 3 == 0)) for i in range(300)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks]
    a, b = (fit_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (marks, turned))
    assert a == b and a[0]
    scored = {r.doc_id: r.score for r in score_toxicity(docs, a).collect()}
    assert all((scored[i] >= 0.5) == (i % 3 == 0) for i in range(300))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "vile", "c"), (4, "x " * 20000, "d"), (4, "y", "e"), (4, "y", "e")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(2, None), (None, 1), (4, 1)], "doc_id long, toxic int")):
        got = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(docs.limit(0), fit_toxicity(docs.limit(0), none)).collect() == []


def test_training_is_repeatable():
    rng = np.random.default_rng(0)
    p = [np.array([1, 2, *rng.integers(10, 99, 3)], np.uint64) for _ in range(40)]
    u = [rng.integers(10, 99, 4).astype(np.uint64) for _ in range(200)] + p[:20]
    a, b = train(p, u, 0.1), train(p, u, 0.1)
    assert a == b and a[0][1] + a[0][2] + a[1] > 0 > a[1]
