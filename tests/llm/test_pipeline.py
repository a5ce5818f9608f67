import math

import numpy as np

import corpus_pipeline
from duetframe.llm.common import stored
from duetframe.llm.packing import lower_bound
from duetframe.llm.quality import base_counts
from duetframe.llm.tokens import codec, default_path
from tests.llm.test_jaccard import brute as near_copies
from tests.llm.test_suffix_dedup import brute as without_repeats

D = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        at = stored(stage(spark, at, D))
        assert at.columns == docs.columns
        seen[name] = before, {r.doc_id: r.text for r in at.collect()}
    before, after = seen["quality_rules"]
    for i, t in before.items():
        n, _, _, _, repeated = base_counts(t or "")
        assert n >= 50 and 100 * repeated <= 50 * n or i not in after
    assert len(after) > 0.7 * sum(base_counts(t or "")[0] >= 50 for t in before.values())
    before, after = seen["toxicity"]
    assert len(after) > 0.8 * len(before) and all(before[i] == t for i, t in after.items())
    before, after = seen["near_duplicates"]
    groups = near_copies(list(before.items()), 5, 80)
    assert set(after) == {i for i, _, root in groups if i == root}
    before, after = seen["suffix_array_dedup"]
    assert set(after) == set(before)
    for (i, t), (size, gone, _, _) in zip(before.items(), without_repeats(before.values(), 200)):
        left = len(after[i].encode())
        assert size - gone - 6 * math.ceil(gone / 200) <= left <= size - gone
    out = corpus_pipeline.run(spark, D).collect()
    c = codec(default_path())
    tokens = {i: len(c.encode(t or "")) + 1 for i, t in after.items()}
    assert sum(r.length for r in out) == sum(tokens.values()) and {r.doc_id for r in out} == set(tokens)
    assert len({r.sequence_id for r in out}) <= lower_bound(np.array([r.length for r in out])) + 1


def test_edges(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for rows in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)):
        at = rows
        for _, stage in corpus_pipeline.STAGES:
            at = stored(stage(spark, at, D))
        assert at.count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a " * 30000, "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, odd, D).count() == 3
