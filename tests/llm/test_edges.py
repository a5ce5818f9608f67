"""Every operator and stage over one odd table: columns called like its own helpers, nulls, empty and repeated rows, a long text."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duetframe.llm import bpe, fingerprints, html_extraction, jaccard, license_scan, packing, periodic_runs, quality, suffix_dedup, toxicity, url_filters, vector_codes, vector_links
from duetframe.llm.common import beside

LONG = "lorem ipsum dolor sit amet " * 4_000
ROWS = [(1, "one two three four five six seven", "en"), (1, "one two three four five six seven", "en"), (2, None, None), (3, "", "en"), (None, "null id", "xx"), (4, LONG, "en"), (5, LONG + "x", "en"), (1, "same id, other text", "en")]
#: Names that the operators give to columns of their own, in results or on the way.
NAMES = "score kept n_bytes n_removed n_spans __text __id __key __spans key node group component_id n_links lang_ page rule host verdict sequence_id offset piece settled ids word row places rare h numbers bucket own next print base_failed nll code n_grams id label"


def odd(spark):
    df = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.lit("clash") for n in NAMES.split()})


def model(docs):
    return toxicity.fit_toxicity(docs, docs.select("doc_id", F.lit(1).alias("toxic")))


def vectors(docs):
    """A vector column of the numbers of characters ; none is null."""
    return docs.withColumn("n_chars", F.array(F.col("n_chars") * 1.0, F.lit(1.0)))


OPERATORS = {
    "url_filters": lambda d: url_filters.judge_urls(d.withColumn("url", F.col("text")), url_filters.RULES, "doc_id"),
    "jaccard_groups": lambda d: jaccard.jaccard_groups(d),
    "scan_licenses": lambda d: license_scan.scan_licenses(d),
    "scan_notices": lambda d: license_scan.scan_notices(d),
    "extract_text": lambda d: html_extraction.extract_text(d.withColumn("url", F.col("source")), "doc_id", "url", "text"),
    "with_next": lambda d: fingerprints.with_next(d, more={"print": fingerprints.fingerprint(F.col("text"))}),
    "score_quality": lambda d: quality.judge_quality(quality.score_quality(d)),
    "encode_documents": lambda d: bpe.encode_documents(d, decoded=True),
    "remove_repeats": lambda d: suffix_dedup.remove_repeats(d),
    "score_toxicity": lambda d: toxicity.score_toxicity(d, model(d)),
    "encode_vectors": lambda d: vector_codes.with_group_error(vector_codes.encode_vectors(vectors(d), vector_codes.fit_codebooks(vectors(d), "doc_id", "n_chars", parts=1), "doc_id", "n_chars", keep=("label",))),
    "find_runs": lambda d: periodic_runs.find_runs(d),
    "vector_links": lambda d: vector_links.vector_links(vectors(d), "doc_id", "n_chars"),
    "pack_documents": lambda d: packing.pack_documents(d),
}
#: Results with a row for each match or piece.
OTHER_ROWS = {"scan_licenses": 0, "scan_notices": 0}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    d = odd(spark)
    got = OPERATORS[name](d).collect()
    if name == "pack_documents":
        whole = {}
        for r in got:
            whole[r.sequence_id] = whole.get(r.sequence_id, 0) + r.length
        assert sum(r.piece == 0 for r in got) == len(ROWS) and max(whole.values()) <= packing.CAPACITY
    else:
        assert len(got) == OTHER_ROWS.get(name, len(ROWS))
    assert OPERATORS[name](d.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, stage):
    d = odd(spark)
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, d, "/root/testdata/sf0.001")
    if stage != "best_fit_packing":
        assert got.columns == d.columns
        assert all(r.score == r.kept == r.n_bytes == r["__id"] == "clash" for r in got.collect())
        # of seven different rows the copies go with near_duplicates; the repeated long texts and the short ones fail the rules
        assert got.count() == {"quality_rules": 0, "near_duplicates": 6}.get(stage, len(ROWS))
    else:
        assert got.where("piece = 0").count() == len(ROWS)
    assert run(spark, d.limit(0), "/root/testdata/sf0.001").collect() == []


def test_names_beside():
    assert beside(["a", "__x", "___ID"], "id") == ["____id"]
    assert beside([], "id") == ["__id"]
