"""A corpus made ready for training: quality, toxicity, near copies, repeated passages, packing.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns what the next one gets as docs, read
from the Parquet that it was written to. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duetframe.llm.common import beside, read, stored
from duetframe.llm.jaccard import keep_one_of_each_group
from duetframe.llm.packing import pack_documents
from duetframe.llm.quality import keep_good
from duetframe.llm.suffix_dedup import without_repeats
from duetframe.llm.toxicity import fit_toxicity, score_toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity bands go."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model is fitted on what is left of the labelled documents."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    (score,) = beside(docs.columns, "score")
    scored = score_toxicity(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"), score_col=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of 5-word shingles the first id stays."""
    return keep_one_of_each_group(docs, 5, 80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand in two places or more are cut out of the texts."""
    return without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the sequences of 2048 tokens that they are packed into."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
