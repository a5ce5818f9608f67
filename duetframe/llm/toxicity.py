"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over words and word beginnings is trained in numpy from confirmed toxic rows (P) and from text whose
label is not looked at (U). With the class prior c the risk is c R_P(+) + max(0, R_U(-) - c R_P(-)): the second part
estimates what negatives would cost and is kept from going below zero, where a flexible model would start to learn U by
heart. Both samples are bounded (MOST_POSITIVE, MOST_UNLABELLED); scores are made for every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, lean, read, stored, workspace

#: Rows that the model is fitted on, at most. Which ones is a matter of a hash of the id.
MOST_POSITIVE = 3_000
MOST_UNLABELLED = 6_000
#: Of every FOLDS rows one is held out.
FOLDS = 5
#: Beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6)
#: How far a feature's share of the positive documents must be from its share of the unlabelled ones to enter the model,
#: as a G-test statistic (20: one in 10^5 by chance).
LEAST_G = 20.0
WORDS_HELD = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


def fold_of(id_col):
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _features(word: str) -> tuple[int, ...]:
    import xxhash

    made = [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(x) for x in made)


class _Known(dict):
    """Features of each word, kept until there are too many words."""

    def __missing__(self, word):
        self[word] = got = _features(word)
        return got


def _sample_features(batches):
    known = _Known()
    for b in batches:
        out = []
        for text in b.column(2).to_pylist():
            words = set(_LETTERS.findall((text or "").lower()))
            out.append(sorted(set().union(*map(known.__getitem__, words))))
            if len(known) > WORDS_HELD:
                known.clear()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "positive", "features"])


def _g(a, n: int, df, total: int):
    """G statistic of "in a positive document" against "has the feature": a of n positive ones have it, df of all."""
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)
    share = n / total
    cells = ((a, df * share), (df - a, df * (1 - share)), (n - a, (total - df) * share), (total - n - df + a, (total - df) * (1 - share)))
    return 2 * sum((part(seen, expected) for seen, expected in cells), F.lit(0.0))


def _telling(sample: DataFrame) -> list[int]:
    """The features whose share of positive documents is far enough (LEAST_G) from that of the others."""
    n, total = sample.agg(F.count_if("positive"), F.count("*")).first()
    if not n:
        return []
    each = sample.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if("positive").alias("a"), F.count("*").alias("df"))
    return sorted(r.feature for r in each.where(_g(F.col("a"), n, F.col("df"), total) >= LEAST_G).select("feature").collect())


def _cut(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The logit at which to call a row toxic: where the same risk, with errors counted instead of losses, is least.

    Of equally good cuts the one in the widest gap between scores is taken.
    """
    z = np.unique(np.r_[p, u])
    at, gap = (z[1:] + z[:-1]) / 2, np.diff(z)
    if not len(at):
        return 0.0
    caught = 1 - np.searchsorted(np.sort(p), at) / len(p)
    called = 1 - np.searchsorted(np.sort(u), at) / len(u)
    risk = prior * (1 - caught) + np.maximum(0, called - prior * caught)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(at[best[np.argmax(gap[best])]])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 60, batch: int = 1024, rate: float = 0.05, shrink: float = 1e-3, seed: int = 7) -> tuple[dict[int, float], float]:
    """Weights by feature and the bias. Each array holds the distinct (telling) features of one document."""
    if not positive or not unlabelled:
        return {}, float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    docs = positive + unlabelled
    size = np.array([len(d) for d in docs])
    seen, column = np.unique(np.concatenate(docs), return_inverse=True)
    doc = np.repeat(np.arange(len(docs)), size)
    start = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(docs)))]
    n, np_ = len(seen), len(positive)
    w, m, v = (np.zeros(n + 1) for _ in range(3))  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    rng, step = np.random.default_rng(seed), 0
    p_share = min(batch // 2, np_)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        order = np_ + rng.permutation(len(unlabelled))
        for cut in range(0, len(order), batch):
            u = order[cut : cut + batch]
            p = rng.choice(np_, p_share, replace=False)
            rows = np.concatenate([p, u])
            length = start[rows + 1] - start[rows]
            row = np.repeat(np.arange(len(rows)), length)
            cols = column[np.arange(length.sum()) + np.repeat(start[rows] - (np.cumsum(length) - length), length)]
            z = np.bincount(row, weights=w[cols], minlength=len(rows)) + w[-1]
            s, loss_neg = sigmoid(z), np.logaddexp(0, z)
            is_p = np.arange(len(rows)) < len(p)
            negative_risk = loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()
            g = np.where(is_p, prior * (s - 1) / len(p), 0.0)
            inner = np.where(is_p, -prior * s / len(p), s / len(u))
            g = g + inner if negative_risk >= 0 else -inner  # below zero: go back up instead
            grad = np.append(np.bincount(cols, weights=g[row], minlength=n), g.sum())
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            now = rate * (1 - epoch / epochs)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - now * shrink)
    z = np.bincount(doc, weights=w[column], minlength=len(docs)) + w[-1]
    w[-1] -= _cut(z[:np_], z[np_:], prior)
    kept = np.flatnonzero(w[:-1])
    return dict(zip(seen[kept].tolist(), w[kept].tolist())), float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[int, float], float]:
    """Fit on rows outside the held-out fold. The prior is the share of toxic rows among the labelled ones there."""
    spark = docs.sparkSession
    marks = labels.where(fold_of(id_col) != 0).select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where("id is not null and toxic is not null")
    n, toxic = marks.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(0.9, max(1e-3, (toxic or 0) / n)) if n else 0.05

    def ids(of: DataFrame, most: int, kind: bool) -> list:
        got = of.select("id").distinct().orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most).collect()
        return sorted((r.id, kind) for r in got)

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = ids(marks.where("toxic = 1"), MOST_POSITIVE, True) + ids(texts.where((fold_of("id") != 0) & F.col("id").isNotNull()).select("id"), MOST_UNLABELLED, False)
    if not chosen:
        return {}, float(np.log(prior / (1 - prior)))
    wanted = F.broadcast(spark.createDataFrame(chosen, f"id {kind}, positive boolean"))  # bounded by the two constants
    with workspace(spark):
        found = texts.join(wanted, "id").select("id", "positive", "text").mapInArrow(lean(_sample_features), f"id {kind}, positive boolean, features array<bigint>")
        sample = stored(found.groupBy("id", "positive").agg(F.min("features").alias("features")))  # of rows with one id one counts
        telling = _telling(sample)
        told = F.array_intersect("features", F.split(F.lit(",".join(map(str, telling))), ",").cast("array<bigint>"))
        rows = sorted((r.positive, r.features) for r in sample.select("positive", told.alias("features")).collect()) if telling else []
    features = {k: [np.array(x, np.int64) for p, x in rows if p is k] for k in (True, False)}
    return train(features[True], features[False], prior)


def score_toxicity(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """id_col, the columns named in ``keep``, and the score of every whole text as ``score_col``.

    Null and empty texts get the bias' score. Rows that repeat, null ids and equal ids stay rows; an empty table gives
    an empty one; columns that aren't named are left out.
    """
    weights, bias = model
    cols = [id_col, *keep]

    class Weighted(dict):
        def __missing__(self, word):
            self[word] = got = tuple(f for f in _features(word) if f in weights)
            return got

    def score(batches):
        known = Weighted()
        for b in batches:
            out = []
            for text in b.column(b.num_columns - 1).to_pylist():
                found = set().union(*map(known.__getitem__, set(_LETTERS.findall((text or "").lower()))))
                out.append(bias + sum(weights[f] for f in sorted(found)))
                if len(known) > WORDS_HELD:
                    known.clear()
            p = 1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], [*cols, score_col])

    schema = docs.select(*cols).schema
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.select(*cols, F.col(text_col).alias(beside(cols, "text")[0])).mapInArrow(lean(score), f"{shape}, `{score_col}` double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
