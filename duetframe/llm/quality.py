"""Quality rules with n-gram perplexity.

Spark counts the character n-grams of every whole text. From the counts a modified Kneser-Ney model (three discounts
for each order, continuation counts below the highest) is estimated by joins on n-gram codes. Its probabilities go to
the workers as arrays sorted by code: the whole model if it is within BROADCAST_BYTES, else its most frequent n-grams up
to that size, and the n-grams that workers don't find there are joined with the model by a shuffle. Either way an n-gram
has the same probability, that of a shorter one with its contexts' weights where the model lacks it. Two perplexities
come of it, one per symbol and one per word, and each language has a lower and an upper limit for either, from its
median and quartiles over the distinct texts that pass the base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, few, lean, read, shuffle_partitions, stored, workspace

ORDER = 5
#: Bits of a symbol in an n-gram's code. Characters below DIRECT are a symbol each; any other is spelled by a pair of
#: symbols, a first and a second one of PAIRED each, so that different texts have different symbols.
BITS, DIRECT, PAIRED = 12, 0x700, 1152
#: Limits of a language, in standard deviations (as its quartiles suggest) from its median.
ABOVE, BELOW = 3.5, 6.0
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Largest model that is sent to every worker, in bytes of its arrays.
BROADCAST_BYTES = 48 << 20
#: Characters that a task takes at a time.
_CHUNK = 1_000_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


def symbols(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    rare = a >= DIRECT
    if not rare.any():
        return a
    at = np.cumsum(rare) + np.arange(len(a))
    first, second = np.divmod(a[rare] - DIRECT, PAIRED)
    out = np.empty(len(a) + len(first), np.int64)
    out[at[~rare]] = a[~rare]
    out[at[rare] - 1], out[at[rare]] = DIRECT + first, DIRECT + PAIRED + second
    return out


def ngram_codes(text: str) -> np.ndarray:
    """One code for each symbol: itself and the ORDER - 1 before it (line ends before the start)."""
    a = np.r_[np.full(ORDER - 1, ord("\n")), symbols(text)]
    code = np.zeros(len(a) - ORDER + 1, np.int64)
    for i in range(ORDER):
        code = (code << BITS) | a[i : len(a) - ORDER + 1 + i]
    return code


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """BASE of one text. A word is a run of anything but ASCII white space, words are compared byte by byte."""
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines, again = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            again += line in lines
            lines.add(line)
    repeated = 0
    if len(words) > 2:
        number: dict[bytes, int] = {}
        a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        two = a[:-2] * len(number) + a[1:-1]
        if len(number) > 1 << 20:
            two = np.unique(two, return_inverse=True)[1]
        _, at, n = np.unique(two * len(number) + a[2:], return_inverse=True, return_counts=True)
        twice = n[at] > 1
        if twice.any():
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i : len(words) - 2 + i] |= twice
            repeated = int(covered.sum())
    return len(words), len(text) - spaces, sum(map(text.count, "#*$%&|<>")), again, repeated


def count_ngrams(texts: DataFrame) -> DataFrame:
    """code, n of every n-gram of the one text column; partial counts are made by the tasks that read the texts."""

    def merged(parts, counts):
        code = np.concatenate(parts)
        order = np.argsort(code, kind="stable")
        code, n = code[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return code[first], np.add.reduceat(n, first)

    def count(batches):
        held, held_n, waiting, size = [], [], [], 0

        def settle():
            code = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            held.append(code[first])
            held_n.append(np.diff(np.r_[first, len(code)]))
            waiting.clear()

        for b in batches:
            for text in b.column(0):
                codes = ngram_codes(text.as_py() or "")
                waiting.append(codes)
                size += len(codes)
                if size > _CHUNK:
                    settle()
                    size = 0
                    if len(held) > 6:
                        code, n = merged(held, held_n)
                        held, held_n = [code], [n]
                        if len(code) > _CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                            held, held_n = [], []
        if size:
            settle()
        if held:
            code, n = merged(held, held_n)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return texts.mapInArrow(lean(count), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of n-grams that were counted once to four times."""
    got = counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first()
    n = [float(x or 0) for x in got]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Natural logarithms of the probabilities: size, code, n, lp of each n-gram of size 1 to ORDER, and lb of each context.

    A row with lb (the weight that the context ``code`` gives to the next shorter one) has no lp. n is how often an
    n-gram of size ORDER was counted.
    """
    tables = {ORDER: stored(counts)}
    for size in range(ORDER - 1, 0, -1):
        tables[size] = tables[size + 1].groupBy(F.col("code").bitwiseAND(F.lit(_mask(size))).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        if size == ORDER - 1:
            tables[size] = stored(tables[size])
    out, lower = [], None
    for size in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[size])
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        t = tables[size].select("code", F.shiftright("code", BITS).alias("context"), "n", taken.alias("taken"))
        sums = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("off"))
        p = (F.col("n") - F.col("taken")) / F.col("total")
        t = t.join(sums, "context")
        if lower is None:
            t = t.select("code", "n", (p + F.col("off") / F.col("total") / F.lit(float(1 << BITS))).alias("p"))
        else:
            low = lower.select(F.col("code").alias("end"), F.col("p").alias("low"))
            t = t.withColumn("end", F.col("code").bitwiseAND(F.lit(_mask(size - 1)))).join(low, "end").select("code", "n", (p + F.col("off") / F.col("total") * F.col("low")).alias("p"))
        lower = stored(t)
        none = F.lit(None).cast("float")
        out.append(lower.select(F.lit(size).alias("size"), "code", (F.col("n") if size == ORDER else F.lit(None).cast("bigint")).alias("n"), F.ln("p").cast("float").alias("lp"), none.alias("lb")))
        out.append(sums.select(F.lit(size - 1).alias("size"), F.col("context").alias("code"), F.lit(None).cast("bigint").alias("n"), none.alias("lp"), F.ln(F.col("off") / F.col("total")).cast("float").alias("lb")))
    model = out[0]
    for more in out[1:]:
        model = model.unionByName(more)
    return stored(model)


class SortedModel:
    """For each size the sorted codes and their values; rows come in order of the codes."""

    def __init__(self, rows):
        self.lp, self.lb = {}, {}
        for size in range(ORDER + 1):
            for into, which in ((self.lp, "lp"), (self.lb, "lb")):
                got = [r for r in rows if r["size"] == size and r["kind"] == which]
                into[size] = np.frombuffer(b"".join(r["code"] for r in got), "<i8"), np.frombuffer(b"".join(r["value"] for r in got), "<f4")

    @staticmethod
    def find(table, codes, default):
        known, value = table
        if not len(known):
            return np.full(len(codes), default), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[at] == codes
        return np.where(hit, value[at].astype(float), default), hit

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Of distinct sorted codes; an n-gram that wasn't counted gets its context's weight and the shorter n-gram."""
        lp, hit = self.find(self.lp[ORDER], codes, 0.0)
        left, weight, size = np.flatnonzero(~hit), np.zeros(len(codes)), ORDER
        while len(left):
            weight[left] += self.find(self.lb[size - 1], codes[left] >> BITS & _mask(size - 1), 0.0)[0]
            size -= 1
            if not size:
                lp[left] = weight[left] - BITS * np.log(2)
                break
            now, hit = self.find(self.lp[size], codes[left] & _mask(size), 0.0)
            lp[left[hit]] = weight[left[hit]] + now[hit]
            left = left[~hit]
        return lp


def _sorted_model(model: DataFrame) -> SortedModel:
    def packed(batches):
        for b in batches:
            size, code = b.column(0).to_numpy(), b.column(1).to_numpy()
            for kind, col in (("lp", 2), ("lb", 3)):
                value = b.column(col)
                there = value.is_valid().to_numpy(zero_copy_only=False)
                value = value.fill_null(0).to_numpy().astype("<f4")
                for s in np.unique(size[there]):
                    k = there & (size == s)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind]), pa.array([code[k].tobytes()], pa.binary()), pa.array([value[k].tobytes()], pa.binary())], ["size", "kind", "code", "value"])

    parts = max(1, min(64, shuffle_partitions(model.sparkSession)))
    rows = model.select("size", "code", "lp", "lb").repartitionByRange(parts, "size", "code").sortWithinPartitions("size", "code")
    return SortedModel(rows.mapInArrow(lean(packed), "size int, kind string, code binary, value binary").collect())


def _frequent(model: DataFrame, most: int) -> DataFrame:
    """The n-grams of size ORDER that were counted most often, ``most`` of them at most."""
    level = F.floor(F.log2("n") * 8).cast("int")  # an eighth of a doubling each: few, whatever the counts
    whole = model.where(f"size = {ORDER} and lp is not null")
    sizes = sorted(whole.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True)
    held, least = 0, None
    for r in sizes:
        held += r.n
        if held > most:
            break
        least = r.level
    return whole.where(F.lit(False) if least is None else level >= least)


_SCORED = ", ".join(f"{c} bigint" for c in BASE) + ", n_grams bigint, nll double"


def score_quality(docs: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang (null: empty), key (hash of the text), BASE, n_grams, nll.

    nll is minus the logarithm of the text's probability, n_grams the number of its symbols; the model is counted on
    ``docs`` if none is given. Null and empty texts have zeros throughout. Long texts are scored whole; rows that repeat
    and null ids stay rows; an empty table gives an empty one; other columns are left out. The result is a stored table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "lang", F.xxhash64("text").alias("key"), "text")
    with workspace(spark) as keep:
        model = kneser_ney(count_ngrams(rows.select("text"))) if model is None else model
        whole = model.count() * 12 <= broadcast_bytes
        sent = spark.sparkContext.broadcast(_sorted_model(model if whole else _frequent(model, broadcast_bytes // 12)))

        def base_and_score(batches):
            for b in batches:
                at = 0
                while at < b.num_rows:
                    texts, size, end = [], 0, at
                    while end < b.num_rows and size < _CHUNK:
                        texts.append(b.column(3)[end].as_py())
                        size += len(texts[-1])
                        end += 1
                    base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(BASE))
                    grams = [ngram_codes(t) for t in texts]
                    n = np.array([len(g) for g in grams])
                    codes = np.concatenate(grams)
                    order = np.argsort(codes)
                    codes = codes[order]
                    first = np.r_[True, codes[1:] != codes[:-1]][: len(codes)]
                    known = sent.value
                    lp = known.log_p(codes[first]) if whole else known.find(known.lp[ORDER], codes[first], 0.0)[0]
                    nll = np.bincount(np.repeat(np.arange(len(texts)), n)[order], weights=-lp[np.cumsum(first) - 1], minlength=len(texts)).astype(float)
                    cols = [*(b.column(i).slice(at, end - at) for i in range(3)), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(n.astype(np.int64)), pa.array(nll)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "key", *BASE, "n_grams", "nll"])
                    at = end

        scored = rows.mapInArrow(lean(base_and_score), f"doc_id {kind}, lang string, key bigint, {_SCORED}")
        scored = keep(scored if whole else _with_rest(scored, rows, model, sent))
        sent.destroy()
    return scored


def _with_rest(scored: DataFrame, rows: DataFrame, model: DataFrame, sent) -> DataFrame:
    """Adds to nll what the n-grams say that aren't among those sent; copies of a text send theirs once for each task."""

    def rest(batches):
        known = sent.value.lp[ORDER]
        for b in batches:
            for i in range(b.num_rows):
                code, n = np.unique(ngram_codes(b.column(1)[i].as_py()), return_counts=True)
                new = ~SortedModel.find(known, code, 0.0)[1]
                if new.any():
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * int(new.sum()), pa.int64())), pa.array(code[new]), pa.array(n[new])], ["key", "code", "n"])

    grams = stored(rows.select("key", "text").mapInArrow(lean(rest), "key bigint, code bigint, n bigint").groupBy("key", "code").agg(F.first("n").alias("n")))
    lp = _log_p(grams.select("code").distinct(), model)
    more = grams.join(lp, "code").groupBy(F.col("key").alias("of")).agg(F.sum(-F.col("n") * F.col("lp")).alias("more"))
    return scored.join(more, F.col("key") == F.col("of"), "left").withColumn("nll", F.col("nll") + F.coalesce("more", F.lit(0.0))).drop("of", "more")


def _log_p(codes: DataFrame, model: DataFrame) -> DataFrame:
    """code and lp of each of the distinct codes, by joins: as SortedModel.log_p."""
    left, found = codes.select("code", F.col("code").alias("end"), F.lit(0.0).alias("weight")), []
    for size in range(ORDER, 0, -1):
        here = model.where((F.col("size") == size) & F.col("lp").isNotNull()).select(F.col("code").alias("end"), "lp")
        met = stored(left.join(here, "end", "left"))
        found.append(met.where("lp is not null").select("code", (F.col("weight") + F.col("lp").cast("double")).alias("lp")))
        missed = met.where("lp is null").drop("lp")
        if missed.isEmpty():
            break
        context = model.where((F.col("size") == size - 1) & F.col("lb").isNotNull()).select(F.col("code").alias("context"), "lb")
        missed = missed.withColumn("context", F.shiftright("end", BITS).bitwiseAND(F.lit(_mask(size - 1)))).join(context, "context", "left")
        left = missed.select("code", F.col("end").bitwiseAND(F.lit(_mask(size - 1))).alias("end"), (F.col("weight") + F.coalesce(F.col("lb").cast("double"), F.lit(0.0))).alias("weight"))
    else:
        found.append(left.select("code", (F.col("weight") - BITS * float(np.log(2))).alias("lp")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def judge_quality(scored: DataFrame, above: float = ABOVE, below: float = BELOW) -> DataFrame:
    """Adds base_failed, char_nll, word_nll and kept to the rows of score_quality.

    base_failed: under LEAST_WORDS words, or over MOST_REPEATED_PERCENT percent of them in repeated 3-word windows.
    kept: not base_failed, and both perplexities (as logarithms) within the language's limits. Copies of a text count
    once in the limits. Where the quartiles are equal the standard deviation stands for the spread; it is 0 only if all
    texts of the language are alike (one text, say), and then nothing is rejected.
    """
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = scored.withColumns({"base_failed": base_failed, "char_nll": F.col("nll") / F.greatest("n_grams", F.lit(1)), "word_nll": F.col("nll") / F.greatest("n_words", F.lit(1))})
    both = ("char_nll", "word_nll")
    texts = scored.where("not base_failed").groupBy("lang", "key").agg(*(F.min(c).alias(c) for c in both))
    limits = texts.groupBy("lang").agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 20_000).alias(f"q_{c}") for c in both), *(F.stddev_pop(c).alias(f"sd_{c}") for c in both))
    fits = F.lit(True)
    for c in both:
        q = F.col(f"q_{c}")
        spread = F.when(q[2] > q[0], (q[2] - q[0]) / 1.349).otherwise(F.col(f"sd_{c}"))
        fits = fits & ((spread <= 0) | F.col(c).between(q[1] - below * spread, q[1] + above * spread))
    return scored.join(few(limits), "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True))).drop(*(f"{a}_{c}" for a in ("q", "sd") for c in both))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that judge_quality keeps, with all their columns, whatever these are called.

    Rows with the same id, language and text are judged alike. An empty table gives an empty one.
    """
    of_id, of_lang, of_key = beside(docs.columns, "id", "lang", "key")
    bad = judge_quality(score_quality(docs, None, id_col, text_col, lang_col)).where("not kept").select(F.col("doc_id").alias(of_id), F.col("lang").alias(of_lang), F.col("key").alias(of_key)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.coalesce(F.col(lang_col).cast("string"), F.lit("")) == F.col(of_lang)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(of_key))
    return docs.join(bad, same, "left_anti")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdicts; see score_quality and judge_quality."""
    judged = judge_quality(score_quality(read(spark, sf_dir, "documents")))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "char_nll", "word_nll")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
