"""Stretches of words that repeat with a period: found, described and collapsed to their first period.

A run is a stretch of consecutive words with smallest period q that is at least LEAST_WORDS words and LEAST_TIMES periods
long and that no neighbouring word extends. Runs come from a suffix automaton of the words: its states are gone through
from the longest to the shortest, each state's ordered set of end positions is merged into that of its suffix link,
smaller into larger, and two positions that become neighbours in a state of length l at a distance q <= l end a square of
period q. The state in which two positions first meet is the longest that both end, so l + q words is as far as the
stretch goes to the left; where the words after both differ it ends there, and (start, length, period) is known.

An automaton costs a few microseconds a word, and most words are in no run. Before, four-word grams are hashed and
sorted (numpy, many texts at once): in a run of period q each gram is found again q words before, so a run shows as a
stretch of grams whose last occurrence is that near. This is necessary for a run, not sufficient; what it leaves out
holds none. Only windows around such stretches go through the automaton, and a run lies wholly in one window.

Each text is worked on by itself, so rows are read once and nothing is shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, beside, lean, read

#: A run has so many words and so many times its period at least.
LEAST_WORDS = 6
LEAST_TIMES = 4
#: Words of a gram of the filter: fewer than LEAST_WORDS - 1, so that the shortest run has two grams that are found again.
_GRAM = 4
#: Texts are hashed and sorted together until they have so many words (a longer text comes alone).
_TOGETHER = 200_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _windows(hashes: np.ndarray, begin: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint (first, last) positions that hold every run; hashes of the words of several texts that begin at ``begin``."""
    n = len(hashes)
    end = np.r_[begin[1:], n]
    if n < LEAST_WORDS:
        return []
    with np.errstate(over="ignore"):
        gram = hashes[: n - _GRAM + 1].copy()
        for i in range(1, _GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - _GRAM + 1 + i]
        text = np.repeat(np.arange(len(begin)), end - begin)
        gram += text[: len(gram)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(text[: len(gram)] == text[_GRAM - 1 :])  # grams within one text
    order = at[np.argsort(gram[at], kind="stable")]
    again = gram[order[1:]] == gram[order[:-1]]
    where, back = order[1:][again], (order[1:] - order[:-1])[again]
    by_place = np.argsort(where)
    where, back = where[by_place], back[by_place]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    scale = 0
    while len(where):
        # periods above 2**(scale - 1) and up to 2**scale: so many grams in a row at least
        least = LEAST_WORDS - 1 - (_GRAM - 1) if not scale else (LEAST_TIMES - 1) * (2 ** (scale - 1) + 1) - (_GRAM - 1)
        cuts = np.flatnonzero(np.diff(where) != 1) + 1
        first, last = where[np.r_[0, cuts]], where[np.r_[cuts - 1, len(where) - 1]]
        long = last - first + 1 >= least
        if not long.any():
            break  # the stretches of larger scales lie in these
        near = back <= 2**scale
        if near.any():
            w = where[near]
            cuts = np.flatnonzero(np.diff(w) != 1) + 1
            first, last = w[np.r_[0, cuts]], w[np.r_[cuts - 1, len(w) - 1]]
            long = last - first + 1 >= least
            first, last = first[long], last[long]
            found.append((np.maximum(begin[text[first]], first - 2**scale), last + _GRAM - 1))
        scale += 1
    if not found:
        return []
    first, last = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(first)
    first, last = first[order], np.maximum.accumulate(last[order])
    if not len(first):
        return []
    cuts = np.flatnonzero((first[1:] > last[:-1])) + 1
    return list(zip(first[np.r_[0, cuts]].tolist(), last[np.r_[cuts - 1, len(last) - 1]].tolist()))


def _automaton(w: list[int]) -> tuple[array, array, array]:
    """length, link and own end position (-1 of a clone) of each state of the suffix automaton of the numbers."""
    n = len(w)
    length, link, own = (array("q", bytes(16 * (n + 1))) for _ in range(3))
    # nearly all states have one transition: it stands in two arrays, further ones in a dictionary
    sign, to = array("q", [-1]) * (2 * (n + 1)), array("q", bytes(16 * (n + 1)))
    more: dict[int, dict[int, int]] = {}
    link[0], own[0] = -1, -1
    size, last = 1, 0
    for i, c in enumerate(w):
        new = size
        size += 1
        length[new], own[new] = i + 1, i
        p = last
        q = -1
        while p != -1:
            if sign[p] == c:
                q = to[p]
                break
            if sign[p] == -1:
                sign[p], to[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = new
            p = link[p]
        if q == -1:
            link[new] = 0
        elif length[p] + 1 == length[q]:
            link[new] = q
        else:
            clone = size
            size += 1
            length[clone], link[clone], own[clone] = length[p] + 1, link[q], -1
            sign[clone], to[clone] = sign[q], to[q]
            if q in more:
                more[clone] = dict(more[q])
            while p != -1:
                if sign[p] == c:
                    if to[p] != q:
                        break
                    to[p] = clone
                else:
                    others = more.get(p)
                    if others is None or others.get(c) != q:
                        break
                    others[c] = clone
                p = link[p]
            link[q] = link[new] = clone
        last = new
    return length[:size], link[:size], own[:size]


def runs_of(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers, by start and period."""
    n = len(w)
    if n < LEAST_WORDS:
        return []
    length, link, own = _automaton(w)
    after = [*w, -1]  # no word stands after the last one
    ends: dict[int, list[int]] = {s: [-i] for s, i in enumerate(own) if i >= 0}
    seeds: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.frombuffer(length, np.int64), kind="stable").tolist():
        into = link[state]
        if into <= 0 or (reach := length[into]) < LEAST_WORDS - 1:  # shorter states end no run
            ends.pop(state, None)
            continue
        # positions are negated: a state's own one is its first, so it mostly goes to the end of the list
        small, large = ends.pop(state), ends.get(into)
        if large is None:
            ends[into] = small
            continue
        if len(small) > len(large):
            small, large = large, small
            ends[into] = large
        most = reach // (LEAST_TIMES - 1)
        # two positions are new neighbours if neither set has another between them
        places = [bisect_left(large, x) for x in small]
        for t, (x, k) in enumerate(zip(small, places)):
            if k and x - large[k - 1] <= most and not (t and small[t - 1] > large[k - 1]):
                _seed(seeds, after, into, -large[k - 1], x - large[k - 1])
            if k < len(large) and large[k] - x <= most and not (t + 1 < len(small) and small[t + 1] < large[k]):
                _seed(seeds, after, into, -x, large[k] - x)
        if 8 * len(small) > len(large):
            large += small
            large.sort()  # two sorted stretches: one merge
        else:
            for t, (x, k) in enumerate(zip(small, places)):
                large.insert(k + t, x)
    found = ((end - length[state] - period + 1, length[state] + period, period) for (state, end), period in seeds.items())
    return sorted((r for r in found if r[1] >= LEAST_WORDS), key=lambda r: (r[0], r[2]))


def _seed(seeds: dict, after: list[int], state: int, end: int, period: int) -> None:
    """Notes the square if its stretch ends here. Of neighbours that a later position of the state parts, the nearer count."""
    if after[end + 1] != after[end + 1 - period]:
        if seeds.get((state, end), period) >= period:
            seeds[state, end] = period


def _text_runs(words: list[bytes], windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for first, last in windows:
        number: dict[bytes, int] = {}
        out += [(s + first, n, q) for s, n, q in runs_of([number.setdefault(x, len(number)) for x in words[first : last + 1]])]
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for s, n, q in runs:
        kept[s + q : s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _all_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    size = np.array([len(t) for t in texts])
    filled = np.flatnonzero(size)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(filled):
        return out
    begin = (np.cumsum(size) - size)[filled]
    hashes = np.concatenate([np.fromiter(map(hash, texts[i]), np.int64, size[i]) for i in filled]).view(np.uint64)
    for first, last in _windows(hashes, begin):
        k = int(np.searchsorted(begin, first, "right")) - 1
        i, at = int(filled[k]), int(begin[k])
        out[i] += _text_runs(texts[i], [(first - at, last - at)])
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns named in ``keep``, n_words, runs (start, length, period, by start and period) and collapsed text.

    The collapsed text has the kept words joined by one space: a word goes if a run contains it after the run's first
    period. Null, empty and blank texts have no words, no runs and an empty collapsed text; texts of any length are
    worked on whole. Rows that repeat, null ids and equal ids stay rows; an empty table gives an empty one; columns that
    aren't named are left out, and a named one that is called like a result is an error.
    """
    cols = [id_col, *keep]
    if clash := {c.lower() for c in cols} & {"n_words", "runs", "collapsed"}:
        raise ValueError(f"{sorted(clash)} are names of results")

    def run(batches):
        for b in batches:
            data = b.column(b.num_columns - 1)
            n_words, all_runs, texts = [], [], []
            held: list[list[bytes]] = []

            def settle():
                got = _all_runs(held)
                n_words.extend(map(len, held))
                all_runs.extend(got)
                texts.extend(map(_collapsed, held, got))
                held.clear()

            size = 0
            for x in data:
                words = (x.as_py() or b"").split()
                held.append(words)
                size += len(words)
                if size >= _TOGETHER:
                    settle()
                    size = 0
            settle()
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in all_runs], _KIND)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n_words, pa.int64()), runs, pa.array(texts, pa.binary())], [*cols, "n_words", "runs", "collapsed"])

    text = F.col(text_col).cast("binary").alias(beside(cols, "text")[0])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema)
    found = docs.select(*cols, text).mapInArrow(lean(run), f"{shape}, n_words bigint, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(id_col: Column, text: Column) -> Column:
    """Texts as the contract wants them judged: of ids whose crc32 is a multiple of 10 the words from a drawn place on repeat with a drawn period."""
    h = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def edited(x: Column) -> Column:
        n, g = F.size(x), F.floor(h / 10)
        a = F.pmod(g, n.cast("bigint"))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(moved, " "))

    # the words are bound once: an array of one array, taken apart by a lambda
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(words), edited), F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of find_runs over the whole texts of documents, after its edit. Nulls and empty texts: no run, null numbers of the longest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    longest = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    first = found.withColumn("longest", longest)
    return first.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.b").alias("start"),
        (-F.col("longest.a")).alias("length"),
        F.col("longest.c").alias("period"),
        F.floor(1000 * -F.col("longest.a") / F.col("longest.c")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
