"""Exact removal of repeated strings by bounded interval expansion on a Burrows-Wheeler transform.

Every MIN_LENGTH-byte window of a text is known by its smallest 16-byte piece and by where that piece lies in it (in the
first or the second half). Windows with equal bytes agree in both and in the bytes round the piece that all windows of
the half share (the core), so only documents with a core in common need be compared. Neighbouring windows with one core
are a context; equal contexts are one entry with a count. Contexts with one core meet in one task, which builds the
suffix order and the Burrows-Wheeler transform of a batch of them. Breadth-first backward extension from the empty
string finds the common prefixes of neighbouring suffixes in increasing length and stops at MIN_LENGTH: what is still
without a value then begins a repeated string.

A core with more than MOST_CONTEXTS different contexts (a passage that very many documents go on from in their own way)
is made longer: each window also holds half of what it can more on the left or on the right of the core, so a context
falls into two with longer cores, which meet in smaller groups. After a few steps the core is the whole window and all
windows with one core are equal, so no task gets an unbounded group, and every group goes through the same transform.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, few, lean, read, stored, workspace

MIN_LENGTH = 200
#: Bytes of the piece that names a window.
PIECE = 16
#: Different contexts of a core that are compared in one task.
MOST_CONTEXTS = 1_000
#: Bytes of contexts that go into one transform, about.
BATCH_BYTES = 600_000
#: Bytes of a text that are taken at a time (texts may be longer).
_SEGMENT = 1 << 20
#: Hashes of shared cores that are sent to every worker, at most.
BROADCAST_CORES = 8_000_000
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _tables():
    """A random value for each byte, powers of an odd base and of its inverse modulo 2**64."""
    made, base = [np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64)], 0x9E3779B97F4A7C15
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(_SEGMENT, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made


def windows(data: bytes, length: int = MIN_LENGTH):
    """Contexts of a text: first and last window start, hash of the core, and where the core begins and ends.

    The hash is a polynomial modulo 2**64 over random values of the bytes. It only brings contexts together; whether
    they are equal, and what they have in common, is found from their bytes.
    """
    parts = []
    step = _SEGMENT - length
    for at in range(0, max(1, len(data) - length + 1), step):
        got = _windows_of(np.frombuffer(data, np.uint8)[at : at + step + length - 1], length)
        if got is not None:
            parts.append((got[0] + at, got[1] + at, got[2], got[3] + at, got[4] + at))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _windows_of(x: np.ndarray, length: int):
    if len(x) < length:
        return None
    byte, power, inverse = _tables()
    t = byte[x]
    h = t
    for s in (1, 2, 4, 8):
        h = (h[:-s] * _C[0]) ^ ((h[s:] >> np.uint64(29)) + h[s:] * _C[1])
    h = (h ^ (h >> np.uint64(31))) * _C[2]
    w = length - PIECE + 1  # pieces in a window
    low = np.uint64(0xFFFFFF)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    whole = -(-len(v) // w) * w
    v = np.append(v, np.full(whole - len(v), ~np.uint64(0))).reshape(-1, w)
    before = np.minimum.accumulate(v, 1).ravel()
    after = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - length + 1
    piece = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & low).astype(np.int64)
    half = (w + 1) // 2
    early = piece - np.arange(n) < half
    first = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (early[1:] != early[:-1])])
    last = np.r_[first[1:], n] - 1
    p, e = piece[first], early[first]
    left = np.where(e, p, p - half)
    right = np.where(e, p - half + 1, p - w + 1) + length
    sums = np.r_[np.uint64(0), np.cumsum(t * power[: len(t)])]
    core = (sums[right] - sums[left]) * inverse[left]
    core = (core ^ (core >> np.uint64(32)) ^ np.where(e, _C[1], _C[2])) * _C[0]
    core = (core ^ (core >> np.uint64(29))).view(np.int64)
    return first, last, core, left, right


def _names(digests: list[bytes]) -> np.ndarray:
    """Two numbers for each 128-bit digest of a context (seeded with where its core lies, which tells windows with other
    cores apart)."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least (by doubling)."""
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(h):  # the first h symbols in one number; past the end stands 0
        key <<= bits
        key[: n - i] += text[i:] + 1
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        if h >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        h *= 2


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place whether the suffix has ``length`` symbols in common with the one before it.

    Intervals of suffixes that begin with the same string are extended to the left one symbol at a time, all of one
    length at once. The right end of an interval that is met for the first time is a place where the common prefix is
    as long as the string; places that no interval shorter than ``length`` ends at are the repeats.
    """
    n = len(text)
    order = suffix_order(text, length + 1)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    back = place[order - 1]  # where the suffix that is one symbol longer to the left stands: all that is used of the transform
    first = text[order]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    owner = np.empty(n, np.int32)
    for _ in range(length):
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        to = back[at]
        owner[to] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        to.sort()
        cut = np.flatnonzero((to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (first[to[1:]] != first[to[:-1]]))
        start, end = to[np.r_[0, cut + 1]], to[np.r_[cut, len(to) - 1]] + 1
        new = ~known[end]
        low, high = start[new], end[new]
        if not len(low):
            break
        known[high] = True
    return order, ~known[:n]


def least_core(length: int = MIN_LENGTH) -> int:
    """How many bytes a core has at least (those of early and late pieces differ by one at most; longer ones are longer)."""
    half = (length - PIECE + 2) // 2
    return min(length + 1 - half, PIECE + half)


def repeated_starts(contexts: list[bytes], counts: list[int], length: int = MIN_LENGTH, cores: list[int] | None = None) -> list[np.ndarray]:
    """For each context, which of its windows start a string that occurs twice or more among all the contexts.

    counts: how often each context occurs; the contexts are different. cores: where the core of each context begins.
    All windows of a context hold its core, and equal windows hold it at the same place, so the first bytes of it can be
    one symbol of the text, the same for equal bytes only: suffixes and steps are shorter by the rest.
    """
    symbols = None
    if cores is not None:
        fold = least_core(length)
        names: dict[bytes, int] = {}
        symbols = [names.setdefault(c[a : a + fold], len(names)) for c, a in zip(contexts, cores)]
        contexts = [c[: a + 1] + c[a + fold :] for c, a in zip(contexts, cores)]
        length -= fold - 1
    size = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64)
    ends = np.cumsum(size + 1) - 1
    text[ends] = 256 + np.arange(len(ends))  # separators are all different, so no match goes across one
    if symbols is not None:
        text[ends - size + np.array(cores)] = 256 + len(ends) + np.array(symbols)
    order, same = common_prefixes(text, length)
    repeated = np.zeros(len(text), bool)
    repeated[order[same]] = True
    repeated[order[:-1][same[1:]]] = True
    begin = np.r_[0, ends[:-1] + 1]
    return [np.ones(s - length + 1, bool) if c > 1 else repeated[b : b + s - length + 1] for b, s, c in zip(begin, size, counts)]


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH, most_contexts: int = MOST_CONTEXTS, broadcast_cores: int = BROADCAST_CORES) -> DataFrame:
    """doc_id, key (hash of the text) and spans (start and end of each maximal run of repeated bytes, as int64 pairs).

    A byte is repeated if a string of ``length`` bytes that covers it starts at another place of any document too.
    Documents without repeats have no row; rows with the same id and text have one row in common.
    """
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    with workspace(rows.sparkSession) as keep:
        return keep(_repeated_spans(rows, kind, length, most_contexts, broadcast_cores))


def _repeated_spans(rows: DataFrame, kind: str, length: int, most_contexts: int, broadcast_cores: int) -> DataFrame:
    def cores(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                got = [windows(t.as_py().encode("utf-8", "surrogatepass"), length)[2] for t in part.column(2)]
                core, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(n.astype(np.int64))], ["core", "n"])

    shared = rows.mapInArrow(lean(cores), "core bigint, n bigint").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")
    shared = stored(shared)
    if shared.count() <= broadcast_cores:
        sent = rows.sparkSession.sparkContext.broadcast(_collected(shared))
        asked, named = rows, ()
    else:
        sent, named = None, ("cores",)
        asked = _with_cores(rows, cores_of=shared, length=length, kind=kind)

    def contexts(batches):
        from xxhash import xxh3_128_digest

        seen: set[bytes] = set()
        for b in batches:
            for part in (b.slice(i, 250) for i in range(0, b.num_rows, 250)):
                row, cols, names, held = [], [], [], []
                for i, t in enumerate(part.column(2)):
                    data = t.as_py().encode("utf-8", "surrogatepass")
                    wanted = sent.value if sent is not None else np.sort(np.array(part.column(3)[i].as_py() or [], np.int64))
                    if len(data) < length or not len(wanted):
                        continue
                    first, last, core, left, right = windows(data, length)
                    k = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, core), len(wanted) - 1)] == core)
                    row.append(np.full(len(k), i))
                    cols.append(np.stack([core[k], first[k], left[k] - first[k], right[k] - first[k]]))
                    lo, hi = cols[-1][2:]
                    for s, e, seed in zip(first[k].tolist(), (last[k] + length).tolist(), (lo << 20 | hi).tolist()):
                        context = data[s:e]
                        name = xxh3_128_digest(context, seed)
                        names.append(name)
                        if name in seen:
                            held.append(None)
                        else:
                            held.append(context)
                            seen.add(name)
                if len(seen) > 500_000:
                    seen.clear()
                if row:
                    at = pa.array(np.concatenate(row))
                    core, start, lo, hi = np.concatenate(cols, 1)
                    both = _names(names)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *map(pa.array, (core, both[:, 0], both[:, 1], start)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(held, pa.binary())], ["doc_id", "key", *_NAME, "start", "lo", "hi", "context"])

    found = stored(asked.select("doc_id", "key", "text", *named).mapInArrow(lean(contexts), f"doc_id {kind}, key bigint, core bigint, one bigint, two bigint, start bigint, lo int, hi int, context binary"))
    if sent is not None:
        sent.destroy()
    entries = stored(found.groupBy(*_NAME).agg(F.count("*").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("context").alias("context")))
    met = few(stored(_met(entries, length, most_contexts)))
    at = found.select("doc_id", "key", *_NAME, "start").join(met, list(_NAME))
    at = at.select("doc_id", "key", (F.col("start") + F.col("first")).alias("s"), (F.col("start") + F.col("last") + length).alias("e"))
    lists = at.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("at"))

    def merge(batches):
        for b in batches:
            out = []
            for x in b.column(2):
                pairs = np.array([(p["s"], p["e"]) for p in x.as_py()], np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
                out.append(np.column_stack([pairs[new, 0], reach[np.r_[new[1:], len(pairs)] - 1]]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "key", "spans"])

    return lists.mapInArrow(lean(merge), f"doc_id {kind}, key bigint, spans binary")


_NAME = ("core", "one", "two")
_MET = "core bigint, one bigint, two bigint, first int, last int"


def _met(entries: DataFrame, length: int, most_contexts: int) -> DataFrame:
    """core, one, two, first, last: runs of windows of each context that begin repeated strings."""
    groups = entries.groupBy("core").agg(F.count("*").alias("contexts"))
    hot = few(stored(groups.where(F.col("contexts") > most_contexts).select("core")))
    crowded = not hot.isEmpty()
    usual = entries.join(hot, "core", "left_anti") if crowded else entries
    met = usual.repartition("core").sortWithinPartitions(*_NAME).mapInArrow(lean(_compare(length)), _MET)
    if not crowded:
        return met
    cut = stored(_longer_cores(entries.join(hot, "core", "left_semi"), length))
    parts = stored(cut.groupBy(*_NAME).agg(F.sum("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("context").alias("context")))
    inner = few(stored(_met(parts, length, most_contexts)))
    back = cut.join(inner, list(_NAME)).select(*(F.col(f"of_{c}").alias(c) for c in _NAME), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
    return met.unionByName(back)


def _longer_cores(entries: DataFrame, length: int) -> DataFrame:
    """Each context as one or two with longer cores: of_core, of_one, of_two, shift (where it begins in the former) and the columns of an entry.

    A window may have ``spare`` bytes beside the core. Those with the greater part of them on the left share that part,
    the others share one on the right; equal windows stand alike round the core, so they stay together.
    """

    def cut(batches):
        import xxhash

        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                row, made, names = [], [], []
                for i, (lo, hi, context) in enumerate(zip(*(part.column(c).to_pylist() for c in ("lo", "hi", "context")))):
                    last, spare = len(context) - length, length - (hi - lo)
                    more = -(-spare // 2)
                    for side, start, end, a, z in ((0, 0, min(lo - more, last), lo - more, hi), (1, max(0, lo - more + 1), last, lo, hi + spare - more + 1)):
                        if start > end or (side and not spare):
                            continue
                        text, a, z = context[start : end + length], a - start, z - start
                        core = xxhash.xxh3_64_intdigest(text[a:z], side) - (1 << 63)
                        row.append(i)
                        names.append(xxhash.xxh3_128_digest(text, a << 20 | z))
                        made.append((start, core, a, z, text))
                at, cols = pa.array(row, pa.int64()), list(zip(*made)) or [()] * 5
                cols[2:2] = _names(names).T
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in (*_NAME, "n")), *(pa.array(x, k) for x, k in zip(cols, kinds))], [*(f"of_{c}" for c in _NAME), "n", "shift", *_NAME, "lo", "hi", "context"])

    shape = "of_core bigint, of_one bigint, of_two bigint, n bigint, shift int, core bigint, one bigint, two bigint, lo int, hi int, context binary"
    return entries.select(*_NAME, "n", "lo", "hi", "context").mapInArrow(lean(cut), shape)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _collected(shared: DataFrame) -> np.ndarray:
    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary())], ["h"])

    parts = [np.frombuffer(r.h, np.int64) for r in shared.mapInArrow(lean(packed), "h binary").collect()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def _with_cores(rows: DataFrame, cores_of: DataFrame, length: int, kind: str) -> DataFrame:
    """The rows that have shared cores, each with those: where there are too many of them for every worker."""

    def each(batches):
        for b in batches:
            for part in (b.slice(i, 250) for i in range(0, b.num_rows, 250)):
                got = [np.unique(windows(t.as_py().encode("utf-8", "surrogatepass"), length)[2]) for t in part.column(2)]
                at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(got))], ["doc_id", "key", "core"])

    own = rows.mapInArrow(lean(each), f"doc_id {kind}, key bigint, core bigint").distinct().join(cores_of, "core")
    lists = own.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list("core").alias("cores"))
    return rows.join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).select("doc_id", "key", "text", "cores")


def _compare(length: int):
    """Goes through contexts in order of their core and compares those of a core; several cores share a transform."""

    def compare(batches):
        core, group, waiting, size = None, [], [], 0

        def done(g):
            """What needs no comparison is told at once, the rest waits for the next transform."""
            nonlocal size
            if len(g) > 1 and any(n == 1 for _, n, _, _ in g):
                waiting.extend(g)
                size += sum(len(c) for _, _, _, c in g)
                return []
            return [(name, 0, len(c) - length) for name, n, _, c in g if n > 1]

        def settle():
            nonlocal size
            out = []
            if waiting:
                _, counts, cores, contexts = zip(*waiting)
                for (name, *_), mask in zip(waiting, repeated_starts(list(contexts), list(counts), length, list(cores))):
                    out += [(name, int(s), int(e)) for s, e in zip(*_spans(mask))]
            waiting.clear()
            size = 0
            return out

        def batch(rows):
            names = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*names, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], [*_NAME, "first", "last"])

        out = []
        for b in batches:
            for *name, n, lo, context in zip(*(b.column(x).to_pylist() for x in (*_NAME, "n", "lo", "context"))):
                if name[0] != core:
                    out += done(group)
                    core, group = name[0], []
                    if size > BATCH_BYTES:
                        out += settle()
                group.append((name, n, lo, context))
            if len(out) > 5_000:
                yield batch(out)
                out = []
        out += done(group)
        out += settle()
        yield batch(out)

    return compare


NEW = ("kept", "n_bytes", "n_removed", "n_spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH, spans: DataFrame | None = None, as_text: bool = False, names: tuple[str, ...] = NEW, **how) -> DataFrame:
    """All columns of every row, and kept (the bytes that stay, put together), n_bytes, n_removed and n_spans.

    as_text: kept is a string; of characters that a cut has split nothing stays. names: what the four are called; a
    column of ``docs`` with such a name is left out.

    Texts are UTF-8 bytes; null counts as empty; strings are judged on the input, not on what is left. Rows that repeat
    are copies of each other; rows with the same id and other texts are different documents. Texts of any length are
    taken whole. An empty table gives an empty one.
    """
    spans = repeated_spans(docs, id_col, text_col, length, **how) if spans is None else spans
    total = spans.agg(F.sum(F.length("spans") + 32)).first()[0] or 0
    of_id, of_key, of_spans, body = beside([*docs.columns, *names], "id", "key", "spans", "text")
    side = spans.select(F.col("doc_id").alias(of_id), F.col("key").alias(of_key), F.col("spans").alias(of_spans))
    side = F.broadcast(side) if total <= 48 << 20 else side
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(side, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_key)), "left")
    others = [f for f in docs.schema if f.name.lower() not in {n.lower() for n in names}]
    at = joined.select(*(F.col(f"`{f.name}`") for f in others), text.alias(body), of_spans)

    def cut(batches):
        for b in batches:
            k = b.num_columns
            kept, size, gone, runs = [], [], [], []
            for t, s in zip(b.column(k - 2).to_pylist(), b.column(k - 1).to_pylist()):
                data = t.encode("utf-8", "surrogatepass")
                size.append(len(data))
                pairs = np.frombuffer(s, "<i8").reshape(-1, 2).tolist() if s else []
                edge = [0, *(x for p in pairs for x in p), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2])) if pairs else data)
                gone.append(len(data) - len(kept[-1]))
                runs.append(len(pairs))
            left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: k - 2], left, *(pa.array(x, pa.int64()) for x in (size, gone, runs))], [*b.schema.names[: k - 2], *names])

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return at.mapInArrow(lean(cut), shape + ", ".join(f"`{n}` {k}" for n, k in zip(names, ("string" if as_text else "binary", "bigint", "bigint", "bigint"))))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **how) -> DataFrame:
    """``docs`` with the bytes that remove_repeats keeps as text; of characters that a cut has split nothing stays.

    chars_col, if there is such a column, is set to the new length. No row goes, even if its text is empty now. Nulls
    stay null; other columns stay as they are, whatever they are called.
    """
    names = beside(docs.columns, *NEW)
    text = remove_repeats(docs, id_col, text_col, as_text=True, names=tuple(names), **how)
    kept = F.col(names[0])
    new = {text_col: F.when(F.col(text_col).isNotNull(), kept)}
    if chars_col in docs.columns:
        new[chars_col] = F.coalesce(F.length(kept).cast(docs.schema[chars_col].dataType), F.col(chars_col))
    return text.withColumns(new).select(*docs.columns)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeats(docs)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_array_dedup": op8_suffix_array_dedup}
ORACLES: dict[str, str] = {}
