"""Best-fit packing with certified repacking.

Every partition packs its pieces best-fit decreasing and certifies the number of bins by lower bounds from
dual-feasible functions. Where the bins are as many as the bound the partition is settled, but for its emptiest bins if
they leave more than ROOM_LEFT; a partition with a gap tries other orders of its pieces, and if the gap stays it settles
its full bins alone. Pieces of the other bins are exchanged: dealt anew to fewer partitions, and packed again. A round that saves no bin leaves the packing as it was. This ends when the total is certified by the bound
of all pieces, or when STALE rounds in a row, each with another deal and other orders, have saved next to nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, stored
from .tokens import codec, default_path

CAPACITY = 2048
END_ID = 0
#: Pieces that a partition packs at once.
PIECES_PER_PARTITION = 40_000
#: The room that the settled bins of a certified partition leave, at most: one part in so many of a sequence. It is all
#: that settling by the bound can cost, for each partition; bins that would leave more are exchanged.
ROOM_LEFT = 16
#: Pieces of a partition in later rounds, in multiples of per_partition: what a task's memory is laid out for.
LARGEST = 8
#: Other orders that a partition with a gap tries in a round.
ORDERS = 6
#: Rounds in a row that save no more than one in WORTH of the bins they were given, after which the packing stays as it is.
STALE, WORTH = 2, 200
_ADDED = ["sequence_id", "offset", "settled", "certified", "part"]
_PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length and the CRC-32 of its ids (unsigned little-endian 32-bit).

    A document is its ids (null text: none) and END_ID. One of more than ``capacity`` ids is cut into pieces of
    ``capacity``, of which the first is shorter if the length is no multiple.
    """
    path = tokenizer or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        enc = codec(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.array([*enc.encode(text.as_py() or ""), END_ID], "<u4")
                n, at, k = len(ids), 0, 0
                while at < n:
                    size = (n - at) % capacity or min(capacity, n - at)
                    row.append(i), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size].tobytes()))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), _PIECES.format(kind=kind))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY, order: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The bin of each length and the number of bins. Ties go by position, so equal input gives equal output.

    order: the positions in another order than that of decreasing lengths.
    """
    bin_of = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0  # bit r: some bin has room r
    for i in (np.argsort(-lengths, kind="stable") if order is None else order).tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, k, bins = capacity, bins, bins + 1
        bin_of[i] = k
        if r > size:
            room[r - size].append(k)
            open_rooms |= 1 << (r - size)
    return bin_of, bins


def best_of_orders(lengths: np.ndarray, bound: int, capacity: int = CAPACITY, seed: int = 0) -> tuple[np.ndarray, int]:
    """best_fit_decreasing and, while its bins are more than the bound, the same over lengths that are mixed a little before they are sorted."""
    bin_of, bins = best_fit_decreasing(lengths, capacity)
    rng = np.random.default_rng(seed)
    for k in range(ORDERS):
        if bins <= bound:
            break
        mixed = np.argsort(-lengths * (1 + 0.3 / (k + 1) * rng.random(len(lengths))), kind="stable")
        other, n = best_fit_decreasing(lengths, capacity, mixed)
        if n < bins:
            bin_of, bins = other, n
    return bin_of, bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions.

    f_t counts pieces over capacity - t as whole bins, drops those under t and keeps the rest; g_k rounds each length
    to its share in k-ths (floor((k + 1) x / capacity) / k where that isn't whole, else x / capacity). For either, the
    lengths that share a bin add up to at most 1.
    """
    return _bound(*np.unique(lengths, return_counts=True), capacity)


def _bound(size: np.ndarray, count: np.ndarray, capacity: int) -> int:
    if not len(size):
        return 0
    best = -(-int((size * count).sum()) // capacity)
    for t in {int(x) for x in size[size <= capacity // 2]} | {0}:
        value = np.where(size > capacity - t, capacity, np.where(size >= t, size, 0))
        best = max(best, -(-int((value * count).sum()) // capacity))
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def _bound_of_all(pieces: DataFrame, capacity: int) -> int:
    rows = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # ``capacity`` rows at most
    return _bound(np.array([r.length for r in rows], np.int64), np.array([r.n for r in rows], np.int64), capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for the rows of pack: sequences, lower_bound (no packing has fewer) and certified (they are equal)."""
    bound = _bound_of_all(packed, capacity)
    return packed.agg(F.count_if(F.col("offset") == 0).alias("sequences")).select("sequences", F.lit(bound).cast("bigint").alias("lower_bound"), (F.col("sequences") == bound).alias("certified"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: list[dict] | None = None) -> DataFrame:
    """Sequences of at most ``capacity`` tokens; adds sequence_id and offset to every piece, drops none.

    pieces: doc_id, piece, start, length, ids_crc32 with 1 <= length <= capacity; null ids and repeated rows are packed
    like others; an empty table gives an empty one. Pieces of ``capacity`` fill a sequence of their own. See certificate
    for how far the result can be from the best one. rounds: gets a dict for each round, with the partitions that there
    were and those that were certified, the pieces exchanged after it, and the bins of what it packed.
    """
    keep = pieces.columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(keep).schema)
    left, n, done, number = pieces, pieces.count(), [], 0
    parts, settled_bins, stale = -(-n // per_partition), 0, 0
    open_rows, open_bins = None, None  # the best packing so far of what is left
    bound = _bound_of_all(pieces, capacity)
    while n:
        base = number << 50

        def run(batches, base=base, number=number):
            rows = [b for b in batches if b.num_rows]
            if not rows:
                return
            t = pa.Table.from_batches(rows).combine_chunks()
            size = t.column("length").to_numpy()
            least = lower_bound(size, capacity)
            bins_of, bins = best_of_orders(size, least, capacity, number)
            used = np.bincount(bins_of, weights=size, minlength=bins)
            certified = bins == least
            stays = used == capacity
            if certified:
                by_room = np.argsort(-used, kind="stable")
                stays[by_room] = np.cumsum(capacity - used[by_room]) <= capacity // ROOM_LEFT
            order = np.lexsort((np.arange(len(size)), bins_of))
            b, s = bins_of[order], size[order]
            before = np.cumsum(s) - s
            first = np.r_[True, b[1:] != b[:-1]]
            offset = np.empty(len(size), np.int64)
            offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            part = int(t.column("part")[0].as_py())
            seq = bins_of + base + (part << 28)
            more = [pa.array(seq), pa.array(offset), pa.array(stays[bins_of]), pa.array(np.full(len(size), certified)), pa.array(np.full(len(size), part, np.int32))]
            out = pa.table([*(t.column(c) for c in keep), *more], [*keep, *_ADDED])
            yield from out.to_batches(max_chunksize=20_000)

        # by place in the stored table, so that rows that repeat are spread like any others
        key = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(parts)).cast("int")
        dealt = left.withColumn("part", key).repartitionById(parts, F.col("part"))
        packed = stored(dealt.sortWithinPartitions("doc_id", "piece", "ids_crc32").mapInArrow(lean(run), f"{shape}, sequence_id bigint, offset bigint, settled boolean, certified boolean, part int"))
        each = packed.groupBy("part", "certified").agg(F.count_if(~F.col("settled")).alias("rest"), F.count_if(F.col("settled") & (F.col("offset") == 0)).alias("closed"), F.count_if(~F.col("settled") & (F.col("offset") == 0)).alias("opened"))
        got = each.agg(F.count("*"), F.count_if("certified"), F.sum("rest"), F.sum("closed"), F.sum("opened")).first()
        of, certified, rest, closed, opened = got
        if rounds is not None:
            rounds.append({"partitions": of, "certified": certified, "exchanged": rest, "bins": closed + opened})
        saved = None if open_bins is None else open_bins - closed - opened
        stale = 0 if saved is None or saved > open_bins // WORTH else stale + 1
        if saved is None or saved > 0:
            done.append(packed.where("settled").drop("settled", "certified", "part"))
            open_rows, n, open_bins, settled_bins = packed.where("not settled").drop("settled", "certified", "part"), rest, opened, settled_bins + closed
            left = open_rows.select(keep)
        if settled_bins + open_bins == bound or stale == STALE:
            break
        parts, number = max(-(-n // (LARGEST * per_partition)), min(parts // 2, -(-n // per_partition)), 1), number + 1
    if not done:
        return pieces.selectExpr("*", "cast(0 as bigint) as sequence_id", "cast(0 as bigint) as offset")
    out = open_rows
    for more in done:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **how) -> DataFrame:
    """Cut and pack every row of ``docs`` (doc_id, text); see cut_pieces and pack."""
    return pack(stored(cut_pieces(docs, tokenizer, capacity)), capacity, **how)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (null texts: empty; repeated rows and null ids like others) as pieces in sequences; see cut_pieces and pack."""
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict[str, str] = {}
