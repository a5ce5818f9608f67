"""Vectors as short codes: each part of a vector becomes the index of the nearest entry of its codebook.

All arithmetic is on integers, so codes, errors and codebooks are the same however the rows are dealt out. The nearest
entry is found by lower bounds, coarse to fine: a part is cut into blocks (one, two, four and so on), and for each block
the squared distance is at least the block's size times the squared difference of the means plus the squared difference
of the norms of what is left when the mean is taken off. An entry whose bound is above the exact distance of one of
the most promising ones can't be nearest; those that are left at the finest level get their exact distance.

A round is one pass over the rows: each task sums up the parts that each entry got, and Spark adds the tasks' sums. What
goes through the driver are the codebooks and their sums alone: entries x components numbers, whatever the number of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, few, lean, read, stored, workspace

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components of larger size are an error: their squared distances wouldn't fit into 64 bits.
LARGEST = 2**27
#: Entries with the lowest coarse bounds whose exact distance the other bounds are held against first.
_PROBES = 4
#: Rows whose bounds are held at once.
_AT_ONCE = 2048


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _blocks(size: int) -> list[list[slice]]:
    """Cuts of a part into 1, 2, 4, ... blocks, as long as a block has two components or more somewhere."""
    out, n = [], 1
    while n < size:
        at = [size * i // n for i in range(n + 1)]
        out.append([slice(a, b) for a, b in zip(at, at[1:])])
        n *= 2
    return out


def _marks(x: np.ndarray, blocks: list[slice]) -> np.ndarray:
    """For each row the blocks' means times the root of their size, then the norms of what is left: (rows, 2 x blocks)."""
    f = x.astype(float)
    mean = [f[:, b].mean(1, keepdims=True) for b in blocks]
    scaled = [np.sqrt(b.stop - b.start) * m for b, m in zip(blocks, mean)]
    left = [np.sqrt(((f[:, b] - m) ** 2).sum(1, keepdims=True)) for b, m in zip(blocks, mean)]
    return np.concatenate([*scaled, *left], 1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Index of the nearest row of ``book`` (ties: the lower one) and squared distance for each row of x, all integers.

    The third is how many (row, entry) pairs came to each level of bounds and to the exact distance.
    """
    n, size = x.shape
    if not size:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), [0]
    index, distance, tally = np.empty(n, np.int64), np.empty(n, np.int64), None
    levels = [(b, _marks(book, b)) for b in _blocks(size)]
    for cut in range(0, n, _AT_ONCE):
        part = x[cut : cut + _AT_ONCE]
        # bounds are taken a little lower than computed, by more than their rounding errors
        slack = 1e-9 * ((part.astype(float) ** 2).sum(1) + float((book.astype(float) ** 2).sum(1).max()) + 1)
        came = []
        if levels:
            marks = _marks(part, levels[0][0])
            bound = sum((marks[:, i, None] - levels[0][1][:, i]) ** 2 for i in range(marks.shape[1]))
            probes = np.argpartition(bound, min(_PROBES, len(book)) - 1, axis=1)[:, :_PROBES]
            most = ((part[:, None] - book[probes]) ** 2).sum(2).min(1)
            came.append(bound.size)
            row, entry = np.nonzero(bound <= (most + slack)[:, None])
            for blocks, of_book in levels[1:]:
                came.append(len(row))
                of_part = _marks(part, blocks)
                bound = sum((of_part[row, i] - of_book[entry, i]) ** 2 for i in range(of_part.shape[1]))
                first = np.searchsorted(row, np.arange(len(part)))
                lowest = np.minimum.reduceat(bound, first)
                probe = np.minimum.reduceat(np.where(bound == lowest[row], entry, len(book)), first)
                most = np.minimum(most, ((part - book[probe]) ** 2).sum(1))
                stays = bound <= (most + slack)[row]
                row, entry = row[stays], entry[stays]
        else:
            row, entry = (a.ravel() for a in np.indices((len(part), len(book))))
        came.append(len(row))
        exact = ((part[row] - book[entry]) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(part)))  # rows keep one entry at least: the nearest
        least = np.minimum.reduceat(exact, first)
        index[cut : cut + len(part)] = np.minimum.reduceat(np.where(exact == least[row], entry, len(book)), first)
        distance[cut : cut + len(part)] = least
        tally = came if tally is None else [a + b for a, b in zip(tally, came)]
    return index, distance, tally or [0]


def _whole(column: pa.Array, size: int, parts: int, scale: int) -> np.ndarray:
    """The batch's vectors as integers, (rows, parts, components of a part)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != size).any():
        raise ValueError(f"vectors of {size} and of {int(lengths[lengths != size][0])} components in one table")
    got = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    if got.size and np.abs(got).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return got.astype(np.int64).reshape(len(column), parts, size // parts)


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, components) as integers of floor(scale * x).

    They start as the parts of the rows with the smallest ids (null ids last; equal ids by their vectors); each round
    replaces an entry by the componentwise floor of the mean of the parts nearest to it, and leaves an unused one. Rows
    without a usable vector don't count. A table with fewer usable rows gives as many entries as it has, an empty one
    none. Vectors of different lengths, of a length that ``parts`` doesn't divide, or with components beyond LARGEST
    are an error.
    """
    kept = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    seeds = [r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not seeds:
        return np.zeros((parts, 0, 0), np.int64)
    size = len(seeds[0])
    if size % parts:
        raise ValueError(f"{parts} equal parts of {size} components")
    if any(len(s) != size for s in seeds):
        raise ValueError("vectors of different lengths in one table")
    scaled = np.floor(np.array(seeds, float).reshape(len(seeds), size) * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    books = scaled.astype(np.int64).reshape(len(seeds), parts, size // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        found = kept.select("v").mapInArrow(lean(_summed(books, size, scale)), "part int, entry int, place int, n bigint, total bigint")
        exact = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = books.copy()
        for r in exact.collect():  # as many as the codebooks have numbers
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    return books


def _summed(books: np.ndarray, size: int, scale: int):
    """Numbers and sums of the parts that each entry gets, once for each task."""
    parts, entries, m = books.shape

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            x = _whole(b.column(0), size, parts, scale)
            for p in range(parts):
                index, _, _ = nearest(x[:, p], books[p])
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, x[:, p])
        part, entry = np.nonzero(n)
        each = [np.repeat(a, m) for a in (part, entry)] + [np.tile(np.arange(m), len(part)), np.repeat(n[part, entry], m), total[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(k)) for a, k in zip(each, ("i4", "i4", "i4", "i8", "i8"))], ["part", "entry", "place", "n", "total"])

    return run


def encode_vectors(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), scale: int = SCALE) -> DataFrame:
    """id_col, the columns named in ``keep``, code (two hex digits for each part) and error (squared distances, summed).

    Rows whose vector is null or has null or non-finite components are left out. Rows that repeat, null ids and equal
    ids stay rows; an empty table gives an empty one; columns that aren't named are left out.
    """
    parts, entries, m = books.shape
    if entries > 256:
        raise ValueError("two hex digits name 256 entries")
    cols = [id_col, *keep]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for b in batches:
            x = _whole(b.column(b.num_columns - 1), parts * m, parts, scale)
            codes, error = [], np.zeros(len(x), np.int64)
            for p in range(parts):
                index, distance, _ = nearest(x[:, p], books[p])
                codes.append(digits[index])
                error += distance
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map("".join, zip(*codes)), pa.string()), pa.array(error)], [*cols, "code", "error"])

    chosen = vectors.where(usable(F.col(vector_col))).select(*cols, F.col(vector_col).alias(beside(cols, "v")[0]))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*cols).schema)
    return chosen.mapInArrow(lean(run), f"{shape}, code string, error bigint")


def decode_vectors(codes: DataFrame, books: np.ndarray, code_col: str = "code", vector_col: str = "decoded", scale: int = SCALE) -> DataFrame:
    """Adds the vectors that the codes stand for: the entries' components over ``scale``. A null code gives a null."""
    parts, _, m = books.shape
    flat = F.array(*(F.array(*(F.lit(float(v) / scale) for v in row)) for row in books.reshape(-1, m))) if books.size else F.array(F.array(F.lit(0.0)))
    at = lambda p: p * books.shape[1] + F.conv(F.substring(F.col(code_col), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn(vector_col, F.when(F.col(code_col).isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(flat, at(p))))))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_group_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds label_error, the error summed over the rows with the same label (nulls together).

    The sums are sent to the rows where there are few() labels; else the join shuffles, and a label with very many rows
    is split by adaptive execution.
    """
    (name,) = beside(coded.columns, "label")
    sums = coded.groupBy(F.col(label_col).alias(name)).agg(F.sum("error").alias("label_error"))
    return coded.join(few(sums), coded[label_col].eqNullSafe(F.col(name)), "left").drop(name)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable rows of embeddings under codebooks fitted on all of them. Other rows are dropped; see fit_codebooks and encode_vectors."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit_codebooks(vectors)
    with workspace(spark) as keep:
        coded = stored(encode_vectors(vectors, books, keep=("label",)))
        out = keep(with_group_error(coded).select("vec_id", "code", "error", "label_error"))
    return out.withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))


def _oracle() -> str:
    def assigned(book: str) -> str:
        return f"(SELECT vec_id, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (SELECT c.vec_id, c.p, b.e, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM comp c JOIN {book} b ON c.p = b.p AND c.j = b.j GROUP BY 1, 2, 3) s GROUP BY 1, 2)"

    def moved(book: str) -> str:
        return f"(SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT c.p, a.e, c.j, CAST(floor(sum(c.x) / count(*)) AS BIGINT) AS x FROM comp c JOIN {assigned(book)} a ON a.vec_id = c.vec_id AND a.p = c.p GROUP BY 1, 2, 3) m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"

    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding AS v, len(embedding) // 16 AS m FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
comp AS MATERIALIZED (SELECT vec_id, i // m AS p, i % m AS j, CAST(floor(256 * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT *, unnest(range(len(v))) AS i FROM kept) u),
book0 AS MATERIALIZED (SELECT c.p, r.e, c.j, c.x FROM comp c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) r ON r.vec_id = c.vec_id),
book1 AS MATERIALIZED {moved("book0")},
book2 AS MATERIALIZED {moved("book1")},
coded AS MATERIALIZED (SELECT k.vec_id, k.label, string_agg(printf('%02x', CAST(a.e AS INT)), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM kept k JOIN {assigned("book2")} a ON a.vec_id = k.vec_id GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256 FROM coded"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES: dict[str, str] = {"op11_vector_codes": _oracle()}
