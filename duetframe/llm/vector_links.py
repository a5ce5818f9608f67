"""Near copies among vectors: links of cosine ``least`` or more, found through an inverted multi-index.

Vectors are halved, and each half has a codebook of its own (k-means over a bounded sample); pairs of entries are the
cells of a grid, and a vector lies in the cell of its two nearest entries. A search walks the two sequences of entries,
sorted by their distance from the vector's halves, and visits cells by rising sum of the two distances until that sum is
``stop`` beyond the vector's own cell. ``stop`` is the target recall's: over a sample of vectors, a neighbour is drawn
at cosine ``least`` exactly (the hardest that counts), and ``stop`` is what the walk needs to come to its cell in a share
TARGET of the draws. No number of cells, candidates or partners is capped, and a copy nearer than ``least`` is found more
surely. Of two vectors the one in the lower cell visits the other's, so a pair meets once.

Equal vectors are one row with a count. Cells are cut into tiles of residents and chunks of visitors by their exact
counts, so a crowded cell is many tasks; a task multiplies its two blocks in double precision and returns, for each
vector, a number of links and one edge to what it hangs together with in the block (not the pairs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, connected_components, few, lean, read, shuffle_partitions, stored, workspace
from .vector_codes import usable

LEAST = 0.9
#: Share of the neighbours at cosine LEAST exactly whose cell a search must come to.
TARGET = 0.95
#: Entries of a codebook, at most, and the sampled vectors that each is fitted on. Which ones is a matter of a hash.
MOST_ENTRIES = 1024
SAMPLE_PER_ENTRY = 32
LEAST_SAMPLE = 4096
#: Draws by which the walk's length is set.
DRAWS = 4000
#: Residents of a tile and visitors of a chunk, at most.
TILE, CHUNK = 16_384, 32_768
#: Cosines that are held at once.
_AT_ONCE = 2_000_000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, scaled to length one, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    if x.size:
        x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay in range
        x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1))


def _fit(x: np.ndarray, entries: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means over the rows of x; an entry that gets none stays."""
    book = x[rng.choice(len(x), entries, replace=False)]
    for _ in range(rounds):
        own = _distances(x, book).argmin(1)
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=entries)[:, None]
        book = np.where(n > 0, total / np.maximum(n, 1), book)
    return book


class Grid:
    """Two codebooks and how far beyond its own cell a search goes."""

    def __init__(self, first: np.ndarray, second: np.ndarray, stop: float = 0.0):
        self.first, self.second, self.stop = first, second, stop

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """home of each row of x, and the cells (row, cell) that its search comes to.

        Rank by rank of the first sequence, the second one is followed as long as the sum stays within the stop: the
        staircase of cells that a multi-sequence walk has visited when it ends.
        """
        a, b = self.distances(x)
        by_a, by_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        limit = a[:, 0] + b[:, 0] + self.stop
        rows, cells = [], []
        for rank in range(a.shape[1]):
            at = np.flatnonzero(a[:, rank] + b[:, 0] <= limit)
            if not len(at):
                break
            inside = b[at] + a[at, rank, None] <= limit[at, None]
            row, place = np.nonzero(inside)
            rows.append(at[row])
            cells.append(by_a[at[row], rank] * len(self.second) + by_b[at[row], place])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(row, kind="stable")
        return by_a[:, 0] * len(self.second) + by_b[:, 0], row[order], cell[order]


def fit_grid(sample: np.ndarray, entries: int, least: float = LEAST, target: float = TARGET, seed: int = 11) -> Grid:
    """Codebooks of both halves, and the stop at which a search comes to the cell of a neighbour in ``target`` of the draws."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    grid = Grid(_fit(sample[:, :half], entries, rng), _fit(sample[:, half:], entries, rng))
    x = sample[rng.integers(0, len(sample), DRAWS)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    size = np.sqrt((away * away).sum(1, keepdims=True))
    near = least * x + np.sqrt(max(0.0, 1 - least * least)) * np.divide(away, size, out=np.zeros_like(away), where=size > 0)
    a, b = grid.distances(x)
    there = grid.home(near)
    cost = a[np.arange(DRAWS), there // entries] + b[np.arange(DRAWS), there % entries] - a.min(1) - b.min(1)
    grid.stop = float(np.quantile(cost, target)) + 1e-9
    return grid


def _merged(label: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the columns after each row has joined what it is linked with, and the labels of the rows.

    A label is the index of a column; all columns with a label get the least label of what they hang together with.
    """
    none = len(label)
    while True:
        own = np.where(linked, label, none).min(1)
        new = np.minimum(label, np.where(linked, own[:, None], none).min(0))
        if (new == label).all():
            return label, own
        to = np.arange(none)
        np.minimum.at(to, label, new)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def block_links(residents: np.ndarray, n_res: np.ndarray, visitors: np.ndarray | None, n_vis: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of residents among themselves (visitors None) or with visitors.

    Gives the numbers of links (copies counted) of the residents and of the visitors, and for each of both the resident
    that stands for what it hangs together with (-1: nothing).
    """
    own = visitors is None
    rows, n_rows = (residents, n_res) if own else (visitors, n_vis)
    r, label = len(residents), np.arange(len(residents))
    links_r, links_v, of_v = np.zeros(r, np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
    met = np.zeros(r, bool)
    step = max(1, _AT_ONCE // max(1, r))
    for cut in range(0, len(rows), step):
        linked = rows[cut : cut + step] @ residents.T >= least
        i = np.arange(len(linked))
        if own:
            linked[i, cut + i] = False
        at, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(at):
            continue
        part = linked[np.ix_(at, cols)]
        links_v[cut + at] = (part * n_res[cols]).sum(1)
        if own:
            part |= (cut + at)[:, None] == cols  # a row is a column too, and goes with its links
        else:
            links_r[cols] += (part * n_rows[cut + at, None]).sum(0)
        # labels of these columns, as ranks among them
        seen, rank = np.unique(label[cols], return_inverse=True)
        by_rank = np.argsort(rank, kind="stable")
        classes = np.logical_or.reduceat(part[:, by_rank], np.searchsorted(rank[by_rank], np.arange(len(seen))), axis=1)
        to, of_rows = _merged(np.arange(len(seen)), classes)
        moved = np.arange(r)
        moved[seen] = seen[to]
        label = moved[label]
        of_v[cut + at] = seen[of_rows]
        met[cols] = True
    of_v = np.where(of_v >= 0, label[of_v], -1)
    if own:
        return links_v, np.zeros(0, np.int64), np.where(links_v > 0, label, -1), np.zeros(0, np.int64)
    return links_r, links_v, np.where(met, label, -1), of_v


def _verify(least: float):
    kind = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        visits = table.column("visits").to_numpy()
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        x = matrix(table.column("v"))
        res, vis = np.flatnonzero(~visits), np.flatnonzero(visits)
        links = np.zeros(len(node), np.int64)
        out = []
        if table.column("among").to_numpy().any():
            got, _, of, _ = block_links(x[res], n[res], None, None, least)
            at = np.flatnonzero(got)
            out.append((node[res[at]], got[at], node[res[of[at]]]))
        if len(res) and len(vis):
            links[res], links[vis], of_r, of_v = block_links(x[res], n[res], x[vis], n[vis], least)
            of = np.full(len(node), -1)
            of[res], of[vis] = of_r, of_v
            at = np.flatnonzero(of >= 0)
            out.append((node[at], links[at], node[res[of[at]]]))
        if not out:
            return kind.empty_table()
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=kind)

    return run


def _place(grid: Grid):
    def run(batches):
        for b in batches:
            home, row, cell = grid.walk(matrix(b.column(2)))
            up = cell > home[row]
            row, cell = row[up], cell[up]
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(home)))]
            visits = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(cell.astype("i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype("i4")), visits], ["node", "n", "v", "home", "cells"])

    return run


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, h, g) with two hashes of a usable vector, else nulls, and the distinct vectors (h, g, id, n, v, node)."""
    v = F.col(vector_col)
    zero = F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False))
    ok = usable(v) & ~zero
    rows = vectors.select(F.col(id_col).alias("id"), F.when(ok, F.xxhash64(v)).alias("h"), F.when(ok, F.xxhash64(F.lit(1), v)).alias("g"), F.when(ok, v).alias("v"))
    each = rows.where("h is not null").groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    return rows.drop("v"), stored(each.withColumn("node", F.monotonically_increasing_id()))


def _sample(each: DataFrame, n: int, most: int) -> np.ndarray:
    """About ``most`` of the n vectors, by a hash of their hashes: the same ones however the rows are dealt out."""
    share = min(1.0, 1.1 * most / n)
    drawn = F.pmod(F.xxhash64("h", "g", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    return matrix(each.where(drawn).select("v").limit(2 * most).toArrow().column("v"))


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, target: float = TARGET) -> DataFrame:
    """id_col, n_links (other rows whose vector has a cosine of ``least`` or more, as found) and component_id (the least id reachable by links).

    Pairs of less are never linked; of pairs at ``least`` exactly about ``target`` are found, of nearer ones more, of
    equal vectors all. Vectors that are null, of length zero, or have null or non-finite components link with nothing
    (their own id, no links). Rows that repeat and equal ids stay rows and link with each other; null ids never name a
    component unless no other id is in it; an empty table gives an empty one; other columns are left out. Vectors of
    different lengths are an error.
    """
    spark = vectors.sparkSession
    result = [F.col("id").alias(id_col), "n_links", "component_id"]
    with workspace(spark) as keep:
        rows, each = _classes(vectors, id_col, vector_col)
        n, least_size, most_size = each.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if not n:
            return keep(rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")).select(*result))
        if least_size != most_size:
            raise ValueError(f"vectors of {least_size} and of {most_size} components in one table")
        entries = max(1, min(MOST_ENTRIES, round(n**0.25)))
        sample = _sample(each, n, max(LEAST_SAMPLE, SAMPLE_PER_ENTRY * entries))
        grid = fit_grid(sample, min(entries, len(sample)), least, target) if len(sample) else Grid(np.zeros((1, most_size // 2)), np.zeros((1, most_size - most_size // 2)))
        kind = each.schema["v"].dataType.simpleString()
        placed = stored(each.select("node", "n", "v").mapInArrow(lean(_place(grid)), f"node bigint, n bigint, v {kind}, home int, cells array<int>"))
        found = stored(_meet(placed, n, least))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        of = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
        named = each.select("node", "id").join(of.withColumnRenamed("id", "node"), "node")
        named = stored(named.groupBy("component").agg(F.min("id").alias("component_id")))
        of = of.join(few(named), "component").select(F.col("id").alias("node"), "component_id")
        known = each.select("h", "g", "node", F.col("id").alias("own"), "n").join(links, "node", "left").join(of, "node", "left")
        known = known.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "own").alias("component_id"))
        out = rows.join(few(stored(known)), ["h", "g"], "left")
        unlinked = F.col("h").isNull()
        out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("bigint"), "component_id": F.when(unlinked, F.col("id")).otherwise(F.col("component_id"))})
        return keep(out.select(*result))


def _meet(placed: DataFrame, n: int, least: float) -> DataFrame:
    """node, links and other of every block in which residents meet visitors or each other."""
    spark = placed.sparkSession
    tile = max(256, min(TILE, n // (2 * shuffle_partitions(spark))))
    chunk = tile * (CHUNK // TILE)
    living = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("living"))
    coming = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("coming"))
    # as many rows as the grid has cells, MOST_ENTRIES squared at most
    tiles = F.ceil(F.col("living") / tile)
    extra = F.when(tiles > 1, F.col("living")).otherwise(0)
    cells = living.join(coming, "cell", "left").select("cell", tiles.cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil((F.coalesce("coming", F.lit(0)) + extra) / chunk)).cast("int").alias("chunks"))
    cells = F.broadcast(stored(cells))
    own, nth = (lambda of: F.pmod(F.xxhash64("node"), of).cast("int")), (lambda of: F.pmod(F.xxhash64("node", F.lit(5)), of).cast("int"))
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    at_home = placed.select("node", "n", "v", F.col("home").alias("cell")).join(cells, "cell").withColumn("tile", own(F.col("tiles")))
    columns = ["cell", "tile", "chunk", "node", "n", "v", "visits", "among"]
    residents = at_home.withColumn("chunk", upto("chunks")).withColumns({"visits": F.lit(False), "among": F.col("chunk") == 0})
    later = at_home.where("tile + 1 < tiles").withColumn("tile", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)))
    visitors = placed.select("node", "n", "v", F.explode("cells").alias("cell")).join(cells, "cell").withColumn("tile", upto("tiles"))
    strange = lambda d: d.withColumns({"chunk": nth(F.col("chunks")), "visits": F.lit(True), "among": F.lit(False)}).select(*columns)
    dealt = residents.select(*columns).unionByName(strange(later)).unionByName(strange(visitors))
    return dealt.groupBy("cell", "tile", "chunk").applyInArrow(_verify(least), "node bigint, links bigint, other bigint")


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of embeddings; see vector_links for nulls, zeros, repeated rows and equal ids. kept: the id names the component."""
    found = vector_links(read(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op13_vector_links": op13_vector_links}
ORACLES: dict[str, str] = {}
