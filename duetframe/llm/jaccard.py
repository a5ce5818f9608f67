"""N-gram Jaccard join by a token-group matrix.

Documents with the same set of shingles are one class. Classes are put into groups of similar ones: each shares some of
its rarest shingles with the most central class that has them, and if the two are similar they are in one group. The matrix
holds, for every shingle that decides, which groups have it; with each group goes the union of its members' shingles.
A class is held against the groups of other clusters that the matrix finds for it: a group is opened only if the class
has enough shingles in common with the union, and then compared with its members one by one. Classes of one cluster are
compared through what each has more or less than the cluster's centre.

Nothing is lost: two similar sets have a shingle in common among the first of both in any fixed order of shingles (the
smaller set needs fewer of them), and the order here puts frequent ones last. How often a shingle occurs is counted in
a table of fixed size, over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, beside, connected_components, few, lean, read, stored, workspace

#: Counters of the table of shingle frequencies, as a power of two, and the parts it is added up in.
COUNTER_BITS, COUNTER_PARTS = 20, 64
#: Classes of a group, about.
GROUP_SIZE = 32
#: Classes of a cluster, and shingles by which they differ from its centre, that a task compares with as many others, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1_000, 2_000_000
#: Classes that meet a copy of their cluster's centre (or pivot) in one place, about.
BESIDE_PIVOT = 500
WORDS_HELD = 200_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    def __missing__(self, word):
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, k: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; one of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(known) > WORDS_HELD:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    if not k:
        return np.empty(0, np.int64)
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = (x ^ h[i : len(h) - k + 1 + i]) * _MIX[0]
        x ^= x >> np.uint64(29)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return np.unique((x ^ (x >> np.uint64(31))).view(np.int64))


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (hash of the text; with the id it names a row's text) and text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))


def _scan(rows: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows: doc_id, key, n, hi, lo (hash of the set) for documents; part, counts of the table for tasks."""

    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        import xxhash

        id_type = None
        known, counts, waiting, size = _Words(), np.zeros(1 << COUNTER_BITS, np.int32), [], 0
        for b in batches:
            id_type = b.schema.field(0).type
            n, hi, lo = [], [], []
            for text in b.column(2):
                tokens = shingle_hashes(text.as_py(), k, known)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                n.append(len(tokens))
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                waiting.append(tokens)
                size += len(tokens)
                if size > 2_000_000:
                    counts += np.bincount(_counter(np.concatenate(waiting)), minlength=len(counts)).astype(np.int32)
                    waiting, size = [], 0
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "key", "n", "hi", "lo", "part", "counts"])
        if waiting:
            counts += np.bincount(_counter(np.concatenate(waiting)), minlength=len(counts)).astype(np.int32)
        if counts.any():
            none = pa.nulls(COUNTER_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(COUNTER_PARTS, id_type), none, none, none, none, pa.array(range(COUNTER_PARTS), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, COUNTER_PARTS)], pa.binary())], ["doc_id", "key", "n", "hi", "lo", "part", "counts"])

    return rows.mapInArrow(lean(scan), f"doc_id {kind}, key bigint, n bigint, hi bigint, lo bigint, part int, counts binary")


def _frequency_classes(scanned: DataFrame) -> np.ndarray:
    """For each counter the binary logarithm of its count; a table of 2**COUNTER_BITS bytes, whatever the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[part] = sums[part] + c if part in sums else c
        for part, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.log2(1 + c).astype(np.uint8).tobytes()], pa.binary())], ["part", "level"])

    parts = scanned.where("part is not null").select("part", "counts").repartition("part").mapInArrow(lean(add), "part int, level binary")
    levels = np.zeros((COUNTER_PARTS, (1 << COUNTER_BITS) // COUNTER_PARTS), np.uint8)
    for r in parts.collect():
        levels[r.part] = np.frombuffer(r.level, np.uint8)
    return levels.reshape(-1)


def _keys(reps: DataFrame, levels, k: int, percent: int) -> DataFrame:
    """token, id, n, at: the first shingles of each set in the common order (at: their places), by which it can be found."""

    def keys(batches):
        known, level = _Words(), levels.value
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                token, row, size, place = [], [], [], []
                for i, text in enumerate(part.column(1)):
                    t = shingle_hashes(text.as_py(), k, known)
                    n = len(t)
                    if n * (100 - percent) < percent:  # no other set is similar to so small a one
                        continue
                    probe = n - -(-percent * n // 100) + 1
                    rank = level[_counter(t)]
                    t = t[np.lexsort((t, rank))[:probe]]
                    token.append(t)
                    row.append(np.full(len(t), i))
                    size.append(np.full(len(t), n))
                    place.append(np.arange(len(t)))
                if token:
                    row, size, place = map(np.concatenate, (row, size, place))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), part.column(0).take(pa.array(row)), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], ["token", "id", "n", "at"])

    return reps.mapInArrow(lean(keys), "token bigint, id bigint, n int, at int")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """The columns beside ``text``, and the sets of the texts as tokens."""
    extra = [f for f in texts.schema if f.name != "text"]

    def sets(batches):
        known = _Words()
        for b in batches:
            for part in (b.slice(i, 250) for i in range(0, b.num_rows, 250)):
                got = [shingle_hashes(t.as_py(), k, known) for t in part.column("text")]
                at = pa.array(np.r_[0, np.cumsum([len(g) for g in got])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in extra), pa.ListArray.from_arrays(at, pa.array(np.concatenate(got)))], [*(f.name for f in extra), "tokens"])

    return texts.mapInArrow(lean(sets), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra) + ", tokens array<bigint>")


def _similar(a, b, percent: int):
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _at_least(part, whole: int):
    """ceil(part / whole) of integers."""
    return F.ceil(part / F.lit(whole)).cast("bigint")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row; also key, the text's hash, and group, a name of the component.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct k-word
    shingles, of fewer words the whole sequence. Two documents link if 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable by links, n_links the number of other rows that a row links with. Null
    and empty texts and texts without words have an empty set, link with nothing and keep their own id (their group is
    null). A null id is never the smallest (a component of such rows alone has a null id); ids are of any type that
    sorts. Rows with the same id and text are copies like any others, rows with the same id and other texts are
    different documents. Texts of any length are taken whole. An empty table gives an empty one; other columns are left
    out. The result is a stored table.
    """
    with workspace(docs.sparkSession) as keep:
        return keep(_groups(_rows(docs, id_col, text_col), k, percent))


def _groups(rows: DataFrame, k: int, percent: int, count_links: bool = True) -> DataFrame:
    """The rows of jaccard_groups; without count_links n_links is left out."""
    spark = rows.sparkSession
    scanned = stored(_scan(rows, k))
    levels = spark.sparkContext.broadcast(_frequency_classes(scanned))
    members = scanned.where("part is null").drop("part", "counts")
    # a class is known by 64 bits of its set's hash: ids need be neither there nor unique
    alike = members.where("n > 0").groupBy("hi", "lo", "doc_id", "key").agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows"))
    classes = alike.groupBy("hi", "lo").agg(at.alias("f"), F.first("n").alias("n"), F.sum("rows").alias("weight"))
    classes = stored(classes.select(F.col("hi").alias("node"), "lo", "n", "weight", F.col("f.doc_id").alias("at_id"), F.col("f.key").alias("at_key"), (F.col("f.rows") > 1).alias("again")))
    again = not classes.where("again").isEmpty()
    smallest = percent // (100 - percent) + (percent % (100 - percent) > 0)  # a smaller set is similar to no other

    def texts_of(nodes: DataFrame) -> DataFrame:
        """One text for each class in ``nodes`` (node and more columns)."""
        asked = classes.select("node", "at_id", "at_key", "again").join(nodes, "node")

        def found(asked: DataFrame) -> DataFrame:
            asked = few(asked)
            return rows.join(asked, rows.doc_id.eqNullSafe(asked.at_id) & (rows.key == asked.at_key)).select(*nodes.columns, "text")

        once = found(asked.where("not again"))
        return once.unionByName(found(asked.where("again")).dropDuplicates(nodes.columns[:1])) if again else once

    keys = stored(_keys(texts_of(classes.where(F.col("n") >= smallest).select("node")), levels, k, percent))
    levels.destroy()
    # the set in which the shingle stands foremost has the fewest shingles of its own: it is in the middle of the others
    pivots = keys.groupBy("token").agg(F.min_by("id", "at").alias("pivot"), F.min("id").alias("low"), F.max("id").alias("top"))
    pivots = pivots.where("low <> top").select("token", "pivot")
    shared = stored(keys.join(pivots, "token"))
    near = stored(_near_pivots(shared, texts_of, k, percent))
    clusters = stored(connected_components(near))
    links = stored(_links_across(shared, clusters, texts_of, k, percent))
    both = clusters.select("id", "component")
    if not links.isEmpty():
        at = clusters.select(F.col("id"), F.col("component"))
        ends = links.join(at.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(at.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        merged = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("root"))
        whole = at.join(merged, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        both = whole.union(merged.select(F.col("component").alias("id"), F.col("root").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    grouped = classes.join(both, classes.node == both.id, "left").select("node", "lo", "at_id", "weight", F.coalesce("component", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("at_id").alias("least"))
    told = grouped.join(least, "group")
    if count_links:
        weights = classes.select(F.col("node").alias("other"), "weight")
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # sets of one size are found from both
        across = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).join(weights, "other").select("id", F.col("weight").alias("links"))
        counted = across.union(_links_inside(near, clusters, classes, texts_of, k, percent)).groupBy(F.col("id").alias("linked")).agg(F.sum("links").alias("links"))
        told = told.join(counted, told.node == counted.linked, "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("links", F.lit(0)))
    more = ["n_links"] if count_links else []
    own = few(stored(told.select(F.col("node").alias("hi"), "lo", "group", "least", *more)))
    some = members.where("n > 0").join(own, ["hi", "lo"]).select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), *more, "group")
    none = members.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *(F.lit(0).cast("bigint").alias(c) for c in more), F.lit(None).cast("bigint").alias("group"))
    return some.unionByName(none)


def _beside(of: DataFrame, pivot: str, texts_of, k: int) -> DataFrame:
    """node, ``pivot``, tokens and of_pivot: the sets of the classes in ``of`` (node, pivot) and of their pivots.

    A pivot that very many classes have is copied, so that they don't all meet in one task.
    """
    crowd = of.groupBy(pivot).agg(F.ceil(F.count("*") / BESIDE_PIVOT).alias("copies"))
    salted = of.join(crowd, pivot).select("node", pivot, F.pmod(F.xxhash64("node"), F.col("copies")).alias("salt"))
    others = _sets(texts_of(salted), k)
    middle = _sets(texts_of(crowd.select(F.col(pivot).alias("node"), "copies")), k)
    middle = middle.select(F.col("node").alias(pivot), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("salt"), F.col("tokens").alias("of_pivot"))
    return others.join(middle, [pivot, "salt"]).select("node", pivot, "tokens", "of_pivot")


def _links_inside(near: DataFrame, clusters: DataFrame, classes: DataFrame, texts_of, k: int, percent: int) -> DataFrame:
    """id and links: with how many rows of other classes of its cluster a class links, in one or more parts.

    With P the set of the cluster's centre and D(X) what X has more or less than P, two sets have
    |P| - |P - A| - |P - B| + |D(A) & D(B)| shingles in common, whatever P is: the shingles of D tell it all, and they are
    few where sets are similar. A large cluster is cut into blocks, and tasks compare one block with another.
    """
    best = near.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n")).join(clusters, "id").groupBy("component").agg(F.max_by("id", F.struct("n", "id")).alias("centre"))
    of = clusters.join(best, "component").select(F.col("id").alias("node"), "centre")
    more, less = F.array_except("tokens", "of_pivot"), F.array_except("of_pivot", "tokens")
    apart = _beside(stored(of), "centre", texts_of, k).select("node", "centre", F.size("tokens").alias("n"), F.size(less).alias("less"), F.concat(more, less).alias("apart"))
    apart = stored(apart.join(classes.select("node", "weight"), "node"))
    size = apart.groupBy("centre").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum(F.size("apart")) / BLOCK_SHINGLES)).alias("blocks"))
    own, to = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = apart.join(size, "centre").withColumn("block", own).withColumn("to", to)
    dealt = dealt.select("centre", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"), "block", "node", "n", "less", "weight", "apart")
    dealt = dealt.repartition("centre", "low", "high").sortWithinPartitions("centre", "low", "high")

    def compare(batches):
        def links(group):
            block, node, n, less, weight = (np.array([r[i] for r in group], np.int64) for i in range(3, 8))
            whole = int(n[0] - len(group[0][8]) + 2 * less[0])  # the centre's shingles
            sides = [np.flatnonzero(block == x) for x in dict.fromkeys((group[0][1], group[0][2]))]
            if not all(map(len, sides)):
                return []
            left, right = sides[0], sides[-1]
            common = np.zeros((len(left), len(right)), np.int64)
            places = []
            for side in (left, right):
                token = np.concatenate([np.asarray(group[i][8], np.int64) for i in side])
                row = np.repeat(np.arange(len(side)), [len(group[i][8]) for i in side])
                order = np.argsort(token, kind="stable")
                seen, start = np.unique(token[order], return_index=True)
                places.append((seen, np.append(start, len(token)), row[order]))
            (seen, start, row), (seen2, start2, row2) = places
            both, i, j = np.intersect1d(seen, seen2, assume_unique=True, return_indices=True)
            size, size2 = start[i + 1] - start[i], start2[j + 1] - start2[j]
            one = (size == 1) & (size2 == 1)  # the usual case all at once
            np.add.at(common, (row[start[i[one]]], row2[start2[j[one]]]), 1)
            for x, y in zip(i[~one], j[~one]):
                common[np.ix_(row[start[x] : start[x + 1]], row2[start2[y] : start2[y + 1]])] += 1
            common += whole - less[left][:, None] - less[right][None, :]
            similar = (100 + percent) * common >= percent * (n[left][:, None] + n[right][None, :])
            if len(sides) == 1:
                np.fill_diagonal(similar, False)
            out = list(zip(node[left].tolist(), (similar @ weight[right]).tolist()))
            if len(sides) == 2:
                out += zip(node[right].tolist(), (weight[left] @ similar).tolist())
            return [x for x in out if x[1]]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["id", "links"])

        group, out = [], []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:-1]]
            apart = b.column(b.num_columns - 1)
            for at, r in enumerate(zip(*cols)):
                if group and group[0][:3] != r[:3]:
                    out += links(group)
                    group = []
                group.append((*r, apart[at].values.to_numpy(zero_copy_only=False)))
            if len(out) > 5_000:
                yield batch(out)
                out = []
        if group:
            out += links(group)
        yield batch(out)

    return dealt.mapInArrow(lean(compare), "id bigint, links bigint")


def _near_pivots(shared: DataFrame, texts_of, k: int, percent: int) -> DataFrame:
    """Links (a, b) of each class with the pivot that it has most shingles in common with, where they are similar."""
    least = percent * (100 - percent) / (100 + percent) / 200  # half the part of a set that similar sets of a size must share here
    best = shared.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= F.col("n") * least)
    best = stored(best.groupBy("id").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("pivot")).select(F.col("id").alias("node"), "pivot"))
    return _beside(best, "pivot", texts_of, k).where(_similar(F.col("tokens"), F.col("of_pivot"), percent)).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def _links_across(shared: DataFrame, clusters: DataFrame, texts_of, k: int, percent: int) -> DataFrame:
    """All links (a, b) between classes of different clusters, by the token-group matrix; a is no smaller than b.

    Which groups to look at: if the first shingle that two sets have in common stands at places p and q of the common
    order, they have at most min(|A| - p, |B| - q) in common, so it must stand early in both. How much a class can have
    in common with a group: if P and Q are the shingles kept of A and B, |A & B| <= |P & Q| + max(|A - P|, |B - Q|),
    as whichever of P and Q ends first in the common order holds all that both sets have up to there. A group's part of
    the matrix stands for the Q of each of its members.
    """
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    at = clusters.join(sizes, "component").select("id", "component", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / GROUP_SIZE)).alias("chunk"))
    placed = shared.drop("pivot").distinct().join(at, "id", "left").select("token", "id", "n", "at", F.coalesce("component", "id").alias("cluster"), F.coalesce("chunk", F.lit(0)).alias("chunk"))
    mixed = placed.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("token")
    placed = stored(placed.join(mixed, "token"))

    def common(size, other):
        return _at_least(percent * (size + other), 100 + percent)

    query = placed.select("token", F.col("id").alias("a"), F.col("n").alias("size"), F.col("at").alias("p"), F.col("cluster").alias("of"))
    own = _at_least(percent * F.col("size"), 100)
    other = F.greatest(F.col("least"), own)
    # places that are early enough for a partner of the same size or a larger one
    early = placed.where(F.col("at") <= F.col("n") - common(F.col("n"), F.col("n")))
    of_clusters = early.groupBy("token", "cluster").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("rest"))
    fits = (F.col("of") != F.col("cluster")) & (F.col("least") <= F.col("size")) & (F.col("most") >= own)
    fits = fits & (F.least(F.col("size") - F.col("p"), F.col("rest")) >= common(F.col("size"), other))
    near = query.where(F.col("p") <= F.col("size") - own).join(of_clusters, "token").where(fits).select("a", "cluster").distinct()
    near = stored(near)
    # a row of the matrix: which of the shingles that decide the group has
    matrix = placed.groupBy("cluster", "chunk").agg(F.collect_set("token").alias("union"), F.min("n").alias("least"), F.max("n").alias("most"))
    asked = placed.groupBy(F.col("id").alias("a")).agg(F.collect_list("token").alias("kept"), F.first("n").alias("size"))
    met = near.join(matrix, "cluster").join(asked, "a").where((F.col("least") <= F.col("size")) & (F.col("most") >= own))
    enough = F.size(F.array_intersect("kept", "union")) >= common(F.col("size"), other) - own + 1
    opened = met.where(enough).select("a", "size", "cluster", "chunk")
    inside = placed.select("cluster", "chunk", F.col("id").alias("b"), "n").distinct()
    pairs = stored(opened.join(inside, ["cluster", "chunk"]).where((F.col("n") <= F.col("size")) & (F.col("n") >= own)).select("a", "b").distinct())
    left = _sets(texts_of(pairs.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("with"))), k).select(F.col("node").alias("a"), F.explode("with").alias("b"), F.col("tokens").alias("left"))
    right = _sets(texts_of(pairs.select(F.col("b").alias("node")).distinct()), k).select(F.col("node").alias("b"), F.col("tokens").alias("right"))
    return left.join(right, "b").where(_similar(F.col("left"), F.col("right"), percent)).select("a", "b").distinct()


def keep_one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the row with the smallest doc_id stays.

    Rows whose set is empty all stay. Of rows that share id and text one stays (its other columns are those of any).
    Columns may have any names.
    """
    of_id, of_key, stays = beside(docs.columns, "id", "key", "stays")
    with workspace(docs.sparkSession) as keep:
        groups = _groups(_rows(docs, id_col, text_col), k, percent, count_links=False)
        groups = stored(groups.where("n_shingles > 0").groupBy("group", "doc_id", "key").agg(F.count("*").alias("rows")))
        chosen = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"))
        told = groups.join(few(chosen), "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("key") == F.col("one.key")))
        told = keep(told.where("not stays or rows > 1").select(F.col("doc_id").alias(of_id), F.col("key").alias(of_key), F.col("stays").alias(stays)).distinct())

    def same(t):
        return F.col(id_col).eqNullSafe(t[of_id]) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == t[of_key])

    gone, again = told.where(~F.col(stays)), told.where(F.col(stays))
    kept = docs.join(few(gone), same(gone), "left_anti")
    if again.isEmpty():
        return kept
    again = few(again)
    one = kept.join(again, same(again)).dropDuplicates([of_id, of_key]).select(*docs.columns)
    return kept.join(again, same(again), "left_anti").unionByName(one)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"), 3, 90).drop("key", "group")


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
