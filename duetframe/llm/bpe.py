"""BPE encoding and decoding through a table of distinct words.

BPE merges never cross the words that the split pattern makes, so each distinct word of the corpus is encoded once.
Its ids are then joined back to every place where the word stands. Words go to the workers as sorted arrays of hashes
and ids: all of them if they are within BROADCAST_BYTES, else the most frequent ones up to that size. Places of other
words are left open and joined by a shuffle on the word, which are few places, as these words are rare; their ids are
put in by position. Either way gives the same rows. Decoding joins ids with the file's pieces, whose number the file
bounds.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, shuffle_partitions, stored
from .tokens import codec, default_path

#: Largest table of words that is sent to every worker, in bytes of its arrays.
BROADCAST_BYTES = 96 << 20
#: Words that a worker holds as Python objects at a time.
WORDS_HELD = 250_000


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _word_hash(word: str) -> int:
    """What Spark's xxhash64 gives for the word."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8"), 42)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), np.uint64, len(words)).view(np.int64)


def word_table(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every distinct word of the texts: word, n (how often it stands there), ids (array<int>).

    Null and empty texts have no words; an empty table gives an empty one.
    """
    path = tokenizer or default_path()

    def split(batches):
        enc, seen = codec(path), Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0):
                seen.update(enc.words(text.as_py()))
                if len(seen) > WORDS_HELD:
                    yield batch()
                    seen.clear()
        yield batch()

    def encode(batches):
        enc = codec(path)
        for b in batches:
            ids = [enc.encode(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    words = _rows(docs, id_col, text_col).select("text").mapInArrow(lean(split), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(lean(encode), "word string, n bigint, ids array<int>")


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The words that stand in most places, as many as ``most`` bytes of arrays hold."""
    level = F.floor(F.log2("n") * 8).cast("int")  # an eighth of a doubling each: few, whatever the counts
    held, least = 0, None
    for r in sorted(table.groupBy(level.alias("level")).agg(F.sum(_bytes()).alias("size")).collect(), reverse=True):
        held += r.size
        if held > most:
            break
        least = r.level
    return table.where(F.lit(False) if least is None else level >= least)


def _bytes():
    """Bytes of a word in the arrays."""
    return 12 + 4 * F.size("ids")


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, the place of each word's ids, all ids. Words that share a hash with another one are left out.

    Spark sorts; the driver puts the parts behind each other.
    """

    def packed(batches):
        for b in batches:
            ids = b.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            kind = "<u2" if not len(flat) or flat.max() < 1 << 16 else "<i4"
            arrays = (b.column(0).to_numpy(), np.diff(ids.offsets.to_numpy()).astype("<i4"), flat.astype(kind))
            yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in arrays), pa.array([kind])], ["h", "n", "ids", "kind"])

    hashed = table.select(F.xxhash64("word").alias("h"), "ids")
    parts = max(1, min(64, shuffle_partitions(table.sparkSession)))
    got = hashed.repartitionByRange(parts, "h").sortWithinPartitions("h").mapInArrow(lean(packed), "h binary, n binary, ids binary, kind string").collect()
    h, n, ids = [], [], []
    for r in got:
        h.append(np.frombuffer(r.h, "<i8"))
        n.append(np.frombuffer(r.n, "<i4"))
        ids.append(np.frombuffer(r.ids, r.kind))
    if not h:
        return np.empty(0, np.int64), np.zeros(1, np.uint32), np.empty(0, "<u2")
    del got
    hashes, size, ids = np.concatenate(h), np.concatenate(n), np.concatenate(ids)
    same = hashes[1:] == hashes[:-1]
    if same.any():
        alone = ~(np.r_[False, same] | np.r_[same, False])
        hashes, size, ids = hashes[alone], size[alone], ids[np.repeat(alone, size)]
    start = np.r_[0, np.cumsum(size, dtype=np.int64)]
    return hashes, start.astype(np.uint32 if start[-1] < 2**32 else np.int64), ids


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every row, as the tokenizer file's library gives them without extra tokens.

    decoded: also text, what decode_documents makes of the ids, by the same workers.
    Null and empty texts have an empty array; rows that repeat and null ids stay rows; texts of any length are encoded
    whole; an empty table gives an empty one; other columns are left out.
    """
    path = tokenizer or default_path()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    table = stored(word_table(docs, path, id_col, text_col))
    size = table.agg(F.sum(_bytes())).first()[0] or 0
    arrays = _arrays(table if size <= broadcast_bytes else _frequent(table, broadcast_bytes))
    whole = len(arrays[0]) == table.count()
    sent = spark.sparkContext.broadcast(arrays)
    del arrays

    def encode(batches):
        """doc_id, ids, and text or, where words are missing, the row's name, the places of these and the words."""
        enc, known = codec(path), {}  # known: each word's ids as bytes
        hashes, start, ids = sent.value
        for b in batches:
            for part in (b.slice(i, 250) for i in range(0, b.num_rows, 250)):
                out, names, places, rare = [], [], [], []
                for text in part.column(1):
                    words = enc.words(text.as_py())
                    new = list(set(words).difference(known))
                    h = _hashes(new)
                    at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                    there = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                    known.update((w, ids[x:y].tobytes() if k else None) for w, x, y, k in zip(new, start[at].tolist(), start[at + 1 - (not len(hashes))].tolist(), there.tolist()))
                    got = [known[w] for w in words]
                    if None in got:
                        open_at = [i for i, g in enumerate(got) if g is None]
                        length = np.cumsum([0, *(len(g) // ids.itemsize if g is not None else 0 for g in got)])
                        places.append(length[open_at].tolist())
                        rare.append([words[i] for i in open_at])
                        got = [g for g in got if g is not None]
                    else:
                        places.append([])
                        rare.append([])
                    names.append(uuid.uuid4().bytes if rare[-1] else None)
                    out.append(np.frombuffer(b"".join(got), ids.dtype).astype(np.int32))
                    if len(known) > WORDS_HELD:
                        known.clear()
                ends = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))]
                if not whole:
                    cols += [pa.array(names, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(rare, pa.list_(pa.string()))]
                elif decoded:
                    cols.append(_decoded(enc, [x.tolist() for x in out]))
                yield pa.RecordBatch.from_arrays(cols, (["doc_id", "ids", "text"] if whole else ["doc_id", "ids", "row", "places", "rare"])[: len(cols)])

    rows = _rows(docs, id_col, text_col)
    if whole:
        return rows.mapInArrow(lean(encode), f"doc_id {kind}, ids array<int>" + ", text string" * decoded)
    # stored, as a row's name is made once
    begun = stored(rows.mapInArrow(lean(encode), f"doc_id {kind}, ids array<int>, row binary, places array<int>, rare array<string>"))
    encoded = _with_rare(begun, table)
    return decode_documents(encoded, path) if decoded else encoded


def _with_rare(begun: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id and ids, with the ids of rare words put in where they belong."""
    asked = begun.where("row is not null").select("row", F.posexplode("rare").alias("pos", "word")).join(table.select("word", F.col("ids").alias("own")), "word")
    lists = asked.groupBy(F.col("row").alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"]).alias("found"))
    open_rows = begun.where("row is not null").join(lists, F.col("row") == F.col("of")).select("doc_id", "ids", "places", "found")

    def fill(batches):
        for b in batches:
            out = []
            for ids, places, found in zip(*(b.column(c) for c in ("ids", "places", "found"))):
                ids, places, found = (x.as_py() for x in (ids, places, found))
                made, at = [], 0
                for place, own in zip(places, found):
                    made += ids[at:place]
                    made += own
                    at = place
                out.append(made + ids[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = begun.schema["doc_id"].dataType.simpleString()
    return begun.where("row is null").select("doc_id", "ids").unionByName(open_rows.mapInArrow(lean(fill), f"doc_id {kind}, ids array<int>"))


def _decoded(enc, ids: list) -> pa.Array:
    pieces = enc.pieces
    try:
        texts = [b"".join(map(pieces.__getitem__, x or ())) for x in ids]
    except (IndexError, TypeError):
        texts = [b"".join(pieces[i] for i in x or () if i is not None and 0 <= i < len(pieces)) for x in ids]
    return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


def decode_documents(encoded: DataFrame, tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """Adds text: the pieces of the ids put together and read as UTF-8 (what isn't UTF-8 becomes U+FFFD).

    A null array and an empty one give an empty text; an id that the file lacks gives nothing.
    """
    path = tokenizer or default_path()
    schema = encoded.select(*keep).schema

    def decode(batches):
        enc = codec(path)
        for b in batches:
            yield b.append_column("text", _decoded(enc, b.column(b.schema.get_field_index("ids")).to_pylist()))

    return encoded.select(*keep).mapInArrow(lean(decode), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", text string")


def op7_bpe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = encode_documents(read(spark, sf_dir, "documents"), decoded=True)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe_tables": op7_bpe_tables}
ORACLES: dict[str, str] = {}
