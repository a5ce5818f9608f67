"""Document fingerprints from closed syncmers, matched by place, in DataFrame functions alone.

A text is a row of units: words, and in runs of more than LONGEST characters without ASCII white space every character. A
window of K units is an anchor if the smallest of its inner S-unit strings (by hash) stands at one of its two edges.
Whether it is depends on nothing outside the window, so an edit changes no anchor that it doesn't touch. The fingerprint
is the row of the anchors' hashes, so it grows with the text and tells the anchors' order. Two fingerprints are held
against each other by place: of the anchors that both have, those count that lie at a common shift.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, read, shuffle_partitions, stored

K, S = 5, 2
#: Characters of the longest run without white space that is one unit; of longer ones each character is a unit.
LONGEST = 32
#: White space of ASCII, as the inside of a character class; a class of such characters alone is a table look-up.
SPACE = r" \t-\r"
#: Shifts that differ by less than this and a part of BAND of the longer fingerprint are one.
LEAST_BAND, BAND = 4, 8
#: Rows of a bucket of neighbouring ids, about; keys sampled for each border, and for all of them.
BUCKET_ROWS, SAMPLE_PER_BUCKET, MOST_SAMPLED = 50_000, 20, 2_000_000


def let(value: Column, body) -> Column:
    """body(value), with ``value`` evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def unit_hashes(text: Column) -> Column:
    units = rf"(?<![^{SPACE}])[^{SPACE}]{{1,{LONGEST}}}(?![^{SPACE}])|[^{SPACE}]"
    return F.transform(F.regexp_extract_all(text, F.lit(units), F.lit(0)), lambda u: F.xxhash64(u))


def syncmers(text: Column) -> Column:
    """array<struct<at, hash>>: place (in units, from 0) and hash of the anchors of a text, in order.

    Of fewer than K units each is an anchor itself; a null text or one of white space has none.
    """

    def of(h: Column) -> Column:
        n = F.size(h)

        def chosen(inner: Column) -> Column:
            def at_edge(i: Column) -> Column:
                ends = F.least(inner[i], inner[i + (K - S)])
                return reduce(lambda a, b: a & b, [ends <= inner[i + j] for j in range(1, K - S)])

            starts = F.filter(F.sequence(F.lit(0), n - K), at_edge)
            return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(*(h[i + j] for j in range(K))).alias("hash")))

        pairs = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*(h[i + j] for j in range(S))))
        few_units = F.transform(h, lambda u, i: F.struct(i.alias("at"), F.xxhash64(u).alias("hash")))
        return F.when(n >= K, let(pairs, chosen)).otherwise(few_units)

    return let(unit_hashes(F.coalesce(text, F.lit(""))), of)


def fingerprint(text: Column) -> Column:
    """The hashes of a text's anchors in their order (array<bigint>), each where it is met first."""
    return F.array_distinct(F.transform(syncmers(text), lambda a: a["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share that anchors at a common shift are of all anchors of two fingerprints.

    The shift of an anchor is its place in b less its place in a. Shifts are told apart by bands; counted are the
    anchors of two bands that lie side by side, of the fullest such pair. So passages that were moved far count once for
    the place that most of them agree on, and what was put in or left out between anchors only shifts the rest a little.
    Two fingerprints without anchors are alike (1), one with and one without are not (0).
    """

    def matched(longer: Column) -> Column:
        band = F.lit(LEAST_BAND) + F.floor(longer / BAND)
        placed = F.sort_array(F.concat(F.transform(a, lambda x, i: F.struct(x.alias("h"), (-i - 1).alias("at"))), F.transform(b, lambda x, i: F.struct(x.alias("h"), i.alias("at")))))

        def bands(s: Column) -> Column:  # an anchor of both stands twice in a row, first with its place in a (as -1 - place)
            both = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: s[j]["h"] == s[j - 1]["h"])
            return F.sort_array(F.transform(both, lambda j: F.floor((s[j]["at"] + s[j - 1]["at"] + 1) / band)))

        def fullest(at: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda j: (j == 0) | (at[j] != F.try_element_at(at, F.greatest(j, F.lit(1)))))

            def most(first: Column) -> Column:
                def upto(j: Column) -> Column:
                    beside = F.get(at, F.get(first, j + 1)) == at[first[j]] + 1
                    end = F.when(beside, F.get(first, j + 2)).otherwise(F.get(first, j + 1))
                    return F.coalesce(end, F.size(at)) - first[j]

                return F.array_max(F.transform(F.sequence(F.lit(0), F.size(first) - 1), upto))

            return let(starts, most)

        return let(let(placed, bands), fullest)

    common = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b)
    return F.when(whole == 0, 1.0).when(common == 0, 0.0).otherwise(matched(F.greatest(F.size(a), F.size(b))) / (whole - common))


def as_text(prints: Column) -> Column:
    """16 hexadecimal digits for each anchor, in order."""
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _key(id_col: Column, kind: str, text: Column) -> Column:
    """A string by which rows sort: ascending id (null first), then descending by the first 16 characters, then a hash."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        own = F.lpad(F.hex(id_col.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        own = F.hex(F.encode(id_col.cast("string"), "UTF-8"))
    turned = F.translate(F.hex(F.encode(F.substring(text, 1, 16), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(F.coalesce(F.concat(F.lit("1"), own), F.lit("0")), F.lit("!"), turned, F.lit("~"), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def _bucket(borders: list[str], x: Column) -> Column:
    """How many of the sorted borders are <= x, by halving."""
    if not borders:
        return F.lit(0)
    table = F.split(F.lit(",".join(borders)), ",")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(borders)) & (F.try_element_at(table, at + s) <= x), at + s).otherwise(at))


def _borders(keys: DataFrame, buckets: int, n: int) -> list[str]:
    """Keys that cut the sorted keys into about even parts, from a sample."""
    most = max(3, min(SAMPLE_PER_BUCKET, MOST_SAMPLED // buckets)) * buckets
    got = sorted(r[0] for r in (keys if n <= most else keys.sample(False, most / n, 11)).limit(2 * most).collect())
    return sorted({got[len(got) * i // buckets] for i in range(1, buckets)}) if got else []


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, ``more`` (columns made of text) of every row and of the next: next_text and next_<more>.

    Rows stand in descending order of id (numbers by value, other types as text; null ids last; equal ids by the first
    16 characters of their texts, then by a hash); after the last comes the first. Null texts are empty ones. Rows that
    repeat are neighbours of each other; a single row is its own next one; an empty table gives an empty one; other
    columns are left out.

    The order is cut into buckets, as many as the rows need, so that no task sees all rows; the last row of each goes to
    the next one as well. Where the borders lie comes from a sample and decides only where a row is worked on; rows of
    one id are split like others. Rows that are copies in id and text share a bucket, which sorts them outside memory if
    need be.
    """
    more = more or {}
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _key(F.col(id_col), kind, text).alias("key"))
    keys = rows.select("key")
    n = keys.count()
    buckets = max(1, min(n, max(shuffle_partitions(docs.sparkSession), -(-n // BUCKET_ROWS))))
    borders = _borders(keys, buckets, n) if buckets > 1 else []
    bucket = _bucket(borders, F.col("key"))
    rows = rows.withColumn("bucket", bucket)
    tops = stored(rows.groupBy("bucket").agg(F.max("key").alias("top")))
    order = Window.orderBy("bucket")
    ends = F.first("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = few(tops.select("top", F.coalesce(F.lead("bucket").over(order), ends).alias("to")))  # a narrow row for each bucket
    guests = rows.join(after, F.col("key") == F.col("top")).groupBy(F.col("to").alias("bucket")).agg(F.max("key").alias("key"), F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast(kind).alias("doc_id"), "text", "key", "bucket", F.lit(0).alias("own"))
    dealt = rows.withColumn("own", F.lit(1)).unionByName(guests).repartitionById(len(borders) + 1, F.col("bucket"))
    row = F.struct("text", *more)
    # in ascending order the next row of the descending one has gone before
    found = dealt.withColumns(more).withColumn("next", F.lag(row).over(Window.partitionBy("bucket").orderBy("own", "key"))).where("own = 1")
    return found.select("doc_id", "text", *more, *(F.col(f"next.{c}").alias(f"next_{c}") for c in ("text", *more)))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness; see with_next and likeness."""
    found = with_next(read(spark, sf_dir, "documents"), more={"print": fingerprint(F.col("text"))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    found = found.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    found = found.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_print": fingerprint(F.col("edited"))})
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


QUERIES = {"op5_document_fingerprints": op5_document_fingerprints}
ORACLES: dict[str, str] = {}
