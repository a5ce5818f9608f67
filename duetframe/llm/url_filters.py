"""URL filters by a sort-merge range join.

A host turned round label by label and closed by a dot (``www.example.org`` -> ``org.example.www.``) makes "this host
and its subdomains" a prefix, and a prefix an interval of the sorted keys. Intervals of prefixes nest or are disjoint,
so one sweep over rules and urls in key order needs no more than a stack of the rules that are open at the moment.

Urls are dealt to slots that are ranges of the key; a range that one host fills is split into several salted slots.
A rule goes to every slot its interval meets. Slot borders come from a sample of keys of bounded size and decide only
where a row is worked on, never what becomes of it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, lower_ascii, read, shuffle_partitions

#: (host, path prefix, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT_VERDICT = "allow"
#: Keys sampled for each slot; the sample is this times the number of slots.
SAMPLE_PER_SLOT = 40


def host_of(url):
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url):
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _borders(keys: DataFrame, slots: int) -> Counter:
    """At most slots - 1 keys that cut the sorted keys into even parts; how often each was chosen."""
    n = keys.count()
    share = min(1.0, 2.0 * SAMPLE_PER_SLOT * slots / max(1, n))
    got = sorted(r[0] for r in (keys if share >= 1 else keys.sample(False, share, 17)).limit(4 * SAMPLE_PER_SLOT * slots).collect())
    return Counter(got[len(got) * i // slots] for i in range(1, slots)) if got else Counter()


def judge_urls(urls: DataFrame, rules: DataFrame | list, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, slots: int | None = None) -> DataFrame:
    """Verdict of the longest fitting rule for every row.

    rules: rows (host, path, verdict), a list or a DataFrame; a rule fits its host and all its subdomains where the
    path starts with the rule's. Of the fitting rules the one with the longest host + path wins, of equally long ones
    that with the longer host. A rule given twice counts once; of two verdicts the alphabetically last (block) holds.

    Returns id_col, host, path, rule (host + path of the rule; null if none fits) and verdict (``default`` if none
    fits). Null urls and urls without ``://`` have an empty host and path and fit no rule; repeated rows are judged
    each; other columns are left out, so their names can't clash; an empty table gives an empty table. Urls of any length
    are judged whole. An id column that is called like a column of the result is a ValueError.
    """
    if id_col in ("host", "path", "rule", "verdict"):
        raise ValueError(f"an id column called {id_col} can't stand beside the result's")
    spark = urls.sparkSession
    slots = slots or max(1, shuffle_partitions(spark))
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules or [("", "", "")], "host string, path string, verdict string").where("host <> ''")
    rules = rules.groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    url = F.col(url_col)
    keyed = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).select(
        "id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    )
    keyed = keyed.withColumns({"key": host_key(F.col("host")), "salt": F.abs(F.xxhash64("id", "path") % 1_000_003)})
    borders = _borders(keyed.select("key"), slots)
    cuts = sorted(borders)
    width = [1] + [borders[c] for c in cuts]
    first = [sum(width[:i]) for i in range(len(width))]

    def deal_urls(batches):
        for b in batches:
            j = [bisect_right(cuts, k) for k in b.column("key").to_pylist()]
            slot = [first[i] + s % width[i] for i, s in zip(j, b.column("salt").to_pylist())]
            yield b.append_column("slot", pa.array(slot, pa.int32()))

    def deal_rules(batches):
        for b in batches:
            keys = b.column("key").to_pylist()
            spans = [(first[x], first[y] + width[y]) for x, y in ((bisect_right(cuts, k), bisect_left(cuts, k[:-1] + "/")) for k in keys)]  # "/" follows "."
            rows = [i for i, (x, y) in enumerate(spans) for _ in range(x, y)]
            yield b.take(pa.array(rows, pa.int64())).append_column("slot", pa.array([n for x, y in spans for n in range(x, y)], pa.int32()))

    kind = keyed.schema["id"].dataType.simpleString()
    dealt = keyed.mapInArrow(lean(deal_urls), f"id {kind}, host string, path string, key string, salt bigint, slot int").selectExpr("slot", "key", "1 as kind", "id", "host", "path", "cast(null as string) as verdict")
    meant = rules.select("host", "path", "verdict", host_key(F.col("host")).alias("key"))
    meant = meant.mapInArrow(lean(deal_rules), "host string, path string, verdict string, key string, slot int").selectExpr("slot", "key", "0 as kind", f"cast(null as {kind}) as id", "host", "path", "verdict")
    sorted_rows = dealt.unionByName(meant).repartitionById(sum(width), F.col("slot")).sortWithinPartitions("key", "kind", "path").drop("slot")

    def sweep(batches):
        opened: list[tuple[str, str, dict, list]] = []  # key, host, {path: verdict}, path lengths of the open rules; outermost first
        for b in batches:
            keep, rule_of, verdict_of = [], [], []
            cols = [b.column(c).to_pylist() for c in ("key", "kind", "host", "path", "verdict")]
            for row, (key, is_url, host, path, verdict) in enumerate(zip(*cols)):
                while opened and not key.startswith(opened[-1][0]):
                    opened.pop()
                if not is_url:
                    if not opened or opened[-1][0] != key:
                        opened.append((key, host, {}, []))
                    opened[-1][2][path] = verdict
                    if len(path) not in opened[-1][3]:
                        opened[-1][3].append(len(path))
                        opened[-1][3].sort(reverse=True)
                    continue
                best = (-1, None, default)
                for _, rule_host, paths, lengths in opened:
                    start = next((path[:n] for n in lengths if n <= len(path) and path[:n] in paths), None)
                    if start is not None and len(rule_host) + len(start) >= best[0]:
                        best = (len(rule_host) + len(start), rule_host + start, paths[start])
                keep.append(row)
                rule_of.append(best[1])
                verdict_of.append(best[2])
            t = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("host"), t.column("path"), pa.array(rule_of, pa.string()), pa.array(verdict_of, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return sorted_rows.mapInArrow(lean(sweep), f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), RULES)


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, row_number() OVER () AS n,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT n, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
  FROM v JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, '{DEFAULT_VERDICT}') AS verdict
FROM v LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (n)
"""
QUERIES = {"op1_url_filters": op1_url_filters}
ORACLES = {"op1_url_filters": ORACLE}
