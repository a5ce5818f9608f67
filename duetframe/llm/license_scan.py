"""License scans in DataFrame functions alone: MinHash bands over overlapping text windows, then exact containment.

A template is the set of its K-word shingles. A match is a run of shingle places, a quarter longer than the template,
that holds PERCENT percent of it. Texts are looked at through windows half as long again as such a run, of which one
begins after each half of a run, so every match lies in one whole. Each of BANDS hash functions is a band of one row: a
window retrieves a template if for one of them the smallest hash is the same. A window that holds a match has a Jaccard
similarity of 0.38 or more with the template, so a match is missed with probability 2 in ten million at most. A band can
agree only in windows that hold the shingle with the template's smallest hash, so only windows round such shingles are
hashed. In what they retrieve the shingles of the template are counted exactly, by a running sum over the places where
windows gain and lose one.

Notices of few words have too few shingles for that: scan_notices finds them as whole sequences of words, each in the
forms that it is written in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, read

K = 5
PERCENT = 80
BANDS = 32
#: Notices as they stand in files and on pages.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced without written permission.",
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-3-clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND "
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
}
#: Notices of few words, by license, in the forms they are written in.
NOTICES = {
    "all-rights-reserved": ("All rights reserved",),
    "apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License", "License-Identifier: Apache-2.0"),
    "mit": ("the MIT License", "an MIT License", "MIT licensed", "License: MIT", "License-Identifier: MIT"),
    "gpl-3.0": ("General Public License version 3", "General Public License v3", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL-3.0"),
    "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "bsd-3-clause": ("BSD 3-Clause", "3-Clause BSD", "License-Identifier: BSD-3-Clause"),
    "mpl-2.0": ("Mozilla Public License v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
}
_WORD = r"[\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value), with ``value`` evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """array<bigint>: hashes of the K-word shingles in order; words are runs of letters and digits, A-Z lower-cased."""
    words = F.transform(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))
    made = lambda w: F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*(w[i + j] for j in range(K))))).otherwise(F.array().cast("array<bigint>"))
    return let(words, made)


def _lowest_of(hashes: Column, band: int) -> Column:
    """The shingle with the smallest hash of a band."""
    return F.array_min(F.transform(hashes, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("h"), x.alias("x"))))["x"]


def window_size(shingles: int) -> int:
    return shingles + shingles // 4


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, template, n_template (its shingles), n_found and at, a row for each template that a row of docs holds.

    A template is held if some window (window_size(n_template) shingle places, from a template's shingle on) has at
    least ``percent`` percent of its distinct shingles; n_found is the most that one has, at the place (in words, from
    0) where the first such window begins. Null, empty and short texts hold nothing; rows with the same id and text give
    one row; an empty table gives none; a template of fewer than K words is refused; other columns are left out. Texts
    and templates of any length are compared whole, in time proportional to the text for each template found in it.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    table = spark.createDataFrame(list(templates.items()) or [("", "")], "template string, text string").select("template", F.array_distinct(shingle_hashes(F.col("text"))).alias("own"))
    mins = [_lowest_of(F.col("own"), b) for b in range(BANDS)]
    known = table.select("template", "own", F.array(*mins).alias("lowest")).collect() if templates else []  # as many as were given
    if any(not r.own for r in known):
        raise ValueError(f"templates of fewer than {K} words: {[r.template for r in known if not r.own]}")
    kind = docs.schema[id_col].dataType.simpleString()
    if not known:
        return spark.createDataFrame([], f"doc_id {kind}, template string, n_template int, n_found int, at int")
    rows = []
    for number, r in enumerate(known):
        bands = [{"x": x, "bands": [b for b in range(BANDS) if r.lowest[b] == x]} for x in sorted(set(r.lowest))]
        rows.append((number, r.template, r.own, window_size(len(r.own)), bands))
    shape = "number int, template string, own array<bigint>, width int, lowest array<struct<x: bigint, bands: array<int>>>"
    index = F.broadcast(spark.createDataFrame(rows, shape))  # as many rows as templates were given
    of_lowest: dict[int, list[int]] = {}
    for number, *_, bands in rows:
        for b in bands:
            of_lowest.setdefault(b["x"], []).append(number)
    which = F.create_map(*(c for shingle, numbers in of_lowest.items() for c in (F.lit(shingle).cast("bigint"), F.array(*map(F.lit, numbers)))))

    # the templates of which a text has the lowest shingle in some band
    def candidates(h: Column) -> Column:
        met = F.array_distinct(F.filter(h, lambda x: x.isin(list(of_lowest))))
        return F.struct(h.alias("h"), F.array_distinct(F.flatten(F.transform(met, lambda x: F.element_at(which, x)))).alias("numbers"))

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), let(shingle_hashes(F.col(text_col)), candidates).alias("c")).where(F.size("c.numbers") > 0)
    found = found.select("doc_id", "key", F.col("c.h").alias("h"), F.explode("c.numbers").alias("number")).join(index, "number")
    step = F.greatest(F.lit(1), F.floor(F.col("width") / 2).cast("int"))
    span = F.col("width") + step

    def agrees(low: Column) -> Column:
        """Whether one of the bands of a lowest shingle has it for its minimum in a window."""

        def window(j: Column) -> Column:
            inside = F.slice("h", j * step + 1, span)
            return F.exists(low["bands"], lambda b: F.forall(inside, lambda y: F.xxhash64(y, b) >= F.xxhash64(low["x"], b)))

        def round_it(i: Column) -> Column:
            first = F.greatest(F.lit(0), F.ceil((i - span + 1) / step).cast("int"))
            return F.exists(F.sequence(first, F.floor(i / step).cast("int")), window)

        return F.exists(F.filter(F.transform("h", lambda x, i: F.when(x == low["x"], i)), lambda i: i.isNotNull()), round_it)

    retrieved = found.where(F.exists("lowest", agrees))
    hits = retrieved.select("doc_id", "key", "template", F.size("own").alias("n"), "width", "own", F.posexplode("h").alias("pos", "shingle")).where(F.array_contains("own", F.col("shingle"))).drop("own")
    of = ("doc_id", "key", "template", "n")
    before = F.coalesce(F.lag("pos").over(Window.partitionBy(*of, "shingle").orderBy("pos")), F.lit(-1))
    # a hit is new to the runs that begin after the same shingle's last place and reach up to it
    hits = hits.withColumn("before", before)
    gain = F.struct(F.greatest(F.col("before") + 1, F.col("pos") - F.col("width") + 1, F.lit(0)).alias("at"), F.lit(1).alias("change"), F.lit(False).alias("start"))
    lose = F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("change"), F.lit(False).alias("start"))
    start = F.struct(F.col("pos").alias("at"), F.lit(0).alias("change"), F.lit(True).alias("start"))
    events = hits.select(*of, F.explode(F.array(gain, lose, start)).alias("e")).select(*of, "e.*")
    running = F.sum("change").over(Window.partitionBy(*of).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    runs = events.withColumn("n_found", running).where(F.col("start") & (100 * F.col("n_found") >= percent * F.col("n")))
    best = runs.groupBy(*of).agg(F.max(F.struct("n_found", (-F.col("at")).alias("before"))).alias("m"))
    return best.select("doc_id", "template", F.col("n").alias("n_template"), F.col("m.n_found").cast("int").alias("n_found"), (-F.col("m.before")).cast("int").alias("at"))


def _words_between_spaces(text: Column) -> Column:
    words = F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def scan_notices(docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, notice and at, a row for each notice that a row of docs holds; at is where (in words, from 0) it first does.

    A notice is held if the words of one of its forms follow each other in the text; words are those of scan_licenses.
    Null and empty texts hold nothing; rows with the same id and text give one row; a form without words is refused;
    other columns are left out.
    """
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    kind = docs.schema[id_col].dataType.simpleString()
    if not notices:
        return spark.createDataFrame([], f"doc_id {kind}, notice string, at int")
    forms = spark.createDataFrame([(name, form) for name, of in notices.items() for form in of], "notice string, form string")
    known = forms.select("notice", _words_between_spaces(F.col("form")).alias("form")).collect()  # as many as were given
    if any(not r.form.strip() for r in known):
        raise ValueError(f"notices without words: {[r.notice for r in known if not r.form.strip()]}")

    def held(s: Column) -> Column:
        def first(name: str) -> Column:
            places = F.array(*(F.instr(s, r.form) for r in known if r.notice == name))
            return F.array_min(F.filter(places, lambda p: p > 0))

        def at(p: Column) -> Column:
            before = F.substring(s, F.lit(1), p - 1)
            return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).cast("int")

        found = F.array(*(F.struct(F.lit(name).alias("notice"), first(name).alias("p")) for name in notices))
        return F.transform(F.filter(found, lambda x: x["p"].isNotNull()), lambda x: F.struct(x["notice"].alias("notice"), at(x["p"]).alias("at")))

    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), let(_words_between_spaces(F.col(text_col)), held).alias("held"))
    found = found.where(F.size("held") > 0).select("doc_id", "key", F.explode("held").alias("h")).select("doc_id", "key", "h.notice", "h.at")
    return found.distinct().select("doc_id", "notice", "at")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_notices(read(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = f"list_transform(range(0, len(w) - {K - 1}), lambda i: array_to_string(w[i + 1:i + {K}], ' '))"
ORACLE = f"""
WITH t(template, words) AS (SELECT a, regexp_extract_all({_LOWER.format('b')}, '{_WORD}') FROM (VALUES {_TEMPLATE_ROWS}) v(a, b)),
ts AS (SELECT template, list_distinct({_SHINGLES}) AS own FROM (SELECT template, words AS w FROM t)),
te AS (SELECT template, len(own) AS n, unnest(own) AS sh FROM ts),
d AS (SELECT DISTINCT doc_id, text FROM documents),
dw AS (SELECT doc_id, hash(text) AS k, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM d),
ds AS (SELECT doc_id, k, unnest({_SHINGLES}) AS sh, unnest(range(0, len(w) - {K - 1})) AS pos FROM dw WHERE len(w) >= {K}),
hit AS (SELECT doc_id, k, template, n, sh, pos FROM ds JOIN te USING (sh)),
win AS (SELECT a.doc_id, a.k, a.template, a.n, a.pos, count(DISTINCT b.sh) AS c FROM hit a JOIN hit b
  ON a.doc_id = b.doc_id AND a.k = b.k AND a.template = b.template AND b.pos >= a.pos AND b.pos < a.pos + a.n + a.n // 4
  GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, template ORDER BY c DESC, pos) AS r FROM win WHERE 100 * c >= {PERCENT} * n)
SELECT doc_id, template, CAST(n AS INT) AS n_template, CAST(c AS INT) AS n_found, CAST(pos AS INT) AS "at" FROM best WHERE r = 1
"""
_NOTICE_ROWS = ", ".join(f"('{name}', '{form}')" for name, forms in NOTICES.items() for form in forms)
_SPACED = "' ' || array_to_string(regexp_extract_all(" + _LOWER + ", '" + _WORD.replace("{", "{{").replace("}", "}}") + "'), ' ') || ' '"
NOTICES_ORACLE = f"""
WITH f(notice, form) AS (SELECT a, {_SPACED.format('b')} FROM (VALUES {_NOTICE_ROWS}) v(a, b)),
d AS (SELECT DISTINCT doc_id, text FROM documents),
s AS (SELECT doc_id, hash(text) AS k, {_SPACED.format("coalesce(text, '')")} AS s FROM d),
p AS (SELECT doc_id, k, notice, s, min(instr(s, form)) AS p FROM s JOIN f ON contains(s, form) GROUP BY ALL)
SELECT doc_id, notice, CAST(length(substr(s, 1, p - 1)) - length(replace(substr(s, 1, p - 1), ' ', '')) AS INT) AS "at" FROM p
"""
QUERIES = {"op3_license_scan": op3_license_scan, "op3_license_notices": op3_license_notices}
ORACLES = {"op3_license_scan": ORACLE, "op3_license_notices": NOTICES_ORACLE}
