import re

import pytest

from duetframe.llm.license_scan import K, NOTICES, TEMPLATES, scan_licenses, scan_notices, window_size


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(t):
    w = words(t)
    return [tuple(w[i : i + K]) for i in range(len(w) - K + 1)]


def brute(rows, templates=TEMPLATES, percent=80):
    out = set()
    for i, t in rows:
        s = shingles(t)
        for name, text in templates.items():
            own = set(shingles(text))
            width = window_size(len(own))
            best = max(((len(own.intersection(s[a : a + width])), -a) for a in range(len(s)) if s[a] in own), default=(0, 0))
            if 100 * best[0] >= percent * len(own):
                out.add((i, name, len(own), best[0], -best[1]))
    return out


def test_equals_brute_force(spark):
    filler = "some plain words that say nothing of the kind at all "
    grant = TEMPLATES["mit-grant"].split()
    rows = [(n, filler * (n % 4) + t.upper() + " " + filler * (n % 3)) for n, t in enumerate(TEMPLATES.values())]
    rows += [
        (20, None), (21, ""), (22, "Released under"), (23, "Released under the MIT License."), (24, " ".join(grant[:24] + ["X"] + grant[24:])),
        (25, " ".join(grant[:12] + filler.split() * 9 + grant[12:])), (26, ("Licensed under CC BY-NC 4.0. " + filler) * 300), (27, filler * 2000 + TEMPLATES["gpl-3.0"]),
        (28, "licensed under the apache license version 2 1"), (29, " ".join(grant[3:])), (None, TEMPLATES["mit"]), (23, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, template string, at int")
    got = scan_licenses(df).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))
    assert scan_licenses(df.limit(0)).collect() == [] and scan_licenses(df, {}).collect() == []
    with pytest.raises(ValueError):
        scan_licenses(df, {"short": "too few"})


def test_edited_templates_are_retrieved(spark):
    """Long templates with words changed: retrieval must find every one that is still contained enough."""
    import random

    rng = random.Random(3)
    long = {f"t{i}": " ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for i in range(6)}
    rows = []
    for i in range(60):
        w = long[f"t{i % 6}"].split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(["x y z"] * rng.randrange(9) + w + ["q r s t u"] * rng.randrange(9))))
    got = {tuple(r) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), long).collect()}
    assert got == brute(rows, long) and len(got) > 40


def test_notices_of_few_words(spark):
    rows = [
        (1, "so it is.\nAll rights reserved."), (2, "ALL RIGHTS, reserved all rights reserved"), (3, "all rights are reserved; overall rights reserved"), (4, None), (5, ""),
        (6, "Licensed under the MIT License"), (7, "GPLv3 and (CC BY-NC 4.0) or CC BY 4.0"), (1, "so it is.\nAll rights reserved."), (None, "all rights reserved"), (8, "All rights reserve"),
    ]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, notice string, at int")
    want = {(1, "all-rights-reserved", 3), (2, "all-rights-reserved", 0), (6, "mit", 2), (7, "gpl-3.0", 0), (7, "cc-by-nc-4.0", 2), (7, "cc-by-4.0", 8), (None, "all-rights-reserved", 0)}
    got = scan_notices(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert scan_notices(df.limit(0)).collect() == [] and scan_notices(df, {}).collect() == []
    with pytest.raises(ValueError):
        scan_notices(df, {"none": ("...",)})


def test_every_license_line_of_the_tables_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    line = r"(?m)^(All rights reserved\.|Licensed under CC BY-NC 4\.0\.|Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\.|This work is licensed under the GNU General Public License, version 3\.)$"
    want = {r.doc_id for r in docs.where(docs.text.rlike(line)).select("doc_id").collect()}
    got = {r.doc_id for r in scan_notices(docs).collect()}
    assert len(want) > 300 and want <= got
    assert set(NOTICES) >= {"all-rights-reserved", "mit", "gpl-3.0", "apache-2.0", "cc-by-nc-4.0"}


def test_long_templates_take_time_in_proportion(spark):
    import random
    import time

    rng = random.Random(4)
    body = [f"w{rng.randrange(900)}" for _ in range(2000)]
    changed = list(body)
    for _ in range(60):
        changed[rng.randrange(2000)] = "changed"
    far = body[:1000] + ["filler"] * 900 + body[1000:]
    rows = [(1, " ".join(["x y"] * 500 + changed + ["z"] * 300)), (2, " ".join(far)), (3, " ".join(body[:1500])), (4, " ".join(body[40:60] * 900)), (5, " ".join(body * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scan_licenses(df, {"long": " ".join(body[:40])}).collect()
    began = time.time()
    got = {tuple(r) for r in scan_licenses(df, {"long": " ".join(body)}).collect()}
    assert time.time() - began < 15
    assert got == brute(rows, {"long": " ".join(body)}) and {r[0] for r in got} == {1, 5}
