import random
import re

from duetframe.llm.url_filters import RULES, judge_urls


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), v)
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return host, path, best and best[1], best[2] if best else default


ODD = [None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://a.Example.org/es/x?y#z", "https://example.org/en/1", "http://notexample.org/es/", "x://y://z", "http://org/", "http://.org/a", "http://a..org/b", "http://example.org:80/es/", "http://É.org/ü", "http://example.com/fr/" + "a" * 50000, "http://h?x=://", "http://com/de/x\ny"]


def rows_of(df):
    return sorted(((r.page_id is None, r.page_id or 0), r.host, r.path, r.rule or "", r.verdict) for r in df.collect())


def test_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "org", "x.com", "com", "y.x.com", "net"]
    rules = RULES + [(rng.choice(hosts), "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(3))), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = ODD + [f"http://{rng.choice(['', 'm.', 'www.m.'])}{rng.choice(hosts)}/{'/'.join(rng.choice('abc') for _ in range(rng.randrange(4)))}" for _ in range(300)]
    urls += ["http://hot.example.org/a/b"] * 400  # one host fills several slots
    rows = [(i if i % 50 else None, u) for i, u in enumerate(urls)] + [(3, ODD[5]), (3, ODD[5])]
    df = spark.createDataFrame([(i, u, "k", "s") for i, u in rows], "page_id long, url string, key string, slot string").repartition(5)
    want = sorted(((i is None, i or 0), *(x or "" if k == 2 else x for k, x in enumerate(brute(u, rules)))) for i, u in rows)
    for slots in (1, 3, 16):
        assert rows_of(judge_urls(df, rules, slots=slots)) == want
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert rows_of(judge_urls(df, table, slots=4)) == want
    assert judge_urls(df.limit(0), rules).collect() == []
    assert {r.verdict for r in judge_urls(df, [], default="block").collect()} == {"block"}
