from __future__ import annotations

import random
import re

from weftgraph.llm.urls import filter_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url, rules, otherwise="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if r[0] is not None and r[2] is not None and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1] or "")]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1] or ""), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + (best[1] or ""), best[2] if best else otherwise


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(got) == len(urls)


def test_cases(spark):
    urls = [None, "", "nothing", "http://", "https://Example.ORG/es/1", "http://a.b.example.org/en/1?x", "http://example.org/en/2#y", "http://notexample.org/es/", "http://org/", "http://org", "https://x.com/fr/9", "https://x.com/de/", "http://x.com?u=http://y.org/", "a\nb://q.org/\n", "http://x.com/de/"]
    check(spark, urls + ["http://" + "a." * 3000 + "org/" + "p" * 5000], RULES)
    check(spark, urls, [])
    check(spark, [], RULES)


def test_random_rules(spark):
    r = random.Random(1)
    part = lambda n: ".".join(r.choice("abc") for _ in range(r.randint(1, n)))
    rules = list({(part(3), "/" + part(2) if r.random() < 0.7 else ""): r.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(*k, v) for k, v in rules] + [(None, "/", "block"), ("a", None, "block")]
    check(spark, [f"http://{part(4)}/{part(3)}" for _ in range(500)], rules)
