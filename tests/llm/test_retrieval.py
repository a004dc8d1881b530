from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from weftgraph.llm import retrieval

SCHEMA = "doc_id long, text string, score string, term int"


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, k=10):
    tf = [(d, Counter(words(t)), len(words(t))) for d, t in rows]
    n, average = len(tf), sum(x[2] for x in tf) / max(1, len(tf))
    df = Counter(w for _, c, _ in tf for w in c)
    asked = {}
    for d, t in rows:
        if d is not None and d % 100 == 0 and t is not None:
            asked[d] = min(t, asked.get(d, t))
    out = []
    for q, text in asked.items():
        scores = []
        for d, c, length in tf:
            s = sum(round(1e6 * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / average)))) for w in set(words(text)) if w in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(q, r, d, -s / 1e6) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(spark, rows):
    return sorted(map(tuple, retrieval.search(spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)).collect()))


def rows_of(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    weights = [1 / (i + 1) for i in range(800)]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("docs", [16_384, 900, 40])
def test_same_as_brute_force(spark, monkeypatch, docs):
    monkeypatch.setattr(retrieval, "SHARD_DOCS", docs)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    rows = rows_of(1, 1500)
    rows += [(2000, None), (2100, ""), (2200, "!?"), (2300, "É é Ü-ü W1 W2"), (None, "w1 w2 w3"), (None, None), (2400, "w5 " * 70_000)] + [(300, rows[300][1])] * 15
    assert got(spark, rows) == brute(rows)


def test_none(spark):
    assert got(spark, []) == [] and got(spark, [(1, "a"), (2, "a b")]) == [] and got(spark, [(None, "a")]) == []
    assert got(spark, [(100, "a b"), (2, "a")]) == brute([(100, "a b"), (2, "a")])
