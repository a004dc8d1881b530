from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from weftgraph.llm.mixing import Mix, mixed, mixture

SCHEMA = "doc_id long, text string, source string, weight string, key int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA)


def rows_of(seed, n=900):
    r = random.Random(seed)
    return [(i, " ".join("w" for _ in range(r.randint(0, 30))), r.choice(["a"] * 8 + ["b", "c", None])) for i in range(n)]


def power(mass, mix):
    total = sum(mass.values())
    budget = mix.budget if mix.budget is not None else total

    def at(a):
        p = {s: (m / total) ** a for s, m in mass.items() if m}
        z = sum(p.values())
        w = {s: x / z for s, x in p.items()}
        return w, -sum(x * math.log(x) for x in w.values()), max(x * budget / mass[s] for s, x in w.items())

    def bisect(ok):
        lo, hi = 0.0, 1.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(at(mid)) else (lo, mid)
        return lo

    n = sum(m > 0 for m in mass.values())
    a = max(bisect(lambda x: x[1] >= mix.entropy * math.log(n)), bisect(lambda x: x[2] > mix.repeats))
    return at(a)[0]


@pytest.mark.parametrize("mix", [Mix(), Mix(entropy=1.0, repeats=100.0), Mix(entropy=1.0, repeats=1.5), Mix(budget=3000), Mix(budget=0)])
def test_weights_budgets_and_places(spark, mix):
    rows = rows_of(1) + [(10_000 + i, None, "empty") for i in range(3)] + [(5, "x y z", "b")] * 40 + [(None, "x y", "b")] * 2
    mass = Counter()
    for _, t, s in rows:
        mass[s] += len((t or "").split())
    weight = power(mass, mix)
    budget = mix.budget if mix.budget is not None else sum(mass.values())
    got = mixture(make(spark, rows), mix).collect()
    assert Counter((r["doc_id"], r["source"], r["tokens"]) for r in got) == Counter((d, s, len((t or "").split())) for d, t, s in rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for s, own in by.items():
        assert all(abs(r["weight"] - weight.get(s, 0.0)) < 1e-6 for r in own)
        end = 0
        for r in sorted(own, key=lambda r: (r["place"], r["tokens"])):
            assert r["place"] == end
            end += r["tokens"]
        assert end == mass[s]
        used = sum(r["copies"] * r["tokens"] for r in own)
        quota = budget * weight.get(s, 0.0)
        assert used <= quota + 1 and (used > quota - 35 or not mass[s])
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


def test_mixed_rows_are_the_copies(spark):
    docs = make(spark, rows_of(2) + [(5, "x y z", "b")] * 40)
    mix = Mix(entropy=1.0)
    want = Counter()
    for r in mixture(docs, mix).collect():
        want[r["doc_id"], r["source"], r["tokens"]] += r["copies"]
    got = mixed(docs, mix)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got.collect()) == +want


def test_one_source_and_none(spark):
    assert {r["copies"] for r in mixture(make(spark, [(i, "a b", "s") for i in range(50)])).collect()} == {1}
    assert mixture(make(spark, [])).count() == 0 and mixed(make(spark, [])).count() == 0
    assert {r["copies"] for r in mixture(make(spark, [(1, None, None), (2, "", "s")])).collect()} == {0}
