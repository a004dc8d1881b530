from __future__ import annotations

import numpy as np

from weftgraph.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    good = [(i, np.array(e, np.float32).astype(float)) for i, e in rows if i is not None and e and not any(x is None or not np.isfinite(x) for x in e) and any(e)]
    out = []
    for r, (q, e) in enumerate(good):
        if q % 100 == 0:
            d = sorted((float(np.sqrt(np.cumsum((e - v) ** 2)[-1])), i) for o, (i, v) in enumerate(good) if o != r and len(v) == len(e))
            out += [(q, n, i, s) for n, (s, i) in enumerate(d[:k], 1)]
    return sorted(out)


def rows_of(n, dim, seed):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(r.integers(-3, 4, (n, dim)) / 2)]


def got(spark, rows, **kw):
    found = neighbours.nearest(spark.createDataFrame([(i, e, "s") for i, e in rows], SCHEMA), **kw)
    return sorted(map(tuple, found.collect()))


def test_exact_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 300)
    rows = rows_of(900, 6, 1) + rows_of(5, 3, 2)
    bad = [(None, [1.0] * 6), (1000, None), (1100, []), (1200, [0.0] * 6), (1300, [float("nan")] + [1.0] * 5), (1400, [None] + [1.0] * 5), (1500, [float("inf")] + [1.0] * 5)]
    rows += bad + [rows[3]] * 50 + [rows[200]] * 3
    assert got(spark, rows) == brute(rows, 10)


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(100, [0.0, 1.0]), (1, [0.1, 1.1]), (1, [0.5, 1.5]), (100, [2.0, 2.0]), (100, [2.0, 2.0])]
    found = got(spark, rows)
    assert found == brute(rows, 10) and len(found) == 12
    assert [(v, round(s, 3)) for q, r, v, s in found if q == 100 and r <= 2][:1] == [(1, 0.141)]
    assert (100, 1, 100, 0.0) in found


def test_fewer_than_k_and_none(spark):
    rows = rows_of(4, 5, 3)
    assert got(spark, rows) == brute(rows, 10)
    assert got(spark, []) == []


def test_relaxed_recall(spark):
    rows = rows_of(3000, 4, 5)
    exact, found = brute(rows, 10), got(spark, rows, factor=1.2)
    near = {q: max(s for a, _, _, s in exact if a == q) for q in {x[0] for x in exact}}
    assert sum(s <= near[q] for q, _, _, s in found) >= 0.9 * len(exact)


def test_recall_by_factor_in_64_dimensions(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    asked = np.flatnonzero(ids % 100 == 0)
    whole = neighbours.distances(x[asked], x)
    whole[np.arange(len(asked)), asked] = np.inf
    kth = np.sort(whole, axis=1)[:, 9]
    for factor, least in ((1.0, 1.0), (1.5, 0.9), (2.0, 0.0), (3.0, 0.0), (5.0, 0.0)):
        tree = neighbours.Tree(ids, np.arange(len(ids)), x)
        d, _ = tree.search(asked, x[asked], 10, factor)
        recall = (d <= kth[:, None]).mean()
        print("factor", factor, "recall", recall, "distances", tree.compared / whole.size)
        assert recall >= least
