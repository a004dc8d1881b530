from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa

from weftgraph.llm import neardup
from weftgraph.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, node string, key int"


def got(spark, rows):
    found = neardup.near_duplicates(spark.createDataFrame([(d, t, "n", 1) for d, t in rows], SCHEMA)).collect()
    return [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found]


def varied(seed, groups, most, length):
    r, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    shared = r.choices(words, k=length)
    for _ in range(groups):
        base = r.choices(words, k=length) + (shared if r.random() < 0.3 else [])
        for _ in range(r.randint(1, most)):
            copy = list(base)
            for _ in range(r.randint(0, length // 25)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_same_as_brute_force(spark):
    rows = varied(1, 60, 12, 120)
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t\n", "one", "ONE", "a b c d", "a b c d e", "É é", "é É", "x\x1fy z", "w " * 50_000])]
    want = brute.near_duplicates(rows)
    assert {d: x for d, *x in got(spark, rows)} == {d: list(x) for d, x in want.items()}


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", 0)
    rows = varied(2, 12, 80, 60)
    want = brute.near_duplicates(rows)
    assert {d: x for d, *x in got(spark, rows)} == {d: list(x) for d, x in want.items()}


def test_repeats_nulls_and_nothing(spark):
    text = "a b c d e f g h"
    assert sorted(got(spark, [(3, text), (3, text), (2, text), (2, "other words here"), (None, None)]), key=repr) == sorted(
        [(3, 4, 2, False), (3, 4, 2, False), (2, 4, 2, True), (2, 1, 2, True), (None, 0, None, True)], key=repr
    )
    assert got(spark, []) == []
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, near), (None, near + " x"), (None, near + " x y"), (None, text)] * 3
    assert sorted(got(spark, rows), key=repr) == sorted([(None, n, None, True) for n in (56, 57, 58, 4)] * 3, key=repr)
    assert {x[0]: x[2:] for x in got(spark, [(None, near), (8, near + " x"), (9, near + " x y")])} == {None: (8, False), 8: (8, True), 9: (8, False)}


def test_pigeonhole():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**32, (300, neardup.SYMBOLS), dtype=np.uint32)
    b = a.copy()
    for row in b:
        row[r.choice(neardup.SYMBOLS, neardup.MOST, replace=False)] ^= 1
    x, y = neardup.bucket_keys(a), neardup.bucket_keys(b)
    assert (x == y).any(axis=1).all()


def test_kernel_on_texts():
    texts = ["A b C d e F", None, "", "à là où ça  va bien", "x" * 100, "a b c"]
    s, o = shingle_sets(pa.array(texts))
    assert np.diff(o).tolist() == [len(brute.shingle_set(t)) for t in texts]
