"""Queries of the directed graph of parts, against brute force on a small table."""

from __future__ import annotations

import tracemalloc
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import traversal
from weftgraph.plans import graph


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a lineitem of few orders, and its graph by plain Python."""
    folder = str(tmp_path_factory.mktemp("whole"))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey % 7 = 1").withColumn("l_partkey", F.expr("l_partkey % 150 + if(l_orderkey % 2 = 0, 1000, 0)"))
    lines = lines.orderBy("l_orderkey", "l_linenumber").limit(240)
    lines.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect():
        orders[r["l_orderkey"]].append((r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"]))
    pairs = set()
    for rows in orders.values():
        parts = [r[1] for r in sorted(rows)]
        pairs |= {(a, b) for a, b in zip(parts, parts[1:], strict=False) if a != b}
    return folder, pairs


def reached(pairs, start):
    """vertex -> distance."""
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    found, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for b in after[a] - found.keys():
            found[b] = found[a] + 1
            todo.append(b)
    return found


def ask(spark, small, name):
    return sorted(map(tuple, graph.QUERIES[name](spark, small[0]).collect()))


def test_every_line_takes_part(spark, small):
    assert sorted(map(tuple, graph.parts(spark, small[0]).collect())) == sorted(small[1])


def test_components(spark, small):
    ids = {x for p in small[1] for x in p}
    near = small[1] | {(b, a) for a, b in small[1]}
    assert ask(spark, small, "g12_components") == sorted((x, min(reached(near, x))) for x in ids)
    to = {x: set(reached(small[1], x)) for x in ids}
    strong = {x: min(y for y in to[x] if x in to[y]) for x in ids}
    assert ask(spark, small, "g13_strong_components") == sorted(strong.items())
    size = defaultdict(int)
    for c in strong.values():
        size[c] += 1
    s = min(size, key=lambda c: (-size[c], c))
    weak = set(reached(near, s))
    part = {x: "core" if x in to[s] and s in to[x] else "in" if s in to[x] else "out" if x in to[s] else "tendril" if x in weak else "other" for x in ids}
    assert ask(spark, small, "g20_bow_tie") == sorted(part.items())


def test_core(spark, small):
    left = {(min(p), max(p)) for p in small[1]}
    while True:
        degree = defaultdict(int)
        for p in left:
            for x in p:
                degree[x] += 1
        after = {p for p in left if all(degree[x] >= 3 for x in p)}
        if after == left:
            break
        left = after
    assert ask(spark, small, "g16_core") == sorted(left)


def test_distances(spark, small):
    pairs = small[1]
    assert ask(spark, small, "g10_bfs") == sorted(reached(pairs, min(a for a, _ in pairs)).items())
    n = Counter(d for x in {x for p in pairs for x in p} for d in reached(pairs, x).values() if d)
    # Farther than the steps of the filtered queries.
    assert max(n) > 8 and ask(spark, small, "g11_path_lengths") == sorted(n.items())


def test_path_lengths_of_many_blocks(spark):
    ring = [(i, (i + 1) % 1500) for i in range(1500)] + [(i, (i + 3) % 1500) for i in range(0, 1500, 2)] + [(7, 7)]
    e = spark.createDataFrame(ring, "src long, dst long")
    ids = spark.createDataFrame([(i,) for i in [*range(1500), 5, 9999]], "id long").coalesce(1)
    n = Counter(d for x in range(1500) for d in reached(set(ring), x).values() if 0 < d <= 4)
    assert sorted(map(tuple, traversal.path_lengths(e, ids, 4).collect())) == sorted(n.items())
    assert traversal.path_lengths(e.limit(0), ids).count() == 0


@pytest.fixture(scope="module")
def mixed():
    """A hub of 700 in-neighbours, small components, a long way and a repeated edge."""
    hub = [(i, 5000) for i in range(700)] + [(5000, i) for i in range(0, 700, 90)] + [(5000, 5000), (3, 5000)]
    return hub + [(10_000 + 3 * i, 10_001 + 3 * i) for i in range(400)] + [(20_000 + i, 20_001 + i) for i in range(9)]


def test_path_lengths_in_tasks_and_in_tables(spark, mixed, monkeypatch):
    pairs = {(a, b) for a, b in mixed if a != b}
    n = Counter(d for x in {x for p in pairs for x in p} for d in reached(pairs, x).values() if d)
    e = spark.createDataFrame(mixed, "src long, dst long")
    assert sorted(map(tuple, traversal.path_lengths(e, traversal.vertices(e)).collect())) == sorted(n.items())
    few = spark.createDataFrame([(3,), (3,), (20_000,), (None,), (-1,)], "id long")
    some = Counter(d for x in (3, 20_000) for d in reached(pairs, x).values() if d)
    for held in (traversal.HELD, 0):
        monkeypatch.setattr(traversal, "HELD", held)
        assert sorted(map(tuple, traversal.path_lengths(e, few).collect())) == sorted(some.items())
    assert sorted(map(tuple, traversal.path_lengths(e.selectExpr("string(src) AS src", "string(dst) AS dst"), few.selectExpr("string(id) AS id"), 1).collect())) == [(1, 2)]


def test_path_lengths_writes_no_row_for_each_pair_or_round(spark, monkeypatch):
    ring = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "src long, dst long")
    written = []

    def counted(df, *tag, write=traversal.cut):
        out = write(df, *tag)
        written.append(out.count())
        return out

    monkeypatch.setattr(traversal, "cut", counted)
    assert sorted(map(tuple, traversal.path_lengths(ring, traversal.vertices(ring)).collect())) == [(d, 40) for d in range(1, 40)]
    # Edges, vertices, their numbers and the sources.
    assert sum(written) <= 4 * 40, written


def test_path_lengths_keeps_little_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(traversal, "SLICE", 1 << 14, raising=False)
    e = spark.range(400_000).selectExpr("id % 20000 AS src", "pmod(hash(id), 20000) AS dst").distinct()
    few = spark.createDataFrame([(1,), (2,)], "id long")
    n = e.where("src <> dst").count()
    tracemalloc.start()
    found = traversal.path_lengths(e, few, 1).collect()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0]["n"] == e.where("src IN (1, 2) AND src <> dst").count()
    # The edges' numbers twice, what is per vertex, and a slice.
    assert most < 20 * n, most / n


def of_pairs(pairs, total):
    """Where the in-neighbours of each vertex start in all of them, how many, and the units of all vertices."""
    a = np.array(sorted(pairs, key=lambda p: p[1]), np.int32)
    count = np.bincount(a[:, 1], minlength=total)
    return traversal._units(a[:, 0].copy(), np.cumsum(count) - count, count, np.arange(total))


def test_path_lengths_reads_a_vertex_until_it_has_all_sources(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(i, (i + 1) % 3000) for i in range(3000)} | {(int(a), int(b)) for a, b in rng.integers(0, 3000, (60_000, 2)) if a != b}
    (size, own, near, rest, _), asked, take = *of_pairs(pairs, 3000), [], np.take
    monkeypatch.setattr(np, "take", lambda a, at, *args, **named: asked.append(len(at)) or take(a, at, *args, **named))
    told = traversal._search(size, near, rest, None, own[:256], None)
    assert sum(told) == 256 * 2999
    # Of four rounds, the first and the last read few in-neighbours.
    assert len(told) == 4 and sum(asked) < 2.6 * len(pairs), sum(asked) / len(pairs)


def test_path_lengths_by_pairs_first(monkeypatch):
    rng = np.random.default_rng(6)
    hub = {(i, 0) for i in range(1, 900)} | {(i, 1500 + i) for i in range(300)} | {(int(a), int(b)) for a, b in rng.integers(0, 2000, (2500, 2)) if a != b}
    n = Counter(d for x in range(2000) for d in reached(hub, x).values() if d)
    taken, step = [], traversal._step
    monkeypatch.setattr(traversal, "COSTS", (0, 0, 3, 4))
    monkeypatch.setattr(traversal, "_step", lambda *args: taken.append(1) or step(*args))
    for pairs in (traversal.PAIRS, 400):
        monkeypatch.setattr(traversal, "PAIRS", pairs)
        found = Counter()
        for size, own, near, rest, _ in of_pairs(hub, 2000):
            for first in range(0, len(own), 640):
                found.update(dict(enumerate(traversal._search(size, near, rest, traversal._onward(size, near, rest), own[first : first + 640], None), 1)))
        assert found == n
    assert taken
