"""Graph operators on small graphs whose results are known, and invariants of random graphs."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from weftgraph.operators import cleaning, random_graphs, statistics, traversal

K4 = [(a, b) for a in "abcd" for b in "abcd" if a < b]
PATH = [("a", "b"), ("b", "c"), ("c", "d")]
STAR = [("a", x) for x in "bcde"]
CYCLE = [("a", "b"), ("b", "c"), ("c", "a")]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight bigint")


def told(df):
    return sorted(map(tuple, df.collect()))


def test_complete_graph(spark):
    e = edges(spark, K4)
    assert told(statistics.degree(e)) == [(x, 3) for x in "abcd"]
    assert told(statistics.triangles(e)) == [("a", "b", "c"), ("a", "b", "d"), ("a", "c", "d"), ("b", "c", "d")]
    assert {r["clustering"] for r in statistics.clustering(e).collect()} == {1.0}
    assert told(statistics.summary(e)) == [(4, 6, 1.0, 3.0)]
    assert told(statistics.transitivity(e)) == [(1.0,)]
    assert len(told(traversal.core(e, 3))) == 6 and told(traversal.core(e, 4)) == []


def test_path_star_and_parts(spark):
    assert told(traversal.bfs(edges(spark, PATH), "a")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert told(traversal.bfs(edges(spark, PATH), "a", 1)) == [("a", 0), ("b", 1)]
    assert told(statistics.degree_distribution(statistics.degree(edges(spark, STAR)))) == [(1, 4), (4, 1)]
    assert told(statistics.ccdf(statistics.degree(edges(spark, STAR)))) == [(1, 5), (4, 1)]
    two = edges(spark, [*PATH, ("x", "y"), ("z", "z")])
    assert told(traversal.components(two)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    assert told(statistics.modularity(edges(spark, [("a", "b"), ("x", "y")]), spark.createDataFrame([("a", 1), ("b", 1), ("x", 2), ("y", 2)], "id string, label int"))) == [(0.5,)]


def test_directed(spark):
    e = edges(spark, [*CYCLE, ("c", "d"), ("s", "a"), ("d", "t")])
    assert told(traversal.strong_components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("s", "s"), ("t", "t")]
    assert dict(told(traversal.bow_tie(e))) == {"a": "core", "b": "core", "c": "core", "d": "out", "s": "in", "t": "out"}
    assert told(statistics.reciprocity(edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")]))) == [(3, 2, pytest.approx(2 / 3))]
    ranks = traversal.page_rank(e, rounds=30).collect()
    assert sum(r["rank"] for r in ranks) == pytest.approx(1, abs=1e-6)
    assert [r["rank"] for r in traversal.page_rank(edges(spark, CYCLE)).collect()] == [pytest.approx(1 / 3, abs=1e-7)] * 3
    assert told(traversal.hits(edges(spark, [("a", "b")]))) == [("a", 1.0, 0.0), ("b", 0.0, 1.0)]


def test_empty_graph(spark):
    e = edges(spark, [])
    for df in (statistics.degree(e), statistics.triangles(e), traversal.components(e), traversal.strong_components(e), traversal.core(e, 2), traversal.page_rank(e), traversal.hits(e), traversal.label_propagation(e), cleaning.undirect(e), random_graphs.rewire(e, "s", 2), random_graphs.compare(e, "s", 3)):
        assert df.count() == 0
    assert statistics.entropy(e).head()[0] is None and statistics.assortativity(e).head()[0] is None


def test_canonical_edges_and_projection(spark):
    e = edges(spark, [("b", "a"), ("a", "b"), ("a", "a"), ("c", "a")])
    assert told(cleaning.undirect(e)) == [("a", "b", 2), ("a", "c", 1)]
    pairs = spark.createDataFrame([("x", 1), ("y", 1), ("y", 1), ("z", 2), ("x", 2)], "left string, right int")
    assert told(cleaning.project(pairs)) == [("x", "y", 1), ("x", "z", 1)]


def test_pages_with_bad_urls(spark):
    html = '<a href="http://o.org/1">x</a><a href="//q.net/2"></a><a href="/r"></a><a href="#f"></a><a href="s/t"></a><a href=""></a>'
    pages = spark.createDataFrame([(1, "HTTPS://WWW.Host.com/a/b?q=1", html), (2, None, html), (3, "not a url ^^", ""), (4, "http://casino-win.com", None), (5, "http://h.com", '<a href="x"></a>')], "page_id long, url string, html string")
    clean, rejected = cleaning.split_clean(pages, cleaning.page_rules())
    assert sorted(r["page_id"] for r in clean.collect()) == [1, 5]
    assert {r["page_id"]: r["reason"] for r in rejected.collect()} == {2: ["no url"], 3: ["no host", "no html"], 4: ["suspicious host", "no html"]}
    got = [r["target"] for r in cleaning.links(pages.where("page_id = 5").unionByName(spark.createDataFrame([(6, "https://host.com/a/b?q=1", html)], pages.schema))).orderBy("page_id").collect()]
    assert got[0] == "http://h.com/x"
    assert got[1:] == ["http://o.org/1", "https://q.net/2", "https://host.com/r", "https://host.com/a/b#f", "https://host.com/a/s/t", "https://host.com/a/b"]


def test_random_graphs_do_not_depend_on_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "4", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        d = spark.createDataFrame([(i, i % 5) for i in range(60)], "id long, degree long").repartition(int(n))
        found.append([told(random_graphs.gnm(spark, 50, 120, "s")), told(random_graphs.configuration(d, "s")), told(random_graphs.watts_strogatz(spark, 60, 3, 0.2, "s")), told(random_graphs.barabasi_albert(spark, 40, 2, "s"))])
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) == 120 and len(set(found[0][0])) == 120
    ends = Counter(x for e in found[0][1] for x in e)
    assert ends == Counter({i: i % 5 for i in range(60) if i % 5})
    assert len(found[0][3]) == 38 * 2


def test_rewiring_keeps_degrees(spark):
    e = random_graphs.gnm(spark, 60, 150, "r")
    after = random_graphs.rewire(e, "w", 3)
    assert told(statistics.degree(after)) == told(statistics.degree(e))
    pairs = told(after)
    assert len(set(pairs)) == 150 and all(a != b for a, b in pairs) and pairs != told(e)


def test_walks_follow_edges(spark):
    e = edges(spark, [*CYCLE, ("c", "d")])
    steps = told(traversal.walk(e, spark.createDataFrame([("a",)], "id string"), 6, "s"))
    at = {s: x for _, s, x in steps}
    assert all((at[s], at[s + 1]) in {*CYCLE, ("c", "d")} for s in range(max(at)))


def test_assortativity_of_equal_degrees(spark):
    for graph in (K4, CYCLE, [("a", "b")]):
        assert math.isnan(statistics.assortativity(edges(spark, graph)).head()[0])
    assert statistics.assortativity(edges(spark, STAR)).head()[0] == -1.0 and statistics.assortativity(edges(spark, PATH)).head()[0] == -0.5
