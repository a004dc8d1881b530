"""Queries of the graph operators, each with SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import host, site
from weftgraph.operators import cleaning, random_graphs, statistics, traversal
from weftgraph.sources.cut import cut
from weftgraph.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WITH = r"""
WITH RECURSIVE hosts AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
links AS (SELECT page_id, url, host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM hosts),
inc AS (SELECT DISTINCT host AS l, href AS r FROM links),
proj AS (SELECT a.l AS src, b.l AS dst, count(*)::BIGINT AS weight FROM inc a JOIN inc b ON a.r = b.r AND a.l < b.l GROUP BY ALL),
both_ways AS (SELECT src, dst FROM proj UNION ALL SELECT dst, src FROM proj),
deg AS (SELECT src AS id, count(*) AS degree FROM both_ways GROUP BY src),
parts AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst
    FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst)
"""


def query(name: str, sql: str | None = None, head: str = _WITH):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = head + sql
        return fn

    return register


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host graph: hosts that link to the same paths."""
    return cleaning.project(cleaning.incidence(load(spark, sf_dir, "pages")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph of parts: from every line of an order to the next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return lines.where("dst IS NOT NULL AND src <> dst").distinct()


def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.degree_distribution(statistics.degree(projection(spark, sf_dir)))


# Cleaning and extraction


@query("c1_quarantine", "SELECT page_id, if(host SIMILAR TO '.*(casino|pills|adult|ads-|spam|bets).*', 'suspicious host', '') AS reason FROM hosts")
def c1(spark, sf_dir):
    judged = cleaning.quarantine(load(spark, sf_dir, "pages"), cleaning.page_rules())
    return judged.select("page_id", F.array_join("reason", ",").alias("reason"))


@query("c2_links", "SELECT page_id, host, href FROM links")
def c2(spark, sf_dir):
    return cleaning.links(load(spark, sf_dir, "pages")).select("page_id", "host", "href")


@query("c3_hosts", "SELECT host, count(*) AS pages FROM hosts GROUP BY host")
def c3(spark, sf_dir):
    return load(spark, sf_dir, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query("c4_sites", r"SELECT regexp_replace(host, '^(www|m|blog)\.', '') AS site, count(*) AS pages FROM hosts GROUP BY ALL")
def c4(spark, sf_dir):
    return load(spark, sf_dir, "pages").groupBy(site(host(F.col("url"))).alias("site")).agg(F.count(F.lit(1)).alias("pages"))


@query("c5_resolved_links", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target FROM links")
def c5(spark, sf_dir):
    return cleaning.links(load(spark, sf_dir, "pages")).select("page_id", "target")


_STEPS = """, steps AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)"""


@query("c6_undirected", _STEPS + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*)::BIGINT AS weight FROM steps WHERE src <> dst GROUP BY ALL")
def c6(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = load(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), F.lit(1).cast("long").alias("weight"))
    return cleaning.undirect(steps)


@query("c7_projection", "SELECT * FROM proj")
def c7(spark, sf_dir):
    return projection(spark, sf_dir)


# Statistics


@query("g1_degree", "SELECT id, degree FROM deg")
def g1(spark, sf_dir):
    return statistics.degree(projection(spark, sf_dir))


@query("g1_in_out_degree", "SELECT coalesce(o.id, i.id) AS id, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM (SELECT src AS id, count(*) AS n FROM parts GROUP BY src) o FULL JOIN (SELECT dst AS id, count(*) AS n FROM parts GROUP BY dst) i ON o.id = i.id")
def g1_directed(spark, sf_dir):
    e = parts(spark, sf_dir)
    zero = F.lit(0).cast("long")
    out = statistics.degree(e, "out").withColumnRenamed("degree", "n_out").join(statistics.degree(e, "in").withColumnRenamed("degree", "n_in"), "id", "full")
    return out.select("id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))


@query("g2_degree_distribution", "SELECT degree, count(*) AS n FROM deg GROUP BY degree")
def g2(spark, sf_dir):
    return _distribution(spark, sf_dir)


@query("g3_ccdf", "SELECT degree, (sum(count(*)) OVER (ORDER BY degree DESC))::BIGINT AS at_least FROM deg GROUP BY degree")
def g3(spark, sf_dir):
    return statistics.ccdf(statistics.degree(projection(spark, sf_dir)))


@query("g4_summary", "SELECT n AS vertices, m AS edges, round(2 * m / (n * (n - 1)), 9) AS density, round(2 * m / n, 9) AS mean_degree FROM (SELECT count(*) AS n FROM deg), (SELECT count(*) AS m FROM proj)")
def g4(spark, sf_dir):
    return statistics.summary(projection(spark, sf_dir))


@query("g5_reciprocity", "SELECT count(*) AS edges, count(b.src) AS mutual, round(count(b.src) / count(*), 9) AS reciprocity FROM parts a LEFT JOIN parts b ON a.src = b.dst AND a.dst = b.src")
def g5(spark, sf_dir):
    return statistics.reciprocity(parts(spark, sf_dir))


_TRIANGLES = ", tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM proj x JOIN proj y ON x.dst = y.src JOIN proj z ON z.src = x.src AND z.dst = y.dst)"


@query("g6_triangles", _TRIANGLES + "SELECT * FROM tri")
def g6(spark, sf_dir):
    return statistics.triangles(projection(spark, sf_dir))


_LOCAL = _TRIANGLES + ", per AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY id), local AS (SELECT id, degree, coalesce(t, 0) AS t FROM deg LEFT JOIN per USING (id))"


@query("g7_clustering", _LOCAL + "SELECT id, degree, t AS triangles, round(if(degree > 1, 2 * t / (degree * (degree - 1)), 0.0)::DOUBLE, 9) AS clustering FROM local")
def g7(spark, sf_dir):
    return statistics.clustering(projection(spark, sf_dir))


@query("g7_transitivity", _LOCAL + "SELECT round(sum(t) / sum(degree * (degree - 1) / 2)::DOUBLE, 9) AS transitivity FROM local")
def g7_global(spark, sf_dir):
    return statistics.transitivity(projection(spark, sf_dir))


@query("g8_assortativity", "SELECT round(corr(a.degree, b.degree), 6) AS assortativity FROM both_ways e JOIN deg a ON a.id = src JOIN deg b ON b.id = dst")
def g8(spark, sf_dir):
    return statistics.assortativity(projection(spark, sf_dir))


@query("g9_entropy", "SELECT round(-sum(p * ln(p)), 9) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM deg) AS p FROM deg GROUP BY degree)")
def g9(spark, sf_dir):
    return statistics.entropy(projection(spark, sf_dir))


_BFS = ", walk(id, distance) USING KEY (id) AS (SELECT min(src), 0 FROM parts UNION SELECT dst, min(distance) + 1 FROM walk JOIN parts ON src = id WHERE dst NOT IN (SELECT id FROM recurring.walk) GROUP BY dst)"


@query("g10_bfs", _BFS + "SELECT id, distance FROM walk")
def g10(spark, sf_dir):
    e = cut(parts(spark, sf_dir))
    return traversal.bfs(e, e.agg(F.min("src")).head()[0])


_LENGTHS = """, v AS (SELECT src AS id FROM parts UNION SELECT dst FROM parts), walk(s, id, distance) USING KEY (s, id) AS (
SELECT id, id, 0 FROM v UNION
SELECT n.s, n.dst, n.d FROM (SELECT s, dst, min(distance) + 1 AS d FROM walk JOIN parts ON src = id GROUP BY s, dst) n LEFT JOIN recurring.walk r ON r.s = n.s AND r.id = n.dst WHERE r.id IS NULL)"""


@query("g11_path_lengths", _LENGTHS + "SELECT distance, count(*) AS n FROM walk WHERE distance > 0 GROUP BY distance")
def g11(spark, sf_dir):
    e = cut(parts(spark, sf_dir))
    return traversal.path_lengths(e, traversal.vertices(e))


_WEAK = ", near AS (SELECT src, dst FROM parts UNION SELECT dst, src FROM parts), weak(id, c) AS (SELECT src, src FROM near UNION SELECT dst, c FROM weak JOIN near ON src = id WHERE dst > c)"


@query("g12_components", _WEAK + "SELECT id, min(c) AS component FROM weak GROUP BY id")
def g12(spark, sf_dir):
    return traversal.components(cut(parts(spark, sf_dir)))


_REACH = ", v AS (SELECT src AS id FROM parts UNION SELECT dst FROM parts), reach(a, b) AS (SELECT id, id FROM v UNION SELECT a, dst FROM reach JOIN parts ON src = b), scc AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query("g13_strong_components", _REACH + "SELECT * FROM scc")
def g13(spark, sf_dir):
    return traversal.strong_components(cut(parts(spark, sf_dir)))


def _rank_sql(rounds: int) -> str:
    out = ", ids AS (SELECT src AS id FROM parts UNION SELECT dst FROM parts), n AS (SELECT count(*)::DOUBLE AS n FROM ids), o AS (SELECT src, count(*) AS out FROM parts GROUP BY src), r0 AS (SELECT id, 1.0 / n AS r FROM ids, n)"
    for k in range(rounds):
        out += f""", r{k + 1} AS (
  SELECT i.id, 0.15 / n.n + 0.85 * (coalesce(g.got, 0.0) + coalesce((SELECT sum(r) FROM r{k} WHERE id NOT IN (SELECT src FROM o)), 0.0) / n.n) AS r
  FROM ids i CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(r / out) AS got FROM parts e JOIN r{k} ON r{k}.id = e.src JOIN o ON o.src = e.src GROUP BY e.dst) g ON g.dst = i.id)"""
    return out + f" SELECT id, round(r, 8) AS rank FROM r{rounds}"


@query("g14_page_rank", _rank_sql(10))
def g14(spark, sf_dir):
    return traversal.page_rank(cut(parts(spark, sf_dir)))


def _hits_sql(rounds: int) -> str:
    out = ", ids AS (SELECT src AS id FROM parts UNION SELECT dst FROM parts), h0 AS (SELECT id, 1.0::DOUBLE AS h FROM ids)"
    for k in range(1, rounds + 1):
        out += f", x{k} AS (SELECT dst AS id, sum(h) AS a FROM parts JOIN h{k - 1} ON id = src GROUP BY dst), a{k} AS (SELECT id, a / sqrt(sum(a * a) OVER ()) AS a FROM x{k})"
        out += f", y{k} AS (SELECT src AS id, sum(a) AS h FROM parts JOIN a{k} ON id = dst GROUP BY src), h{k} AS (SELECT id, h / sqrt(sum(h * h) OVER ()) AS h FROM y{k})"
    return out + f" SELECT ids.id, round(coalesce(h, 0.0), 8) AS hub, round(coalesce(a, 0.0), 8) AS authority FROM ids LEFT JOIN h{rounds} USING (id) LEFT JOIN a{rounds} USING (id)"


@query("g15_hits", _hits_sql(5))
def g15(spark, sf_dir):
    return traversal.hits(cut(parts(spark, sf_dir)))


_SPARSE = ", e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM parts)"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of parts without directions."""
    return cleaning.undirect(parts(spark, sf_dir).withColumn("weight", F.lit(1))).select("src", "dst")


def _core_sql(k: int, rounds: int) -> str:
    out = _SPARSE + ", e0 AS (SELECT * FROM e)"
    for i in range(rounds):
        out += f", k{i} AS (SELECT id FROM (SELECT unnest([src, dst]) AS id FROM e{i}) GROUP BY id HAVING count(*) >= {k}), e{i + 1} AS (SELECT * FROM e{i} WHERE src IN (SELECT id FROM k{i}) AND dst IN (SELECT id FROM k{i}))"
    return out + f" SELECT * FROM e{rounds}"


@query("g16_core", _core_sql(3, 12))
def g16(spark, sf_dir):
    return traversal.core(sparse(spark, sf_dir), 3)


def _labels_sql(rounds: int) -> str:
    out = ", l0 AS (SELECT id, id AS label FROM deg)"
    for k in range(rounds):
        out += f", v{k} AS (SELECT src AS id, label, count(*) AS n FROM both_ways JOIN l{k} ON id = dst GROUP BY ALL), l{k + 1} AS (SELECT id, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"
    return out


@query("g17_label_propagation", _labels_sql(5) + " SELECT * FROM l5")
def g17(spark, sf_dir):
    return traversal.label_propagation(projection(spark, sf_dir))


@query("g18_modularity", ", l AS (SELECT id, id[1:3] AS label FROM deg) SELECT round(same / m - squares / (4 * m * m), 9) AS modularity FROM (SELECT count(*)::DOUBLE AS m, count(*) FILTER (a.label = b.label) AS same FROM proj JOIN l a ON a.id = src JOIN l b ON b.id = dst), (SELECT sum(d * d)::DOUBLE AS squares FROM (SELECT label, sum(degree) AS d FROM deg JOIN l USING (id) GROUP BY label))")
def g18(spark, sf_dir):
    e = projection(spark, sf_dir)
    return statistics.modularity(e, traversal.vertices(e).withColumn("label", F.substring("id", 1, 3)))


@query("g19_power_law", "SELECT count(*) AS n, round(1 + count(*) / sum(ln(degree / 4.5)), 6) AS exponent FROM deg WHERE degree >= 5")
def g19(spark, sf_dir):
    return statistics.power_law(statistics.degree(projection(spark, sf_dir)), 5)


_BOW = _REACH + ", core AS (SELECT component FROM scc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), one AS (SELECT min(id) AS s FROM scc JOIN core USING (component))" + _WEAK.replace(", near", ", near", 1)


@query(
    "g20_bow_tie",
    _BOW
    + ", w AS (SELECT id, min(c) AS c FROM weak GROUP BY id) SELECT v.id, CASE WHEN f.b IS NOT NULL AND t.a IS NOT NULL THEN 'core' WHEN t.a IS NOT NULL THEN 'in' WHEN f.b IS NOT NULL THEN 'out' WHEN w.c = (SELECT c FROM w JOIN one ON w.id = s) THEN 'tendril' ELSE 'other' END AS part FROM v LEFT JOIN (SELECT b FROM reach JOIN one ON a = s) f ON f.b = v.id LEFT JOIN (SELECT a FROM reach JOIN one ON b = s) t ON t.a = v.id JOIN w ON w.id = v.id",
)
def g20(spark, sf_dir):
    return traversal.bow_tie(cut(parts(spark, sf_dir)))


@query("g21_top_k", "SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 10")
def g21(spark, sf_dir):
    return statistics.top_k(statistics.degree(projection(spark, sf_dir)), "degree", 10)


@query("g21_top_k_by_group", "SELECT id, degree, id[1:3] AS name, (row_number() OVER (PARTITION BY id[1:3] ORDER BY degree DESC, id))::INTEGER AS rank FROM deg QUALIFY rank <= 2")
def g21_group(spark, sf_dir):
    d = statistics.degree(projection(spark, sf_dir)).withColumn("name", F.substring("id", 1, 3))
    return statistics.top_k_by(d, "name", "degree", 2)


# Random graphs


def _h(*parts: str) -> str:
    return "('0x' || md5(concat_ws('-', " + ", ".join(parts) + "))[1:15])::BIGINT"


def _gnm_sql(n: int, m: int, seed: str, draws: int) -> str:
    return f"""
WITH p AS (SELECT i, {_h(f"'{seed}'", "i", "'u'")} % {n} AS u, {_h(f"'{seed}'", "i", "'v'")} % {n} AS v FROM range({draws}) AS t(i)),
e AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, min(i) AS i FROM p WHERE u <> v GROUP BY ALL)
SELECT src, dst FROM e ORDER BY i LIMIT {m}"""


_GNP_EDGES = random_graphs.binomial(400 * 399 // 2, 0.02, "gnp")


@query("n1_gnp", _gnm_sql(400, _GNP_EDGES, "gnp", _GNP_EDGES * 3), "")
def n1(spark, sf_dir):
    return random_graphs.gnp(spark, 400, 0.02, "gnp")


@query("n2_gnm", _gnm_sql(500, 2000, "gnm", 6000), "")
def n2(spark, sf_dir):
    return random_graphs.gnm(spark, 500, 2000, "gnm")


@query(
    "n3_configuration",
    ", stubs AS (SELECT id, unnest(range(1, degree + 1)) AS stub FROM deg), placed AS (SELECT id, row_number() OVER (ORDER BY "
    + _h("'cfg'", "id", "stub")
    + ", id, stub) - 1 AS p FROM stubs) SELECT a.id AS src, b.id AS dst FROM placed a JOIN placed b ON a.p % 2 = 0 AND b.p = a.p + 1",
)
def n3(spark, sf_dir):
    return random_graphs.configuration(statistics.degree(projection(spark, sf_dir)), "cfg")


@query(
    "n4_watts_strogatz",
    f"""
WITH ring AS (SELECT u, j, {_h("'ws'", "u", "j", "'coin'")} % 1000000 < 100000 AS moved, {_h("'ws'", "u", "j", "'end'")} % 300 AS t FROM range(300) AS a(u), range(1, 5) AS b(j)),
p AS (SELECT u, if(moved AND t <> u, t, (u + j) % 300) AS v FROM ring)
SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM p WHERE u <> v""",
    "",
)
def n4(spark, sf_dir):
    return random_graphs.watts_strogatz(spark, 300, 4, 0.1, "ws")


@query("n5_barabasi_albert", "SELECT r AS replica, 891::BIGINT AS edges, 891::BIGINT AS kinds, 300::BIGINT AS vertices, 1::BIGINT AS components, 3::BIGINT AS least, true AS older FROM range(4) AS t(r)", "")
def n5(spark, sf_dir):
    """What holds of every graph that grows by three edges a vertex: how many edges, no loops or repeats, all joined."""
    e = cut(random_graphs.barabasi_albert(spark, 300, 3, "ba", 4))
    apart = e.select("replica", (F.col("replica") * 300 + F.col("src")).alias("src"), (F.col("replica") * 300 + F.col("dst")).alias("dst"))
    joined = traversal.components(apart).groupBy(F.floor(F.col("id") / 300).alias("replica")).agg(F.count(F.lit(1)).alias("vertices"), F.count_distinct("component").alias("components"))
    # The first vertices start without edges; each later one brings three.
    least = apart.where("dst - replica * 300 >= 3").groupBy("replica", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("replica").agg(F.min("n").alias("least"))
    told = e.groupBy("replica").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src", "dst").alias("kinds"), F.every(F.col("src") < F.col("dst")).alias("older"))
    return told.join(joined, "replica").join(least, "replica").select("replica", "edges", "kinds", "vertices", "components", "least", "older")


@query("n5_barabasi_albert_edges")
def n5_edges(spark, sf_dir):
    return random_graphs.barabasi_albert(spark, 300, 3, "ba", 4)


def _rewire_sql(rounds: int) -> str:
    out = _SPARSE + ", w0 AS (SELECT * FROM e)"
    for k in range(rounds):
        out += f""", o{k} AS (SELECT src, dst, row_number() OVER (ORDER BY {_h("'rw'", str(k), "src", "dst")}, src, dst) - 1 AS o FROM w{k}),
q{k} AS (SELECT a.o AS pair, a.src AS a, a.dst AS b, x.src AS c, x.dst AS d FROM o{k} a LEFT JOIN o{k} x ON x.o = a.o + 1 WHERE a.o % 2 = 0),
n{k} AS (SELECT pair, least(a, d) AS x, greatest(a, d) AS y FROM q{k} WHERE c IS NOT NULL UNION ALL SELECT pair, least(c, b), greatest(c, b) FROM q{k} WHERE c IS NOT NULL),
b{k} AS (SELECT DISTINCT pair FROM n{k} WHERE x = y OR (x, y) IN (SELECT (src, dst) FROM w{k}) OR (x, y) IN (SELECT (x, y) FROM n{k} GROUP BY x, y HAVING count(*) > 1)),
s{k} AS (SELECT *, c IS NULL OR pair IN (SELECT pair FROM b{k}) AS stay FROM q{k}),
w{k + 1} AS (SELECT least(a, f) AS src, greatest(a, f) AS dst FROM (SELECT a, if(stay, b, d) AS f FROM s{k} UNION ALL SELECT c, if(stay, d, b) FROM s{k} WHERE c IS NOT NULL))"""
    return out + f" SELECT src, dst FROM w{rounds}"


@query("n6_rewired", _rewire_sql(2))
def n6(spark, sf_dir):
    return random_graphs.rewire(sparse(spark, sf_dir), "rw", 2)


@query(
    "n7_ensemble",
    f""", n AS (SELECT count(*) AS n FROM deg), m AS (SELECT count(*) AS m FROM proj),
draws AS (SELECT r, {_h("'ens'", "r", "i", "'u'")} % n AS u, {_h("'ens'", "r", "i", "'v'")} % n AS v FROM range(20) AS a(r), m, n, unnest(range(m)) AS b(i)),
g AS (SELECT DISTINCT r, least(u, v) AS src, greatest(u, v) AS dst FROM draws WHERE u <> v),
d AS (SELECT r, id, count(*) AS k FROM (SELECT r, unnest([src, dst]) AS id FROM g) GROUP BY ALL),
s AS (SELECT r, sum(k * k) / n - pow(sum(k) / n, 2) AS s FROM d, n GROUP BY r, n)
SELECT round(o, 6) AS observed, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round((o - avg(s)) / stddev_samp(s), 6) AS z
FROM s, (SELECT var_pop(degree) AS o FROM deg) GROUP BY o""",
)
def n7(spark, sf_dir):
    return random_graphs.compare(projection(spark, sf_dir), "ens", 20)


def _walk_sql(steps: int) -> str:
    out = ", r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS out FROM parts), w0 AS (SELECT DISTINCT src AS start, 0 AS step, src AS id FROM parts)"
    for i in range(1, steps + 1):
        out += f", w{i} AS (SELECT start, {i} AS step, dst AS id FROM w{i - 1} JOIN r ON src = id AND k = {_h(chr(39) + 'walk' + chr(39), 'start', str(i))} % out)"
    return out + " " + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(steps + 1))


@query("n8_walk", _walk_sql(5))
def n8(spark, sf_dir):
    e = cut(parts(spark, sf_dir))
    return traversal.walk(e, e.select(F.col("src").alias("id")).distinct(), 5, "walk")
