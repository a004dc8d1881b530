"""Statistics of graphs: degrees, distributions, triangles, mixing, power laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.cleaning import both_ways


def degree(edges: DataFrame, mode: str = "total") -> DataFrame:
    """id, degree: in, out or total degree of the vertices that have one."""
    ends = {"in": [F.col("dst")], "out": [F.col("src")], "total": [F.col("src"), F.col("dst")]}[mode]
    ids = edges.select(F.explode(F.array(*ends)).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(degrees: DataFrame) -> DataFrame:
    """degree, n: how many vertices have a degree."""
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def ccdf(degrees: DataFrame) -> DataFrame:
    """degree, at_least: how many vertices have that degree or more.

    The window has one row for each distinct degree, of which a graph with m
    edges has less than 2 * sqrt(m).
    """
    w = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return degree_distribution(degrees).select("degree", F.sum("n").over(w).alias("at_least"))


def summary(edges: DataFrame) -> DataFrame:
    """vertices, edges, density and mean degree of undirected edges, in one row."""
    d = degree(edges).agg(F.count(F.lit(1)).alias("vertices"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"))
    n, m = F.col("vertices"), F.col("edges")
    return d.select("vertices", "edges", F.round(F.try_divide(2 * m, n * (n - 1)), 9).alias("density"), F.round(F.try_divide(2 * m, n), 9).alias("mean_degree"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """edges, mutual, reciprocity of distinct directed edges without self-loops."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("mutual"))
    counts = e.join(back, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("edges"), F.count("mutual").alias("mutual"))
    return counts.withColumn("reciprocity", F.round(F.try_divide(F.col("mutual"), F.col("edges")), 9))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c: each triangle of undirected edges once.

    Edges point from the lower degree to the higher, ties by id.  No vertex then
    has more than sqrt(2 * m) edges out, which bounds the pairs of the join.
    """
    d = degree(edges)
    e = edges.select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src")
    e = e.join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"))
    left, right = out.select("x", F.col("y").alias("p")), out.select("x", F.col("y").alias("q"))
    wedges = left.join(right, "x").where("p < q")
    closed = wedges.join(edges.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"])
    sorted_ = F.array_sort(F.array("x", "p", "q"))
    return closed.select(sorted_[0].alias("a"), sorted_[1].alias("b"), sorted_[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, clustering: local clustering coefficients, 0 for a degree under 2."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    d = degree(edges).join(t, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return d.withColumn("clustering", F.round(F.coalesce(F.try_divide(2 * F.col("triangles"), pairs), F.lit(0.0)), 9))


def transitivity(edges: DataFrame) -> DataFrame:
    """Three times the triangles over the connected triples, in one row."""
    c = clustering(edges).agg(F.sum("triangles").alias("t"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w"))
    return c.select(F.round(F.coalesce(F.try_divide("t", "w"), F.lit(0.0)), 9).alias("transitivity"))


def assortativity(edges: DataFrame) -> DataFrame:
    """The correlation of degrees at the two ends, over both directions of each edge; NaN where all degrees are equal, null without edges."""
    d = degree(edges)
    ends = both_ways(edges).join(d.select(F.col("id").alias("src"), F.col("degree").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("y")), "dst")
    sums = ends.agg(F.covar_pop("x", "y").alias("both"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("each"), (F.min("x") == F.max("x")).alias("equal"))
    # corr() divides by zero where all degrees are equal, an error in ANSI mode.
    return sums.select(F.when(F.col("equal"), float("nan")).otherwise(F.round(F.try_divide("both", "each"), 6)).alias("assortativity"))


def entropy(edges: DataFrame) -> DataFrame:
    """The entropy in nats of the degree distribution."""
    dist = degree_distribution(degree(edges))
    total = dist.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return dist.join(F.broadcast(total)).agg(F.round(-F.sum(p * F.ln(p)), 9).alias("entropy"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The modularity of undirected edges under labels (id, label)."""
    ls, ld = labels.select(F.col("id").alias("src"), F.col("label").alias("x")), labels.select(F.col("id").alias("dst"), F.col("label").alias("y"))
    inside = edges.join(ls, "src").join(ld, "dst").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("same"))
    mass = degree(edges).join(labels, "id").groupBy("label").agg(F.sum("degree").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("squares"))
    q = F.col("same") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))
    return inside.join(F.broadcast(mass)).select(F.round(q, 9).alias("modularity"))


def power_law(degrees: DataFrame, xmin: int) -> DataFrame:
    """n, exponent: the maximum-likelihood exponent of degrees from xmin on (Clauset, Shalizi, Newman 2009)."""
    n, s = F.count(F.lit(1)), F.sum(F.ln(F.col("degree") / F.lit(xmin - 0.5)))
    return degrees.where(F.col("degree") >= xmin).agg(n.alias("n"), F.round(1 + F.try_divide(n, s), 6).alias("exponent"))


def top_k(metrics: DataFrame, value: str, k: int) -> DataFrame:
    """The k rows of highest value, ties by id."""
    return metrics.orderBy(F.desc(value), "id").limit(k)


def top_k_by(metrics: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k rows of highest value in each group, ties by id, and their rank."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), "id"))
    return metrics.withColumn("rank", rank).where(F.col("rank") <= k)
