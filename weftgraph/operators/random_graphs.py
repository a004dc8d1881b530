"""Random-graph models whose draws are hashes, so a seed gives one graph whatever the partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import hashed
from weftgraph.operators.statistics import degree
from weftgraph.sources.cut import cut, drop

#: Rows that are numbered in one task.
NUMBERED = 65_536


def gnm(spark: SparkSession, n: int, m: int, seed: str) -> DataFrame:
    """src < dst: m distinct edges among n vertices 0 to n - 1, all sets of edges alike likely (Erdos, Renyi 1959).

    Draw i hashes to two vertices; loops and repeats are dropped, and the first m
    that are left are kept.  Draws double until there are enough.
    """
    if m > n * (n - 1) // 2:
        raise ValueError("more edges than pairs")
    draws = m + m // 4 + 64
    while True:
        u, v = F.pmod(hashed(F.lit(seed), F.col("id"), F.lit("u")), F.lit(n)), F.pmod(hashed(F.lit(seed), F.col("id"), F.lit("v")), F.lit(n))
        pairs = spark.range(draws).select("id", u.alias("u"), v.alias("v")).where("u <> v")
        edges = pairs.groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.min("id").alias("id"))
        kept = _first(edges, m)
        if kept is not None:
            return kept.select("src", "dst")
        draws *= 2


def _first(rows: DataFrame, m: int) -> DataFrame | None:
    """The m rows of smallest id, or None if there are fewer; blocks of ids are counted, and one block is numbered."""
    rows = rows.withColumn("block", F.floor(F.col("id") / NUMBERED))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(before))
    last = sums.where(F.col("upto") >= m).orderBy("block").limit(1).collect()
    if not last:
        return None if m else rows.limit(0)
    block, left = last[0]["block"], m - (last[0]["upto"] - last[0]["n"])
    cut_off = rows.where(F.col("block") == block).orderBy("id").limit(left)
    return rows.where(F.col("block") < block).unionByName(cut_off)


def binomial(n: int, p: float, seed: str) -> int:
    """A draw from the binomial distribution that the seed decides."""
    state = int.from_bytes(hashlib.md5(seed.encode()).digest()[:8], "big")
    return int(np.random.default_rng(state).binomial(n, p))


def gnp(spark: SparkSession, n: int, p: float, seed: str) -> DataFrame:
    """src < dst: each pair of n vertices with probability p: a binomial number of edges, then G(n, m).

    The pairs themselves are never enumerated.
    """
    return gnm(spark, n, binomial(n * (n - 1) // 2, p, seed), seed)


def configuration(degrees: DataFrame, seed: str) -> DataFrame:
    """src, dst: a random pairing of stubs (Molloy, Reed 1995) of degrees (id, degree); loops and repeats are kept.

    Stubs are put in the order of a hash and numbered in blocks of it; numbers
    2k and 2k + 1 are paired.  With an odd number of stubs the last is left over.
    """
    stubs = degrees.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), "degree")).alias("stub"))
    stubs = stubs.withColumn("h", hashed(F.lit(seed), F.col("id"), F.col("stub")))
    total = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).head()[0]
    width = max(1, (1 << 60) // max(1, total // NUMBERED))
    stubs = stubs.withColumn("block", F.floor(F.col("h") / width))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stubs.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("h", "id", "stub")) - 1
    placed = stubs.withColumn("inside", inside).join(offsets, "block").select("id", (F.col("offset") + F.col("inside")).alias("place"))
    pair = F.floor(F.col("place") / 2)
    ends = placed.groupBy(pair.alias("pair")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("id"))).alias("src"), F.max(F.when(F.col("place") % 2 == 1, F.col("id"))).alias("dst"))
    return ends.where("dst IS NOT NULL").select("src", "dst")


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seed: str) -> DataFrame:
    """src, dst: a ring in which each vertex is joined to the k next ones, the far end moved with probability beta.

    A moved end that would make a loop stays; repeated edges are merged, so a few
    edges fewer than n * k may be left.
    """
    ring = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    moved = F.pmod(hashed(F.lit(seed), F.col("u"), F.col("j"), F.lit("coin")), F.lit(1_000_000)) < int(beta * 1_000_000)
    target = F.pmod(hashed(F.lit(seed), F.col("u"), F.col("j"), F.lit("end")), F.lit(n))
    v = F.when(moved & (target != F.col("u")), target).otherwise(F.pmod(F.col("u") + F.col("j"), F.lit(n)))
    pairs = ring.select("u", v.alias("v"))
    return pairs.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).where("src <> dst").distinct()


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: str, replicas: int = 1) -> DataFrame:
    """replica, src, dst: growing graphs in which a new vertex takes m distinct ends, each in proportion to its degree.

    The model is sequential; each replica is grown in a task of its own, with
    memory in proportion to its n * m edges.
    """

    def grow(batches):
        import pyarrow as pa

        for batch in batches:
            for replica in batch.column(0).to_pylist():
                r = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}-{replica}".encode()).digest()[:8], "big"))
                ends = list(range(m))
                src, dst = [], []
                for v in range(m, n):
                    chosen: set[int] = set()
                    while len(chosen) < m:
                        chosen.add(int(ends[r.integers(len(ends))]))
                    for u in sorted(chosen):
                        src.append(u)
                        dst.append(v)
                        ends += [u, v]
                yield pa.RecordBatch.from_arrays([pa.array([replica] * len(src), pa.int64()), pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["replica", "src", "dst"])

    return spark.range(0, replicas, 1, replicas).mapInArrow(grow, "replica long, src long, dst long")


def rewire(edges: DataFrame, seed: str, rounds: int) -> DataFrame:
    """src, dst: edges after rounds of swaps that keep every degree (Maslov, Sneppen 2002).

    Each round numbers the edges by the order of a hash, in blocks of it, and pairs
    numbers 2k and 2k + 1; with an odd number the last edge stays.  A pair (a, b),
    (c, d) becomes (a, d), (c, b) unless that makes a loop or an edge that stands or
    is proposed twice.
    """
    now = cut(edges.select("src", "dst"))
    width = max(1, (1 << 60) // max(1, now.count() // NUMBERED))
    blocks, inside = Window.orderBy("block"), Window.partitionBy("block").orderBy("h", "src", "dst")
    for k in range(rounds):
        h = now.withColumn("h", hashed(F.lit(seed), F.lit(k), F.col("src"), F.col("dst"))).withColumn("block", F.floor(F.col("h") / width))
        edge = F.struct("h", "src", "dst")
        # The last edge of a block may be paired with the first of the next.
        told = h.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min(edge).alias("first"))
        told = told.select("block", F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lead("first").over(blocks).alias("beyond"))
        placed = h.select("block", "src", "dst", (F.row_number().over(inside) - 1).alias("inside"), F.lead(edge).over(inside).alias("next")).join(F.broadcast(told), "block")
        o, q = F.col("offset") + F.col("inside"), F.coalesce("next", "beyond")
        pairs = cut(placed.where(o % 2 == 0).select(F.shiftright(o, 1).alias("pair"), F.col("src").alias("a"), F.col("dst").alias("b"), q["src"].alias("c"), q["dst"].alias("d")))
        swap = pairs.where("c IS NOT NULL")
        new = swap.select("pair", F.explode(F.array(F.struct(F.least("a", "d").alias("x"), F.greatest("a", "d").alias("y")), F.struct(F.least("c", "b").alias("x"), F.greatest("c", "b").alias("y")))).alias("e")).select("pair", "e.x", "e.y")
        standing = now.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.lit(1).alias("old")).distinct()
        twice = new.groupBy("x", "y").agg(F.count(F.lit(1)).alias("times"))
        bad = new.join(standing, ["x", "y"], "left").join(twice, ["x", "y"]).where("x = y OR old = 1 OR times > 1").select("pair").distinct().withColumn("bad", F.lit(1))
        judged = pairs.join(bad, "pair", "left")
        keep = F.col("c").isNull() | (F.col("bad") == 1)
        first = judged.select(F.col("a").alias("src"), F.when(F.coalesce(keep, F.lit(False)), F.col("b")).otherwise(F.col("d")).alias("dst"))
        second = judged.where("c IS NOT NULL").select(F.col("c").alias("src"), F.when(F.coalesce(keep, F.lit(False)), F.col("d")).otherwise(F.col("b")).alias("dst"))
        after = cut(first.unionByName(second).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))
        drop(now, pairs)
        now = after
    return now


def ensemble(spark: SparkSession, n: int, m: int, seed: str, replicas: int) -> DataFrame:
    """replica, src, dst: G(n, m) multigraphs without loops, one for each replica, in one job."""
    draws = spark.range(replicas * m).select(F.floor(F.col("id") / m).alias("replica"), F.pmod("id", F.lit(m)).alias("i"))
    u = F.pmod(hashed(F.lit(seed), F.col("replica"), F.col("i"), F.lit("u")), F.lit(n))
    v = F.pmod(hashed(F.lit(seed), F.col("replica"), F.col("i"), F.lit("v")), F.lit(n))
    pairs = draws.select("replica", u.alias("u"), v.alias("v")).where("u <> v")
    return pairs.select("replica", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def compare(edges: DataFrame, seed: str, replicas: int) -> DataFrame:
    """observed, mean, sd, z of the variance of degrees against G(n, m) graphs with as many vertices and edges."""
    d = degree(edges)
    n, m = d.count(), edges.count()
    if n < 2:
        return edges.sparkSession.createDataFrame([], "observed double, mean double, sd double, z double")
    observed = d.agg(F.var_pop("degree").alias("observed"))
    ends = ensemble(edges.sparkSession, n, m, seed, replicas).select("replica", F.explode(F.array("src", "dst")).alias("id"))
    per = ends.groupBy("replica", "id").agg(F.count(F.lit(1)).alias("degree"))
    # Vertices that no draw hit have degree 0, which sums over n account for.
    stat = per.groupBy("replica").agg((F.sum(F.col("degree") * F.col("degree")) / n - F.pow(F.sum("degree") / n, 2)).alias("s"))
    model = stat.agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"))
    z = F.try_divide(F.col("observed") - F.col("mean"), F.col("sd"))
    return observed.join(F.broadcast(model)).select(F.round("observed", 6).alias("observed"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(z, 6).alias("z"))

