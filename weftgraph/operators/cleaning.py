"""From pages to edges: quarantine, links, canonical edges, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalars import host, resolve

HREF = r'href="([^"]*)"'

#: Host names that look like contamination; a reading of names, not a label.
BAD_HOST = r"(casino|pills|adult|ads-|spam|bets)"


def page_rules() -> dict[str, Column]:
    """Reasons to reject a page; a rule that is null does not hold."""
    return {
        "no url": F.col("url").isNull(),
        "no host": F.col("url").isNotNull() & host(F.col("url")).isNull(),
        "suspicious host": host(F.col("url")).rlike(BAD_HOST),
        "no html": F.col("html").isNull() | (F.col("html") == ""),
    }


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df and `reason`, the names of the rules that hold, an empty array where none does."""
    named = F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return df.withColumn("reason", F.filter(named, lambda x: x.isNotNull()))


def split_clean(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected); the rejected rows keep their reasons, so together they are the input."""
    judged = quarantine(df, rules)
    return judged.where(F.size("reason") == 0).drop("reason"), judged.where(F.size("reason") > 0)


def links(pages: DataFrame) -> DataFrame:
    """page_id, host, href, target: one row for each link in a page's html."""
    found = F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), found.alias("href"))
    return rows.select("page_id", "host", "href", resolve(F.col("url"), F.col("href")).alias("target"))


def incidence(pages: DataFrame) -> DataFrame:
    """left, right: distinct pairs of a host and a path that its pages link to."""
    return links(pages).where("host IS NOT NULL").select(F.col("host").alias("left"), F.col("href").alias("right")).distinct()


#: Left-hand vertices of a block: a right-hand vertex with more is dealt into pairs of blocks.
BLOCK = 4096


def project(pairs: DataFrame) -> DataFrame:
    """src < dst, weight: how many right-hand vertices two left-hand ones share.

    The result has a row for each pair with a common neighbour, so a right-hand
    vertex of degree d adds d * (d - 1) / 2 rows before aggregation; no task has
    more than the pairs of two blocks of them.
    """
    pairs = pairs.distinct()
    blocks = pairs.groupBy("right").agg((F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1).alias("blocks"))
    dealt = pairs.join(blocks, "right").withColumn("block", F.pmod(F.xxhash64("left"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("right", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "left", "block")
    a, b = dealt.withColumnsRenamed({"left": "src", "block": "x"}), dealt.withColumnsRenamed({"left": "dst", "block": "y"})
    # Two of one block meet wherever the block does; they count where it meets itself.
    met = a.join(b, ["right", "i", "j"]).where("src < dst AND (x <> y OR i = j)")
    return met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def undirect(edges: DataFrame) -> DataFrame:
    """Canonical undirected edges: src < dst, weights added, no self-loops."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
