"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's share of all tokens is raised to an exponent between 1, the natural
mix, and 0, equal shares.  The exponent is bisected: the largest at which the
mix has the target entropy, but no smaller than the least at which no source is
repeated beyond the limit.  A source's normalised weight gives it a budget of
tokens.  Whole passes over the source come first; the rest of the budget takes
the source's blocks in a permuted order, and the documents of a block in the
order of a hash, until it is used up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.cut import cut

#: Documents of a block on average.
BLOCK_DOCS = 512
#: Halvings of the exponent's interval, and how many of them one pass over the sources makes.
HALVINGS, PER_PASS = 32, 4
#: A token is a run of characters other than the space and U+0009 to U+000D.
TOKEN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """entropy: the target, as a share of the logarithm of the number of sources.  repeats: how often a source may
    be used at most.  budget: tokens of the mix; None takes as many as there are."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: int | None = None
    seed: str = "0"


def _number(text: Column) -> Column:
    """A non-negative long of 60 bits that the text decides in any language."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, mix: Mix) -> tuple[float, int]:
    """The exponent, rounded to nine places, and the number of all tokens; sources: key, tokens (over 0).

    Each pass is one aggregate over the table of sources, and one row comes back.
    """
    total, n = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).head()
    if n < 2:
        return 1.0, total
    budget = total if mix.budget is None else mix.budget
    logs = sources.select(F.ln(F.col("tokens") / F.lit(float(total))).alias("lp"))

    def measures(a: float) -> list[Column]:
        p = F.exp(a * F.col("lp"))
        return [F.sum(p), F.sum(p * F.col("lp")), F.max(F.exp((a - 1) * F.col("lp")))]

    entropy, repeats = [0.0, 1.0], [0.0, 1.0]
    parts = 1 << PER_PASS
    for _ in range(HALVINGS // PER_PASS):
        grids = [[lo + (hi - lo) * k / parts for k in range(parts + 1)] for lo, hi in (entropy, repeats)]
        inner = [a for grid in grids for a in grid[1:-1]]
        row = logs.agg(*(c.alias(f"c{i}") for i, c in enumerate(c for a in inner for c in measures(a)))).head()
        met = []
        for i, a in enumerate(inner):
            z, s, most = row[3 * i : 3 * i + 3]
            high = _entropy(z, s, a) >= mix.entropy * math.log(n)
            met.append(high if i < parts - 1 else budget / total * most / z <= mix.repeats)
        # Both conditions hold on one side of one point of the grid.
        k = sum(met[: parts - 1])
        entropy = grids[0][k : k + 2]
        k = parts - 1 - sum(met[parts - 1 :])
        repeats = grids[1][k : k + 2]
    return round(max(entropy[0], repeats[1]), 9), total


def _entropy(z: float, s: float, a: float) -> float:
    """Entropy of weights p ** a / z, with s the sum of p ** a * ln p."""
    return math.log(z) - a * s / z


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, tokens, weight, copies, block, place for every row of docs (doc_id, text, source).

    copies is how often the mix uses the document.  place is the number of tokens
    before it in its source's permuted order.  A null source is a source of its
    own.  A source without tokens has the weight 0 and is not used.  Rows with the
    same doc_id, source and text are told apart by their places alone.  Null texts
    have no tokens; null doc_ids count as empty text in hashes.  Other columns
    are ignored; an empty table gives no rows.

    Documents are not cut, so a source ends before the first document, in its
    permuted order, that does not fit into the rest of its budget.  It falls short
    of its budget by less than that document's tokens.  A source of positive
    weight is absent from the mix, with copies 0 throughout, if its budget allows
    no whole pass and its first document is longer than the budget.

    Sources are pre-aggregated, and a source's documents are numbered in blocks,
    so no task holds a source; blocks are numbered by sums over the blocks before.
    """
    decided = _decided(docs, mix)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("k")
    each = decided.select("*", k).withColumn("place", F.col("place") + F.col("k") * F.col("tokens"))
    return each.select("doc_id", "source", "tokens", "weight", _copies().alias("copies"), "block", "place")


def _copies() -> Column:
    """Whole passes, and one more where the document ends within the rest of the budget."""
    return F.when(F.col("all") > 0, F.col("passes") + (F.col("place") + F.col("tokens") <= F.col("rest")).cast("long")).otherwise(F.lit(0).cast("long"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"),
        F.md5(text.cast("binary")).alias("digest"),
    )


def _decided(docs: DataFrame, mix: Mix) -> DataFrame:
    rows = _keyed(docs).groupBy("doc_id", "source", "digest", "tokens").agg(F.count(F.lit(1)).alias("times"))
    rows = cut(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix")
    sources = cut(rows.groupBy("key").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("rows")), "sources")
    power, total = exponent(sources.where("tokens > 0"), mix)
    budget = total if mix.budget is None else mix.budget

    raised = F.when(F.col("tokens") > 0, F.exp(F.lit(power) * F.ln(F.col("tokens") / F.lit(float(max(total, 1)))))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(raised)).head()[0] or 1.0
    weight = raised / F.lit(z)
    quota = F.floor(F.round(F.lit(float(budget)) * weight, 3)).cast("long")
    plan = sources.select(
        "key",
        F.round(weight, 9).alias("weight"),
        F.col("tokens").alias("all"),
        quota.alias("quota"),
        F.ceil(F.col("rows") / F.lit(BLOCK_DOCS)).cast("long").alias("blocks"),
    )
    passes = F.when(F.col("all") > 0, F.floor(F.col("quota") / F.col("all"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("all"))

    name = F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"))
    rows = rows.withColumn("order", _number(name)).join(plan, "key").withColumn("block", F.pmod("order", "blocks"))
    mass = F.sum(F.col("tokens") * F.col("times"))
    blocks = rows.groupBy("key", "block").agg(mass.alias("in_block"))
    shuffled = _number(F.concat_ws(":", F.lit(mix.seed), F.col("key"), F.col("block").cast("string")))
    before = Window.partitionBy("key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("turn", shuffled).select("key", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("key", "block").orderBy("order", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(mass.over(within), F.lit(0))).join(offsets, ["key", "block"])
    return rows.withColumn("place", F.col("offset") + F.col("inside"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, with all columns, each as often as the mix uses it.

    Rows with the same doc_id, source and text count as one document, whose other
    columns come from any of them.
    """
    decided = cut(_decided(docs, mix), "decided")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("k")
    copies = decided.select("*", k).withColumn("place", F.col("place") + F.col("k") * F.col("tokens"))
    copies = copies.groupBy("doc_id", "source", "digest").agg(F.sum(_copies()).alias("copies")).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("digest").alias("_t"), "copies")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(text.cast("binary")).alias("digest"))
    if not decided.where("times > 1").isEmpty():
        rows = rows.groupBy("doc_id", "source", "digest").agg(F.first("row").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("digest") == F.col("_t"))
    used = rows.join(copies, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k"))
    return used.select("row.*")

