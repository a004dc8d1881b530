"""Nearest neighbours with one vantage-point tree per shard.

Vectors are dealt into shards by a hash of their row.  Each shard's tree splits
its vectors by their distance from a vantage point; a query skips a part whose
least possible distance, by the triangle inequality, times `factor` is beyond
its k-th best so far.  A factor of one gives exact results; a larger one prunes
more and may miss neighbours.  The shards' results are merged by distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import Batches, lean
from weftgraph.sources.cut import cut

#: Vectors of a shard on average, of a leaf at most, and queries that walk a tree together.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 48, 512


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of q to all rows of x; squares are added from left to right."""
    apart = q[:, None, :] - x[None, :, :]
    return np.sqrt(np.cumsum(apart * apart, axis=2)[:, :, -1])


class Tree:
    """A vantage-point tree over the rows of x with ids and row numbers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.rows, self.x = ids, rows, x
        self.compared = 0
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF_ROWS:
            self.nodes[here] = (rows,)
            return here
        # The vector farthest from the part's mean splits it best.
        part = self.x[rows]
        pick = int(np.argmax(((part - part.mean(axis=0)) ** 2).sum(axis=1)))
        d = distances(part[pick : pick + 1], part)[0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        self.nodes[here] = ()
        inner, outer = self._build(rows[near]), self._build(rows[far])
        self.nodes[here] = (rows[pick], (d[near].min(), d[near].max()), (d[far].min(), d[far].max()), inner, outer)
        return here

    def search(self, query_rows: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k best for each query, its own row left out; infinite where there are fewer."""
        best_d = np.full((len(q), k), np.inf)
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        stack = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, active, least = stack.pop()
            # The margin keeps rounding from pruning what ties.
            use = least * factor * (1 - 1e-9) <= best_d[active, -1]
            active, least = active[use], least[use]
            if not len(active):
                continue
            if len(self.nodes[node]) == 1:
                rows = self.nodes[node][0]
                d = distances(q[active], self.x[rows])
                self.compared += d.size
                ids = np.broadcast_to(self.ids[rows], d.shape)
                d = np.where(self.rows[rows][None, :] == query_rows[active][:, None], np.inf, d)
                d, ids = np.concatenate([best_d[active], d], axis=1), np.concatenate([best_i[active], ids], axis=1)
                order = np.lexsort((ids, d), axis=1)[:, :k]
                best_d[active], best_i[active] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
                continue
            vantage, (a, b), (c, e), inner, outer = self.nodes[node]
            d = distances(q[active], self.x[vantage : vantage + 1])[:, 0]
            self.compared += len(d)
            in_least = np.maximum(least, np.maximum(d - b, a - d))
            out_least = np.maximum(least, np.maximum(d - e, c - d))
            both = [(inner, active, in_least), (outer, active, out_least)]
            # The part that more queries are nearer to is walked first, so it goes on the stack last.
            stack += both[::-1] if (in_least <= out_least).mean() >= 0.5 else both
        return best_d, best_i


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose vec_id is divisible by `every`.

    Every row is a candidate, and a query but for its own row: rows that share a
    vec_id, or are equal, are found and asked for one by one.  Rows whose vec_id or
    vector is null, and vectors that are empty, zero or hold null or non-finite
    components, take no part.  Vectors are compared with those of the same length
    only.  Ties go to the smaller vec_id.  With fewer than k others, all are
    returned; an empty table gives no rows.  Other columns are ignored.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))
    # Written, so that a row keeps its number.
    rows = cut(rows.withColumn("dim", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    place = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    indexed = rows.select("dim", place.alias("shard"), F.lit(0).alias("query"), "row", "vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % every == 0).select("dim", every_shard.alias("shard"), F.lit(1).alias("query"), "row", "vec_id", "embedding")
    # One shard for each task, by its number.
    dealt = indexed.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("dim", "shard", "query", "row")

    @lean
    def search(batches: Batches) -> Batches:
        at, held, tree = None, [], None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            heads = np.flatnonzero(np.r_[True, (np.diff(np.stack(cols), axis=1) != 0).any(axis=0)]) if batch.num_rows else []
            for a, b in zip(heads, [*heads[1:], batch.num_rows], strict=True):
                place, part = (cols[0][a], cols[1][a]), batch.slice(a, b - a)
                if place != at:
                    at, held, tree = place, [], None
                numbers, ids, x = part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5))
                if not cols[2][a]:
                    held.append((ids, numbers, x))
                    continue
                if not held:
                    continue
                tree = tree or Tree(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for s in range(0, len(ids), QUERY_ROWS):
                    asked = slice(s, s + QUERY_ROWS)
                    d, i = tree.search(numbers[asked], x[asked], k, factor)
                    full = np.isfinite(d)
                    found = full.sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(numbers[asked], found)), pa.array(np.repeat(ids[asked], found)), pa.array(i[full]), pa.array(d[full])], ["row", "query_id", "vec_id", "score"]
                    )

    found = dealt.mapInArrow(search, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
