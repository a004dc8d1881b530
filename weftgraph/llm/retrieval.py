"""Exact top-k search by BM25 with block-max WAND pruning.

Documents are indexed in shards: for each word, the documents that hold it and
how often.  Queries are packed into blocks, which visit every shard; statistics
are those of the whole table, so a score is the same in any shard and the
shards' best are merged exactly.

In a shard the pivot test of block-max WAND is made for many documents at once.
Rare words' postings are added up.  For each frequent word the index has the
largest weight in each block of documents; a document can be skipped if its sum
so far and its block's maxima stay below the k-th best score known.  What is
left is scored in full.

Weights are rounded to millionths and added as integers, so sums and ties do
not depend on the order of addition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.bpe import integers, pack, unpack
from weftgraph.llm.shared import Batches, lean
from weftgraph.llm.shingles import slices, word_hashes
from weftgraph.sources.cut import cut, ship

K1, B, UNIT = 1.2, 0.75, 1_000_000
#: Documents and postings of a shard at most (a longer document is a shard of its own), and documents of a block.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS = 16_384, 4_000_000, 128
#: A word is frequent in a shard if one in so many documents holds it.
FREQUENT = 6
#: Numbers of up to so many shards are broadcast; more are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000
#: Queries that visit a shard together, about.
QUERY_BLOCK = 256

_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of each text by row, their rows and counts, and the words of each row."""
    h, row = word_hashes(texts, _SOLID)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, np.int64)
    return h[first], row[first], np.diff(np.r_[first, len(h)]), np.bincount(row, minlength=len(texts))


def _longs(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.uint64).tobytes()


class _Builder:
    """Collects documents into the index of one shard."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.postings = self.words = 0

    def add(self, ids: np.ndarray, h: np.ndarray, row: np.ndarray, count: np.ndarray, length: np.ndarray) -> None:
        self.parts.append((h, (row + self.docs).astype(np.uint32), count.astype(np.uint32)))
        self.ids.append(ids)
        self.lengths.append(length)
        self.docs += len(ids)
        self.postings += len(h)
        self.words += int(length.sum())

    def index(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Sorted words, how many documents hold each, and all of it packed."""
        h, row, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        # Rows come in order, so a stable sort by word leaves each word's rows in order.
        order = np.argsort(h, kind="stable")
        h = h[order]
        row = row[order]
        count = count[order]
        del order
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        df = np.diff(np.r_[first, len(h)])
        step = row.copy()
        step[1:] -= row[:-1]
        step[first] = row[first]
        lengths, ids = np.concatenate(self.lengths), np.concatenate(self.ids)
        return h[first], df, pack(_longs(ids.view(np.uint64)), lengths, _longs(h[first]), df, step, count)


def _indexed(docs: DataFrame) -> DataFrame:
    """shard, its documents and their length in words, sorted word hashes, their document frequencies, and the packed index."""

    @lean
    def build(batches: Batches) -> Batches:
        number, builder = TaskContext.get().partitionId() << 32, _Builder()

        def flush() -> pa.RecordBatch:
            words, df, data = builder.index()
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([builder.docs], pa.int64()), pa.array([builder.words], pa.int64()), pa.array([_longs(words)]), pa.array([df.astype(np.uint32).tobytes()]), pa.array([data])],
                ["shard", "docs", "length", "words", "frequencies", "index"],
            )

        for batch in batches:
            for a, b in slices(batch.column(1)):
                h, row, count, length = terms(batch.column(1).slice(a, b - a))
                if builder.docs and (builder.docs + b - a > SHARD_DOCS or builder.postings + len(h) > SHARD_POSTINGS):
                    yield flush()
                    number, builder = number + 1, _Builder()
                builder.add(batch.column(0).slice(a, b - a).to_numpy(), h, row, count, length)
        if builder.docs:
            yield flush()

    return docs.mapInArrow(build, "shard long, docs long, length long, words binary, frequencies binary, index binary")


class Shard:
    """An index, ready for queries."""

    def __init__(self, data: bytes, average: float):
        ids, lengths, words, df, step, count = unpack(data)
        self.ids = np.frombuffer(ids, np.int64)
        self.words = np.frombuffer(words, np.uint64)
        df, step, self.count = integers(df), integers(step), integers(count)
        self.start = np.r_[0, np.cumsum(df, dtype=np.int64)]
        # Steps begin anew with each word; sums may wrap around, their differences do not.
        total = np.cumsum(step, dtype=np.uint32)
        before = np.where(self.start[:-1] > 0, total[self.start[:-1] - 1], np.uint32(0)) if len(total) else total
        total -= np.repeat(before, df)
        self.doc = total.view(np.int32)
        self.norm = K1 * (1 - B + B * integers(lengths) / average)
        n = len(self.ids)
        self.frequent = np.flatnonzero(df * FREQUENT >= n)
        self.dense_of = np.full(len(self.words), -1)
        self.dense_of[self.frequent] = np.arange(len(self.frequent))
        self.dense = np.zeros((len(self.frequent), n), np.int32)
        self.block_max = np.zeros((len(self.frequent), -(-n // BLOCK_DOCS)), np.int64)
        self.weight = np.zeros(len(self.doc), np.int32)
        self.known = np.zeros(len(self.words), bool)

    def learn(self, found: np.ndarray, idf: np.ndarray) -> None:
        """Weights of the words at `found`, which no query changes: they are computed once."""
        new = ~self.known[found]
        found, idf = found[new], idf[new]
        self.known[found] = True
        size = self.start[found + 1] - self.start[found]
        at = np.repeat(self.start[found] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        for a in range(0, len(at), 500_000):
            part = at[a : a + 500_000]
            count = self.count[part]
            share = count * (K1 + 1) / (count + self.norm[self.doc[part]])
            self.weight[part] = np.rint(np.repeat(idf, size)[a : a + 500_000] * share * UNIT)
        for t in found[self.dense_of[found] >= 0]:
            k, at = self.dense_of[t], slice(self.start[t], self.start[t + 1])
            self.dense[k, self.doc[at]] = self.weight[at]
            np.maximum.at(self.block_max[k], self.doc[at] // BLOCK_DOCS, self.weight[at])

    def best(self, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents for the learned words at `found`, by score and then id; scores are over 0."""
        dense = self.dense_of[found]
        rare, often = found[dense < 0], dense[dense >= 0]
        size = self.start[rare + 1] - self.start[rare]
        at = np.repeat(self.start[rare] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        total = np.bincount(self.doc[at], self.weight[at], minlength=len(self.ids)).astype(np.int64)
        least = 1
        if len(often):
            if len(total) > 4 * k:
                start = np.argpartition(total, -4 * k)[-4 * k :]
                least = max(least, np.partition(total[start] + self._frequent(often, start), -k)[-k])
            bound = self.block_max[often].sum(axis=0)
            docs = np.flatnonzero(total + np.repeat(bound, BLOCK_DOCS)[: len(total)] >= least)
            scores = total[docs] + self._frequent(often, docs)
        else:
            docs = np.flatnonzero(total)
            scores = total[docs]
        if len(docs) > k:
            least = max(least, np.partition(scores, -k)[-k])
        keep = scores >= least
        docs, scores = docs[keep], scores[keep]
        order = np.lexsort((self.ids[docs], -scores))[:k]
        return self.ids[docs[order]], scores[order]

    def _frequent(self, often: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """What the frequent words add to the scores of docs."""
        if 4 * len(docs) < len(self.ids):
            return self.dense[np.ix_(often, docs)].sum(axis=0, dtype=np.int64)
        out = np.zeros(len(self.ids), np.int64)
        for k in often:
            out += self.dense[k]
        return out[docs]


@lean
def _packed_queries(batches: Batches) -> Batches:
    """Blocks of queries from rows (query, block, terms, df): the block's words once, and each query's places among them."""

    def packed(rows: list[tuple]) -> bytes:
        h, at = np.unique(np.concatenate([np.array(r[1], np.int64).view(np.uint64) for r in rows]), return_inverse=True)
        df = np.zeros(len(h), np.uint32)
        df[at] = np.concatenate([np.array(r[2], np.uint32) for r in rows])
        ids = np.array([r[0] for r in rows], np.int64)
        return pack(_longs(ids.view(np.uint64)), np.array([len(r[1]) for r in rows]), _longs(h), df, at)

    held: list[tuple] = []
    for batch in batches:
        for q, t, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.append((q, t, d))
            if len(held) == QUERY_BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([packed(held)])], ["data"])
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([packed(held)])], ["data"])


def search(docs: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: the k best rows for each row whose doc_id is divisible by `every`.

    A query is the set of words of its whole text; all rows, its own too, are
    searched.  A word is a run of ASCII letters and digits and of other than
    ASCII characters, A-Z in lower case.  A score is the sum of the words'
    weights in millionths; only rows with a score over 0 are returned, fewer than
    k if there are not as many.  Ties go to the smaller doc_id; repeated rows
    take a rank each.  A doc_id names one query: of several texts the first in
    order counts.  Rows with a null doc_id count in the statistics, but are
    neither queries nor results.  Null and empty texts have no words; texts are read
    whole, a very long one as a shard of its own.  Other columns are ignored, and an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id IS NOT NULL")
    nameless = docs.where("doc_id IS NULL")
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    index = cut(_indexed(named.coalesce(shards)), "index")

    @lean
    def frequencies(batches: Batches) -> Batches:
        for batch in batches:
            for words, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, n = np.frombuffer(words, np.int64), np.frombuffer(df, np.uint32).astype(np.int64)
                for a in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000]), pa.array(n[a : a + 100_000])], ["term", "df"])

    @lean
    def nameless_terms(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                h, row, count, length = terms(batch.column(0).slice(a, b - a))
                # Rows without a term carry the lengths of the documents.
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.ones(len(h), np.int64)), pa.array(np.zeros(len(h), np.int64))], ["term", "df", "length"])
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(length), pa.int64()), pa.array(np.zeros(len(length), np.int64)), pa.array(length.astype(np.int64))], ["term", "df", "length"])

    others = nameless.select("text").mapInArrow(nameless_terms, "term long, df long, length long")
    other_words = others.where("term IS NULL").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).head()
    own = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("shards")).head()
    n, words = own["n"] + other_words["n"], own["words"] + other_words["words"]
    average = max(words / max(n, 1), 1e-9)

    asked = named.where(F.col("doc_id") % every == 0).groupBy("doc_id").agg(F.min("text").alias("text"))

    @lean
    def asked_terms(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                h, row, _, _ = terms(batch.column(1).slice(a, b - a))
                ids = batch.column(0).slice(a, b - a).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(h.view(np.int64))], ["query", "term"])

    df = index.select("words", "frequencies").mapInArrow(frequencies, "term long, df long")
    df = df.unionByName(others.where("term IS NOT NULL").select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    placed = asked.mapInArrow(asked_terms, "query long, term long").join(df, "term")
    queries = placed.groupBy("query").agg(F.collect_list(F.struct("term", "df")).alias("x"))
    queries = queries.select("query", F.col("x.term").alias("term"), F.col("x.df").alias("df"))
    blocks = cut(queries.mapInArrow(_packed_queries, "data binary"), "queries")

    # Each block of queries visits every shard.
    groups = max(1, own["shards"])
    number = F.row_number().over(Window.orderBy("shard")).cast("long") - 1
    numbers = index.select("shard", number.alias("group"))
    if groups <= BROADCAST_SHARDS:
        numbers = F.broadcast(numbers)
    dealt = index.join(numbers, "shard").select("group", F.lit(0).alias("kind"), F.col("index").alias("data"))
    visits = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(1).alias("kind"), "data")

    @lean
    def visit(batches: Batches) -> Batches:
        at, held = None, []
        for batch in batches:
            for group, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if group != at:
                    at, held = group, []
                if kind == 0:
                    held.append(Shard(data.as_py(), average))
                    continue
                ids, sizes, h, df, places = unpack(data.as_py())
                ids, h, ends = np.frombuffer(ids, np.int64), np.frombuffer(h, np.uint64), np.cumsum(integers(sizes), dtype=np.int64)
                df, places = integers(df).astype(np.float64), integers(places)
                idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
                q, d, s = [], [], []
                for shard in held:
                    if not len(shard.words):
                        continue
                    found = np.searchsorted(shard.words, h)
                    found = np.where(shard.words[np.minimum(found, len(shard.words) - 1)] == h, found, -1)
                    shard.learn(found[found >= 0], idf[found >= 0])
                    for query, a, b in zip(ids.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                        own = places[a:b]
                        own = own[found[own] >= 0]
                        docs, scores = shard.best(found[own], k)
                        q.append(np.full(len(docs), query))
                        d.append(docs)
                        s.append(scores)
                if q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q).astype(np.int64)), pa.array(np.concatenate(d)), pa.array(np.concatenate(s).astype(np.int64))], ["query_id", "doc_id", "units"])

    # More partitions than shards, so that few shards meet in one.
    near = dealt.unionByName(visits).repartition(4 * groups, "group").sortWithinPartitions("group", "kind").mapInArrow(visit, "query_id long, doc_id long, units long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("units"), "doc_id"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "doc_id", (F.col("units") / F.lit(float(UNIT))).alias("score"))
