"""MinHash near-duplicates through a multi-index Hamming join.

Every distinct shingle set gets a signature of SYMBOLS MinHash symbols of 32
bits.  Two sets with a Jaccard similarity of 0.75 differ in a quarter of the
symbols on average; more than MOST of the 64 differ with a probability of about
1.4e-6.  The signature is split into CHUNKS chunks.  By the pigeonhole principle
two signatures with at most MOST < 2 * CHUNKS differing symbols have a chunk
with at most one differing symbol, so indexing each chunk once for each symbol
left out finds all pairs under the threshold.

Buckets are never expanded into pairs.  Each member meets its bucket's least
member; what lies within MOST symbols of it joins its group.  Buckets that hold
several groups after that are compared whole, in blocks, and give only the
pairs of groups to be united.  Each group then holds every pair under the
threshold; full shingle sets are compared in it, again in blocks, and spanning
links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import Batches, by_run, lean
from weftgraph.llm.shingles import constants, mix, shingle_sets, signatures, slices
from weftgraph.sources.cut import cut, drop, least_labels, ship

SYMBOLS, MOST, CHUNKS = 64, 33, 17
#: Rows of a bucket, and shingles of a group, that are compared in one block.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 65_536
#: Numbers that say which documents are compared in full, or go, are broadcast up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 128


def _chunks() -> list[np.ndarray]:
    return np.array_split(np.arange(SYMBOLS), CHUNKS)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """A row of int64 keys for each signature: each chunk with each one of its symbols left out."""
    sig, out = sig.astype(np.uint64), []
    weight = constants(SYMBOLS, 17)
    for chunk in _chunks():
        terms = mix(sig[:, chunk] + np.uint64(1)) * weight[chunk]
        whole = terms.sum(axis=1, dtype=np.uint64)
        out += [mix(whole - terms[:, k] + weight[i]) for k, i in enumerate(chunk)]
    return np.stack(out, axis=1).view(np.int64)


def _fixed(array: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as binary values."""
    flat = np.ascontiguousarray(array)
    width = flat.shape[1] * flat.itemsize
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """The inverse of _fixed."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1)


@lean
def _described(batches: Batches) -> Batches:
    multipliers = constants(SYMBOLS, 7)
    left, right = constants(2, 19)
    for batch in batches:
        for a, b in slices(batch.column(1)):
            s, offsets = shingle_sets(batch.column(1).slice(a, b - a))
            n = np.diff(offsets)
            hashes = []
            for salt in (left, right):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ salt), dtype=np.uint64)])
                hashes.append(mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)).view(np.int64))
            sig = signatures(s, offsets, multipliers)
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(n), *map(pa.array, hashes), _fixed(sig)], ["doc_id", "text_hash", "n", "h1", "h2", "sig"])


@lean
def _keyed(batches: Batches) -> Batches:
    for batch in batches:
        if batch.num_rows:
            keys = bucket_keys(_rows(batch.column(1), np.uint32))
            node = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])


@lean
def _near(batches: Batches) -> Batches:
    for batch in batches:
        if batch.num_rows:
            apart = (_rows(batch.column(2), np.uint8) != _rows(batch.column(3), np.uint8)).sum(axis=1)
            yield batch.filter(pa.array(apart <= MOST)).select(["a", "b"])


@lean
def _bytes_of(batches: Batches) -> Batches:
    """Each symbol's low byte: a distance on these is at most the distance on whole symbols."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), _fixed(_rows(batch.column(1), np.uint32).astype(np.uint8))], ["node", "low"])


def _united(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of labels that a bucket's block pair brings within MOST symbols."""
    key = np.stack([t.column(k).to_numpy() for k in ("key", "i", "j")])
    label, block, low = t.column("label").to_numpy(), t.column("block").to_numpy(), _rows(t.column("low"), np.uint8)
    at, found = np.arange(len(label)), []
    for d in range(1, len(label)):
        at = at[at + d < len(label)]
        at = at[(key[:, at] == key[:, at + d]).all(axis=0)]
        if not len(at):
            break
        use = at[label[at] != label[at + d]]
        # In a pair of two blocks, only what lies in different ones is compared.
        use = use[(key[1, use] == key[2, use]) | (block[use] != block[use + d])]
        for part in np.array_split(use, len(use) // 65536 + 1):
            hit = part[(low[part] != low[part + d]).sum(axis=1) <= MOST]
            if len(hit):
                found.append(np.unique(np.sort(np.stack([label[hit], label[hit + d]]), axis=0), axis=1))
    if found:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spanning links of a group's block pair: sets with 100 * intersection >= 75 * union."""
    comp, i, j, block, node = (t.column(k).to_numpy() for k in ("comp", "i", "j", "block", "node"))
    sets = t.column("set").to_pylist()
    heads = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    left, right = [], []
    for a, b in zip(heads, np.r_[heads[1:], len(comp)], strict=True):
        if b - a < 2:
            continue
        parts = [np.frombuffer(x, np.uint64) for x in sets[a:b]]
        n = np.array([len(x) for x in parts])
        offsets = np.r_[0, np.cumsum(n)]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        owner = np.repeat(np.arange(b - a), n)[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]]
        begin = np.flatnonzero(first)
        group = np.empty(len(values), np.int64)
        group[order] = np.cumsum(first) - 1
        length = np.diff(np.r_[begin, len(values)])
        root = np.arange(b - a)

        def find(x: int, root: np.ndarray = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in range(b - a):
            g = group[offsets[x] : offsets[x + 1]]
            size = length[g]
            g, size = g[size > 1], size[size > 1]
            if not len(g):
                continue
            spread = np.repeat(begin[g] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            common = np.bincount(owner[spread], minlength=b - a)
            hit = np.flatnonzero(100 * common >= 75 * (n[x] + n - common))
            hit = hit[hit > x]
            if i[a] != j[a]:
                hit = hit[block[a + hit] != block[a + x]]
            for y in hit:
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    left.append(node[a + x])
                    right.append(node[a + y])
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])


def _in_blocks(df: DataFrame, of: str, blocks: F.Column) -> DataFrame:
    """Deals the rows of each group `of` into blocks, and each block into its pairs of blocks (i <= j)."""
    df = df.withColumn("nb", blocks.cast("long")).withColumn("block", F.pmod(F.xxhash64("node"), "nb"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    return df.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("nb", "other")


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(described, told): doc_id, text_hash, n, h1, h2 of every row, and for each class (h1, h2) the row that stands for its component."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    described = cut(docs.mapInArrow(_described, "doc_id long, text_hash long, n long, h1 long, h2 long, sig binary"), "described")
    # A row that stands for its class: one with a doc_id, if any has one.
    row = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("row")
    classes = described.where("n > 0").groupBy("h1", "h2").agg(row, F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keyed = classes.select("node", "sig").mapInArrow(_keyed, "key long, node long")
    shared = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("key", "pivot")
    buckets = cut(keyed.join(shared, "key"), "buckets")
    low = cut(classes.select("node", "sig").join(buckets.select("node").distinct(), "node", "left_semi").mapInArrow(_bytes_of, "node long, low binary"), "low")

    star = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(low.select(F.col("node").alias("b"), F.col("low").alias("low_b")), "b").join(low.select(F.col("node").alias("a"), F.col("low").alias("low_a")), "a")
    coarse = cut(least_labels(star.select("a", "b", "low_a", "low_b").mapInArrow(_near, "a long, b long")), "coarse")

    placed = buckets.join(coarse, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi").select("key", "rows")
    blocks = _in_blocks(placed.join(mixed, "key").join(low, "node"), "key", F.ceil(F.col("rows") / BLOCK_ROWS)).drop("rows")
    united = by_run(blocks, ["key", "i", "j"], _united, "a long, b long")
    groups = cut(least_labels(coarse.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(united)), "groups")
    drop(buckets, low, coarse)

    members = groups.withColumnRenamed("label", "comp").join(classes.select("node", "h1", "h2", "n", "row"), "node")
    sizes = members.groupBy("comp").agg(F.sum("n").alias("total"))
    members = cut(members.join(sizes, "comp"), "members")
    wanted = members.select("h1", "h2", F.col("node"), "comp", "total", F.col("row.doc_id").alias("least"), F.col("row.text_hash").alias("its_hash"))

    @lean
    def full(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                s, offsets = shingle_sets(part.column("text"))
                left, right = constants(2, 19)
                n, same = np.diff(offsets), np.ones(b - a, bool)
                for salt, name in ((left, "h1"), (right, "h2")):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ salt), dtype=np.uint64)])
                    same &= mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)).view(np.int64) == part.column(name).to_numpy()
                whole = pa.array([s[offsets[k] : offsets[k + 1]].tobytes() for k in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("comp"), part.column("total"), whole], ["node", "comp", "total", "set"]).filter(pa.array(same))

    if members.count() * ROW_BYTES <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("text_hash") == F.col("its_hash"))).select("text", "h1", "h2", "node", "comp", "total")
    sets = texts.mapInArrow(full, "node long, comp long, total long, set binary").dropDuplicates(["node"])
    blocks = _in_blocks(sets, "comp", F.ceil(F.col("total") / BLOCK_SHINGLES)).drop("total")
    links = by_run(blocks, ["comp", "i", "j"], _linked, "a long, b long")
    final = cut(least_labels(links), "linked")

    named = final.join(classes.select("node", "row"), "node")
    named = named.join(named.groupBy("label").agg(F.min("row").alias("first")), "label").select("node", "first")
    told = cut(classes.select("node", "h1", "h2", "row").join(named, "node", "left").select("h1", "h2", F.coalesce("first", "row").alias("first")), "told")
    drop(groups, members, final, classes)
    return described, told


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Texts that are null, empty or blank have no shingles and are linked with
    nothing; their component is their own doc_id.  Whole texts are read, however
    long.  Repeated rows are alike and get equal results; a doc_id may come with
    several texts, each of which is a document.  A null doc_id takes part in links,
    but names no component unless nothing else does, and is not kept where its
    component has a name.  Columns other than doc_id and text are ignored.  An
    empty table gives no rows.
    """
    described, told = _judged(docs)
    out = described.select("doc_id", "n", "h1", "h2").join(told, ["h1", "h2"], "left")
    own = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns: one of each group of near-duplicates.

    A document is a pair of doc_id and text.  Of a group, the document of smallest
    doc_id stays, a null one only where the group has no other; of several texts
    of that doc_id the one of least hash.  Of rows equal in both, the one of least
    hash over all columns stays.  Rows without words are linked with nothing and
    all stay.  An empty table gives no rows; columns may have any names.
    """
    described, told = _judged(docs)
    rows = described.where("n > 0").groupBy("doc_id", "text_hash", "h1", "h2").agg(F.count(F.lit(1)).alias("rows")).join(told, ["h1", "h2"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    found = cut(rows.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), stays.alias("stays"), "rows"), "found")
    drop(described, told)
    gone, repeated = found.where("NOT stays").select("d", "t"), found.where("stays AND rows > 1").select("d", "t")
    n = found.agg(F.count_if(F.expr("NOT stays")), F.count_if(F.expr("stays AND rows > 1"))).head()
    gone, repeated = (F.broadcast(x) if k * ROW_BYTES <= BROADCAST_BYTES else x for x, k in zip((gone, repeated), n, strict=True))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    kept = keyed.join(gone, same, "left_anti")
    if n[1]:
        one = kept.join(repeated, same, "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(repeated, same, "left_anti").unionByName(one.select("row", "doc_id", "text_hash"))
    return kept.select("row.*")
