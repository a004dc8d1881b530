"""Iterative graph algorithms as loops over DataFrames; each round starts from a written table."""

from __future__ import annotations

import gc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import hashed
from weftgraph.operators.cleaning import both_ways
from weftgraph.sources.cut import cut, drop, least_labels


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def bfs(edges: DataFrame, source: object, most: int | None = None) -> DataFrame:
    """id, distance from `source` along directed edges, up to `most` steps; only what is reached."""
    return bfs_from(edges, edges.sparkSession.createDataFrame([(source,)], "id " + edges.schema["src"].dataType.simpleString()), most).drop("source")


def bfs_from(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, id, distance from each of `sources` (id); a frontier is extended until it is empty.

    The distinct edges are written once; a round reads them, the frontier and what
    has been reached.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen = front = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct())
    step = 0
    while most is None or step < most:
        step += 1
        reached = front.join(e, front["id"] == e["src"]).select("source", F.col("dst").alias("id")).distinct()
        front = cut(reached.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    drop(e)
    return seen.select("source", "id", "distance")


#: Words of 64 sources that one search of path_lengths carries, and bytes that a task's bits may take.
WORDS, STATE = 16, 320 << 20
#: Edges of a graph that each task may hold, 4 bytes each, and vertices.
HELD, HELD_VERTICES = 1 << 25, 1 << 22
#: In-neighbours of a vertex that are taken side by side with those of others, words of a row of vertices, and edges that the driver looks at together.
DEEP, ROW, SLICE = 512, 1 << 15, 1 << 20
#: Edges of a unit from which its first steps go from vertex to vertex, pairs at most that a word's step makes at once.
ONWARD, PAIRS = 1 << 22, 1 << 22
#: About the nanoseconds of a pair, of a word's step, of an edge that is looked up, and of a word that is read for it.
COSTS = 40, 100_000, 3, 4


def path_lengths(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """distance, n: how many pairs of a source and another vertex are so far apart, up to `most` steps.

    Pairs are never rows: a bit stands for a source that has reached a vertex.  The
    tasks hold the graph as numbers and search it for many sources at once, each
    task other sources.  A graph of over HELD edges or HELD_VERTICES vertices stays
    in tables, and one block of sources after the other goes through them.
    """
    spark = edges.sparkSession
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    marked = cut(vertices(e).withColumn("mark", F.monotonically_increasing_id()))
    # Marks start anew in each partition, high bits apart; numbers have no gaps.
    parts = sorted(map(tuple, marked.groupBy(F.shiftright("mark", 33).alias("part")).count().collect()))
    before = {part: sum(n for p, n in parts if p < part) for part, _ in parts}
    total = sum(n for _, n in parts)
    if not total:
        drop(e, marked)
        return spark.createDataFrame([], "distance int, n long")
    offset = F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair))[F.shiftright("mark", 33)]
    numbered = cut(marked.select("id", (offset + F.col("mark") % (1 << 33)).alias("number")))
    asked = cut(sources.select("id").distinct().join(numbered, "id").select("id", "number"))
    if total > HELD_VERTICES or e.count() > HELD:
        told = _lengths_in_tables(e, asked, total, most)
    else:
        told = _lengths_in_tasks(e, numbered, asked, total, most)
    drop(e, marked, numbered, asked)
    return spark.createDataFrame(sorted(told.items()), "distance int, n long")


def _lengths_in_tasks(e: DataFrame, numbered: DataFrame, asked: DataFrame, total: int, most: int | None) -> dict[int, int]:
    """distance -> pairs; e and the vertices (id, number below total) fit into a task."""
    spark = e.sparkSession
    s, d = numbered.select(F.col("id").alias("src"), F.col("number").cast("int").alias("s")), numbered.select(F.col("id").alias("dst"), F.col("number").cast("int").alias("d"))
    into = e.join(s, "src").join(d, "dst").groupBy("d").agg(F.collect_list("s").alias("from")).toArrow().to_batches()
    count, tails = np.zeros(total, np.int64), np.empty(sum(len(x.column("from").flatten()) for x in into), np.int32)
    start, n = np.zeros(total, np.int64), 0
    while into:
        # A batch goes when its edges are copied.
        x = into.pop()
        heads, lists, own = x.column("d").to_numpy(), x.column("from"), x.column("from").flatten().to_numpy()
        count[heads] = np.diff(lists.offsets.to_numpy())
        start[heads] = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py() + n
        tails[n : n + len(own)] = own
        n += len(own)
        del x, lists, own
    units = _units(tails, start, count, asked.select("number").toArrow().column("number").to_numpy())
    # The search reads no table; shuffle files go when the driver's objects do.
    drop(e, numbered, asked)
    del tails, s, d
    gc.collect()
    spark._jvm.System.gc()
    if not units:
        return {}
    words = int(min(WORDS, max(1, STATE // (16 * max(u[0] for u in units)))))
    blocks = [(k, first) for k, u in enumerate(units) for first in range(0, len(u[1]), 64 * words)]
    held = spark.sparkContext.broadcast(units)
    del units

    def search(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                unit, first = held.value[blocks[k][0]], blocks[k][1]
                size, own, near, rest, onward = unit
                if onward is None and sum(map(len, near)) >= ONWARD:
                    # The worker keeps the broadcast, and with it this.
                    onward = unit[-1] = _onward(size, near, rest)
                n = _search(size, near, rest, onward, own[first : first + 64 * words], most)
                yield pa.RecordBatch.from_arrays([pa.array(range(1, len(n) + 1), pa.int32()), pa.array(n, pa.int64())], ["distance", "n"])

    tasks = max(1, min(len(blocks), 16 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, len(blocks), 1, tasks).mapInArrow(search, "distance int, n long").groupBy("distance").agg(F.sum("n").alias("n")).collect()
    held.destroy()
    return {r["distance"]: r["n"] for r in found}


def _weak_labels(tails: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The least vertex of each one's component, directions ignored; roots hook onto smaller roots, a slice of edges after the other."""
    label = np.arange(len(count), dtype=np.int32)
    heads = np.argsort(start, kind="stable")
    heads = heads[count[heads] > 0]
    ends = np.cumsum(count[heads])
    for first in range(0, len(tails), SLICE):
        last = min(first + SLICE, len(tails))
        i, j = np.searchsorted(ends, (first, last - 1), "right")
        own = heads[i : j + 1]
        a, b = np.repeat(own, np.minimum(ends[i : j + 1], last) - np.maximum(start[own], first)), tails[first:last]
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != (up := label[label])).any():
                label = up
    return label


def _units(tails: np.ndarray, start: np.ndarray, count: np.ndarray, sources: np.ndarray) -> list[list]:
    """What is searched by itself, each of whole components: size, sources, k-th in-neighbours of the first so many vertices for each k, what vertices of over DEEP have beside, and a place for _onward().

    A unit's vertices are numbered in the order of their in-degrees, highest first.
    Components that hold no source are left out.  tails is overwritten.
    """
    label, total = _weak_labels(tails, start, count), len(count)
    size, asked = np.bincount(label, minlength=total), np.bincount(label[sources], minlength=total)
    size[asked == 0] = 0
    # Small components share a unit until it has the sources of a block or the vertices of the largest component.
    unit = (np.cumsum(asked) - asked) // (64 * WORDS) + (np.cumsum(size) - size) // max(64 * WORDS, size.max(initial=0))
    unit = np.where(size > 0, unit, -1)[label]
    order = np.lexsort((-count, unit))
    order = order[np.searchsorted(unit[order], 0) :]
    bounds = np.append(np.flatnonzero(np.diff(unit[order], prepend=-1)), len(order))
    local, place = np.zeros(total, np.int32), np.empty(total, np.int64)
    place[order] = np.arange(len(order))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        local[order[lo:hi]] = np.arange(hi - lo, dtype=np.int32)
    for first in range(0, len(tails), SLICE):
        tails[first : first + SLICE] = local[tails[first : first + SLICE]]
    own, units = np.sort(place[sources]), []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        at, n = start[order[lo:hi]], count[order[lo:hi]]
        many = np.searchsorted(-n, -np.arange(min(DEEP, n[0])), "left")
        near = [tails[at[:m] + k] for k, m in enumerate(many.tolist())]
        rest = [tails[x + DEEP : x + y] for x, y in zip(at.tolist(), n[: int(np.searchsorted(-n, -DEEP, "left"))].tolist(), strict=False)]
        units.append([hi - lo, own[slice(*np.searchsorted(own, (lo, hi)))] - lo, near, rest, None])
    return units


def _onward(size: int, near: list, rest: list) -> tuple[np.ndarray, np.ndarray]:
    """Where the out-neighbours of each vertex begin, and those of one after the other."""
    count = np.zeros(size + 1, np.int64)
    for own in [*near, *rest]:
        np.add.at(count, own + 1, 1)
    begin = np.cumsum(count)
    flat, at = np.empty(begin[-1], np.int32), begin[:-1].copy()
    for own in near:
        order = np.argsort(own)
        tails = own[order]
        first = np.flatnonzero(np.diff(tails, prepend=-1))
        n = np.diff(first, append=len(tails))
        flat[at[tails] + np.arange(len(tails)) - np.repeat(first, n)] = order
        at[tails[first]] += n
    for j, own in enumerate(rest):
        flat[at[own]] = j
        at[own] += 1
    return begin, flat


def _search(size: int, near: list, rest: list, onward: tuple | None, sources: np.ndarray, most: int | None) -> list[int]:
    """How many pairs of one of the sources and another vertex are 1, 2, ... steps apart.

    With `onward` the first steps go from vertex to vertex for as long as that makes
    few pairs.  Then a vertex is reached in a step if an in-neighbour was before it.
    Where few have changed, only in-neighbours that did are read; where few pairs
    are left, a vertex reads its in-neighbours until it has all sources.
    """
    words, bit = -(-len(sources) // 64), np.arange(len(sources))
    seen, after = np.zeros((size, words), np.uint64), np.zeros((size, words), np.uint64)
    seen[sources, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    full = np.bitwise_or.reduce(seen, axis=0)
    rows = max(1, ROW // words)
    todo, live, told, left = np.arange(size, dtype=np.int32), np.zeros(size, bool), [], size * len(sources) - len(sources)
    live[sources] = True
    if onward:
        (begin, flat), (pair, step, edge, word) = onward, COSTS
        fronts = [sources[k : k + 64] * 64 + np.arange(len(sources[k : k + 64])) for k in range(0, len(sources), 64)]
        while most is None or len(told) < most:
            made = [int((begin[(x >> 6) + 1] - begin[x >> 6]).sum()) for x in fronts]
            if max(made) > PAIRS or pair * sum(made) + step * words > edge * len(flat) + word * words * min(sum(made), len(flat)):
                break
            fronts = [_step(seen, k, x, begin, flat) for k, x in enumerate(fronts)]
            if not (n := sum(map(len, fronts))):
                return told
            told.append(n)
            left -= n
        live[:] = False
        for x in fronts:
            live[x >> 6] = True
    taken = np.empty((rows, words), np.uint64)

    def take(at: np.ndarray, out: np.ndarray) -> np.ndarray:
        return np.take(seen, at, axis=0, out=out[: len(at)], mode="clip")

    def beside(j: int) -> np.ndarray:
        return np.bitwise_or.reduce([np.bitwise_or.reduce(seen[rest[j][x : x + rows]], axis=0) for x in range(0, len(rest[j]), rows)], axis=0)

    while len(todo) and (most is None or len(told) < most):
        hubs, open_rows = todo[: int(np.searchsorted(todo, len(rest)))], len(todo) < size
        within = lambda some, m: some if not len(some) or some[-1] < m else some[: int(np.searchsorted(some, m))]
        if live.mean() < 0.25:
            touched = np.zeros(size, bool)

            def put(some: np.ndarray, touched=touched) -> None:
                fresh = some[~touched[some]]
                after[fresh] = seen[fresh]
                touched[fresh] = True

            for own in near:
                some = within(todo, len(own)) if open_rows else np.arange(len(own), dtype=np.int32)
                if not len(some):
                    break
                some = some[live[own[some]]] if open_rows else np.flatnonzero(live[own])
                for i in range(0, len(some), rows):
                    part = some[i : i + rows]
                    put(part)
                    after[part] |= take(own[part], taken)
            for j in hubs.tolist():
                if live[rest[j]].any():
                    put(np.array([j]))
                    after[j] |= beside(j)
            moved = np.flatnonzero(touched)
            swap = False
        else:
            few, moved, swap = left < 0.2 * size * len(sources), todo, True
            asking = []
            for i in range(0, len(todo), rows):
                own_rows = todo[i : i + rows]
                got = take(own_rows, np.empty((len(own_rows), words), np.uint64))
                span = slice(int(own_rows[0]), int(own_rows[-1]) + 1)
                whole = len(own_rows) == span.stop - span.start
                if few:
                    after[own_rows] = got
                    asking.append(own_rows)
                    continue
                # Rows are in the order of in-degrees, so those with a k-th in-neighbour come first.
                for own in near:
                    part = within(own_rows, len(own))
                    m = len(part)
                    if not m:
                        break
                    np.bitwise_or(got[:m], take(own[span][:m] if whole else own[part], taken), out=got[:m])
                after[own_rows] = got
            asking = np.concatenate(asking) if few else todo[:0]
            for own in near if few else []:
                asking, still = within(asking, len(own)), []
                for i in range(0, len(asking), rows):
                    part = asking[i : i + rows]
                    got = after[part]
                    got |= take(own[part], taken)
                    after[part] = got
                    still.append(part[(got != full).any(axis=1)])
                if not still:
                    break
                asking = np.concatenate(still)
            for j in hubs.tolist():
                if (after[j] != full).any():
                    after[j] |= beside(j)
        n, done = 0, []
        live[:] = False
        for i in range(0, len(moved), rows):
            part = moved[i : i + rows]
            now, new = after[part], seen[part]
            new ^= now
            n += int(np.bitwise_count(new).sum(dtype=np.int64))
            live[part] = new.any(axis=1)
            if not swap:
                seen[part] = now
            done.append(part[(now == full).all(axis=1)])
        if not n:
            break
        if swap:
            seen, after = after, seen
        # What has all sources is not asked again and stays so in both.
        done = np.concatenate(done)
        after[done] = full
        if len(done):
            open_ = np.zeros(size, bool)
            open_[todo] = True
            open_[done] = False
            todo = np.flatnonzero(open_).astype(np.int32)
        told.append(n)
        left -= n
    return told


def _step(seen: np.ndarray, word: int, front: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pairs (64 times a vertex, plus a bit of the word) that are one step after those of front and not seen before; they are then."""
    at, n = begin[front >> 6], begin[(front >> 6) + 1] - begin[front >> 6]
    pairs = flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64) << 6
    pairs |= np.repeat(front & 63, n)
    pairs.sort()
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    ids, bits = pairs >> 6, np.uint64(1) << (pairs & 63).astype(np.uint64)
    new = (seen[ids, word] & bits) == 0
    pairs, ids, bits = pairs[new], ids[new], bits[new]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    if len(first):
        seen[ids[first], word] |= np.bitwise_or.reduceat(bits, first)
    return pairs


def _lengths_in_tables(e: DataFrame, asked: DataFrame, total: int, most: int | None) -> dict[int, int]:
    """distance -> pairs; rows are vertices that a block of sources has reached."""
    spark, names, bits, told = e.sparkSession, [f"w{k}" for k in range(WORDS)], 64 * WORDS, Counter()
    bit = (F.col("number") % bits).cast("int")
    own = [F.when(F.floor(bit / 64) == k, F.expr("shiftleft(1L, cast(number % 64 AS int))")).otherwise(F.lit(0).cast("long")) for k in range(WORDS)]
    for first in range(0, total, bits):
        block = asked.where(F.col("number").between(first, first + bits - 1))
        now = cut(block.select("id", *(w.alias(n) for n, w in zip(names, own, strict=True)), *(w.alias(f"new_{n}") for n, w in zip(names, own, strict=True))))
        step = 0
        while most is None or step < most:
            step += 1
            front = now.where(" OR ".join(f"new_{n} <> 0" for n in names)).select("id", *(f"new_{n}" for n in names))
            sent = e.join(front, e["src"] == front["id"]).groupBy(F.col("dst").alias("id")).agg(*(F.bit_or(f"new_{n}").alias(f"got_{n}") for n in names))
            both = now.select("id", *names).join(sent, "id", "full").na.fill(0, [*names, *(f"got_{n}" for n in names)])
            after = cut(both.select("id", *(F.expr(f"{n} | got_{n}").alias(n) for n in names), *(F.expr(f"got_{n} & ~{n}").alias(f"new_{n}") for n in names)))
            drop(now)
            now = after
            n = now.agg(F.sum(F.expr(" + ".join(f"bit_count(new_{n})" for n in names)).cast("long"))).head()[0]
            if not n:
                break
            told[step] += n
        drop(now)
        # Shuffle files go when the driver's objects do.
        del now, front, sent, both, after
        gc.collect()
        spark._jvm.System.gc()
    return dict(told)


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest vertex of the connected component, directions ignored."""
    ids = cut(vertices(edges))
    found = least_labels(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return ids.join(found, ids["id"] == found["node"], "left").select("id", F.coalesce("label", "id").alias("component"))


def _spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """The least mark that reaches each vertex along edges within (id, mark); runs to a fixed point."""
    now = cut(marks)
    while True:
        sent = edges.join(now, edges["src"] == now["id"]).groupBy("dst").agg(F.min("mark").alias("m"))
        after = cut(now.join(sent, now["id"] == sent["dst"], "left").select("id", F.least("mark", "m").alias("mark")))
        same = after.join(now.withColumnRenamed("mark", "old"), "id").where("mark <> old").isEmpty()
        drop(now)
        now = after
        if same:
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest vertex of the strongly connected component.

    Vertices without an edge in or out among the rest are trimmed.  Then the least
    vertex that reaches each one colours it; going back from a colour's own vertex
    within the colour gives one component for each colour in a round, so a round
    settles as many components as there are colours.
    """
    rest_e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    rest_v = cut(vertices(edges))
    done = rest_v.withColumn("component", F.col("id")).limit(0)
    while not rest_v.isEmpty():
        both = rest_e.select(F.col("src").alias("id")).intersect(rest_e.select(F.col("dst").alias("id")))
        settled = cut(rest_v.join(both, "id", "left_anti").withColumn("component", F.col("id")))
        used = []
        if settled.isEmpty():
            colour = _spread(rest_e, rest_v.withColumn("mark", F.col("id")))
            c1, c2 = colour.select(F.col("id").alias("src"), F.col("mark").alias("x")), colour.select(F.col("id").alias("dst"), F.col("mark").alias("y"))
            own = cut(rest_e.join(c1, "src").join(c2, "dst").where("x = y").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            settled = front = cut(colour.where("id = mark").select("id", F.col("mark").alias("component")))
            while not front.isEmpty():
                step = own.join(front, own["src"] == front["id"]).select(F.col("dst").alias("id"), "component").distinct()
                front = cut(step.join(settled, "id", "left_anti"))
                settled = settled.unionByName(front)
            used = [colour, own]
        done = done.unionByName(settled)
        gone = settled.select("id")
        after_v = cut(rest_v.join(gone, "id", "left_anti"))
        after_e = cut(rest_e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        drop(rest_v, rest_e, *used)
        rest_v, rest_e = after_v, after_e
    return done


def bow_tie(edges: DataFrame) -> DataFrame:
    """id, part: core, in, out, tube or tendril, other (Broder et al. 2000); the core is the largest strong component, ties by id."""
    scc = cut(strong_components(edges))
    core_id = scc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    core = cut(scc.join(core_id, "component", "left_semi").select("id"))
    one = core.orderBy("id").limit(1)
    ahead = bfs_from(edges, one).select("id", F.lit(True).alias("ahead"))
    back = bfs_from(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), one).select("id", F.lit(True).alias("back"))
    near = both_ways(edges)
    weak = bfs_from(near, one).select("id", F.lit(True).alias("weak"))
    out = scc.select("id").join(ahead, "id", "left").join(back, "id", "left").join(weak, "id", "left")
    part = F.when(F.col("ahead") & F.col("back"), "core").when(F.col("back"), "in").when(F.col("ahead"), "out").when(F.col("weak"), "tendril").otherwise("other")
    return out.select("id", part.alias("part"))


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """id, rank after a fixed number of rounds from equal ranks; vertices without edges out give to all alike."""
    e = edges.select("src", "dst").distinct()
    e = cut(e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"))
    ids = vertices(e)
    n = ids.count()
    now = cut(ids.join(e.select(F.col("src").alias("id"), F.lit(True).alias("gives")).distinct(), "id", "left").select("id", F.coalesce("gives", F.lit(False)).alias("gives"), F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(rounds):
        sent = e.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        dangling = now.agg(F.coalesce(F.sum(F.when(~F.col("gives"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))
        after = cut(now.drop("rank").join(sent, "id", "left").join(F.broadcast(dangling)).select("id", "gives", rank.alias("rank")))
        drop(now)
        now = after
    drop(e)
    return now.select("id", F.round("rank", 8).alias("rank"))


def hits(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, hub, authority after a fixed number of rounds from equal hubs; both have length one."""
    e = cut(edges.select("src", "dst").distinct())
    ids = vertices(e)
    hub = ids.withColumn("hub", F.lit(1.0))

    def scaled(df: DataFrame, name: str) -> DataFrame:
        size = df.agg(F.sqrt(F.sum(F.col(name) * F.col(name))).alias("size"))
        return cut(df.join(F.broadcast(size)).select("id", (F.col(name) / F.col("size")).alias(name)))

    for _ in range(rounds):
        authority = scaled(e.join(hub.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority")), "authority")
        hub = scaled(e.join(authority.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("hub")), "hub")
    out = ids.join(hub, "id", "left").join(authority, "id", "left")
    return out.select("id", F.round(F.coalesce("hub", F.lit(0.0)), 8).alias("hub"), F.round(F.coalesce("authority", F.lit(0.0)), 8).alias("authority"))


def core(edges: DataFrame, k: int) -> DataFrame:
    """src, dst: the undirected edges of the k-core, what is left when vertices of a degree under k are removed until none is."""
    now = cut(edges.select("src", "dst"))
    while True:
        keep = now.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= k).select("id")
        after = cut(now.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        same = after.count() == now.count()
        drop(now)
        now = after
        if same:
            return now


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label: each round a vertex takes the label most frequent among its neighbours, ties to the smallest."""
    e = cut(both_ways(edges))
    now = cut(vertices(edges).withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = e.join(now.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        # The most frequent and then smallest label, as a partial aggregate: a hub's votes are not gathered.
        top = votes.groupBy(F.col("src").alias("id")).agg(F.max("n").alias("n"))
        after = cut(votes.withColumnRenamed("src", "id").join(top, ["id", "n"]).groupBy("id").agg(F.min("label").alias("label")))
        drop(now)
        now = after
    drop(e)
    return now


#: Edges that are ranked in one task, about.
RANKED = 65_536


def walk(edges: DataFrame, starts: DataFrame, steps: int, seed: str) -> DataFrame:
    """start, step, id: uniform random walks along directed edges; one ends where no edge leads on.

    A step's hash takes one of the neighbours by their rank, so the walk does not
    depend on the partitioning.  A hub's edges are ranked in blocks of a hash of the
    neighbour, each in a task of its own, and the counts of the blocks before are added.
    """
    e = cut(edges.select("src", "dst").distinct())
    out = cut(e.groupBy("src").agg(F.count(F.lit(1)).alias("out")))
    blocks = F.floor((F.col("out") - 1) / RANKED) + 1
    dealt = e.join(out, "src").withColumn("block", F.pmod(hashed(F.lit(seed), F.col("dst")), blocks))
    sums = dealt.groupBy("src", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("src", "block").orderBy("dst")) - 1
    ranked = cut(dealt.withColumn("k", inside).join(offsets, ["src", "block"]).select("src", (F.col("offset") + F.col("k")).alias("k"), "dst"))
    front = cut(starts.select(F.col("id").alias("start"), F.lit(0).alias("step"), "id"))
    found = front
    for step in range(1, steps + 1):
        pick = front.join(out, front["id"] == out["src"]).withColumn("k", F.pmod(hashed(F.lit(seed), F.col("start"), F.lit(step)), F.col("out")))
        front = cut(pick.select("start", "src", "k").join(ranked, ["src", "k"]).select("start", F.lit(step).alias("step"), F.col("dst").alias("id")))
        found = found.unionByName(front)
    drop(e, out, ranked)
    return found
