"""Toxicity by weak supervision.

A bounded sample of labelled rows gives voters: a lexicon of words, stems that
are dense in a text, and patterns of its spelling.  A generative label model
takes the true class as hidden; it estimates each voter's rates of firing in
either class, the given label being one more voter that may err, and shrinks
the say of voters that are correlated within a class.  Its posteriors train a
linear classifier, which scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import Batches, lean
from weftgraph.llm.shingles import constants, mix, slices
from weftgraph.sources.cut import cut, drop, ship

#: Labelled rows that the model is fitted on at most, those of least hash of their doc_id.
SAMPLE_ROWS = 12_000
#: Voters at most, and the toxic rows, as a number and a share, in which one must fire.
VOTERS, SUPPORT_ROWS, SUPPORT_SHARE = 300, 4, 0.02
#: Share of toxic rows among those in which a voter fires, smoothed.
PRECISION = 0.6
#: Bytes of a stem, and the share of a text's words that must have it, twice at least.
STEM_BYTES, STEM_SHARE = 6, 0.006
#: From this score on a text is toxic.
THRESHOLD = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = constants(256, 23)[_LOWER]
_STEM_SALT = np.uint64(0x5851F42D4C957F2D)
#: Pattern voters, in this order: shouting, exclaiming, masked letters, drawn-out letters.
PATTERNS = 4


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 on division by 4; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, stem hashes (0 for a word no longer than its stem), rows of the words; pattern shares by row."""
    n = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    none = np.empty(0, np.uint64)
    shares = np.zeros((n, PATTERNS))
    if offsets[-1] == offsets[0]:
        return none, none, np.empty(0, np.int64), shares
    data, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]

    def by_row(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, np.diff(offsets))

    same = np.zeros(len(data), bool)
    same[3:] = (data[3:] == data[2:-1]) & (data[3:] == data[1:-2]) & (data[3:] == data[:-3]) & _SOLID[data[3:]]
    masked = np.zeros(len(data), bool)
    masked[1:-1] = (data[1:-1] == ord("*")) & _SOLID[data[:-2]] & _SOLID[data[2:]]
    shares = np.stack([by_row((data >= 65) & (data <= 90)), by_row(data == ord("!")), by_row(masked), by_row(same)], axis=1)
    solid = _SOLID[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = solid[heads]
    at = np.flatnonzero(solid)
    if not len(at):
        return none, none, np.empty(0, np.int64), shares
    begins = np.flatnonzero(start)
    word = np.cumsum(start)[at] - 1
    place = at - begins[word]
    terms = _BYTE[data[at]] * constants(int(place.max()) + 1, 29)[place]
    first = np.searchsorted(at, begins)
    whole = mix(np.add.reduceat(terms, first))
    stem = mix(np.add.reduceat(np.where(place < STEM_BYTES, terms, np.uint64(0)), first) ^ _STEM_SALT)
    length = np.diff(np.r_[first, len(at)])
    return whole, np.where(length > STEM_BYTES, stem, np.uint64(0)), np.searchsorted(offsets, begins, side="right") - 1, shares


def _fired(texts: pa.Array, voters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What fires: hashes and their rows, each pair once, with its share of the row's words; words by row; pattern shares.

    With voters, a sorted array of hashes, only those are looked for.
    """
    whole, stem, row, shares = _words(texts)
    total = np.bincount(row, minlength=len(texts))
    found = []
    for hashes, is_stem in ((whole, False), (stem, True)):
        keep = hashes != 0
        if voters is not None and len(voters):
            keep &= voters[np.minimum(np.searchsorted(voters, hashes), len(voters) - 1)] == hashes
        elif voters is not None:
            keep[:] = False
        h, r = hashes[keep], row[keep]
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(h)])
        h, r = h[first], r[first]
        share = count / np.maximum(1, total[r])
        if is_stem:
            dense = (share >= STEM_SHARE) & ((count >= 2) | (total[r] < 100))
            h, r, share = h[dense], r[dense], share[dense]
        found.append((h, r, share))
    h, r, share = (np.concatenate([a, b]) for a, b in zip(*found, strict=True))
    return h, r, share, total, shares


def _patterns(shares: np.ndarray) -> np.ndarray:
    """Pattern votes: more than these shares of a text's bytes."""
    return (shares > np.array([0.3, 0.005, 0.001, 0.01])).astype(np.float64)


def _features(texts: pa.Array, voters: np.ndarray) -> np.ndarray:
    """Votes of the voters and patterns, then how much of the text the voters' words make up, and how many fire."""
    h, r, share, _, shares = _fired(texts, voters)
    votes = np.zeros((len(texts), len(voters)))
    at = np.searchsorted(voters, h)
    votes[r, at] = 1
    mass = np.bincount(r, share, minlength=len(texts))
    many = np.stack([np.log1p(100 * mass), np.minimum(votes.sum(axis=1), 4)], axis=1)
    return np.concatenate([votes, _patterns(shares), many], axis=1)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden class for each row, and the voters' shrunk say.

    EM over rates of firing in either class.  Correlations of what the rates
    leave unexplained shrink a voter's say by how many others it goes with.
    """
    seen = np.column_stack([labels, votes])
    say = np.ones(seen.shape[1])
    q = np.where(labels > 0, 0.97, 0.03)
    prior = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
    for k in range(rounds):
        on = (q @ seen + 0.5) / (q.sum() + 1)
        off = ((1 - q) @ seen + 0.1) / ((1 - q).sum() + 1)
        # The label errs sometimes, but it names the classes: without these bounds they could drift apart from it.
        on[0], off[0] = np.clip(on[0], 0.8, 0.97), np.clip(off[0], 0.01, 0.1)
        if k == rounds // 2:
            rest = seen - np.outer(q, on) - np.outer(1 - q, off)
            size = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            related = rest.T @ rest / len(rest) / np.outer(size, size)
            np.fill_diagonal(related, 0)
            say = 1 / (1 + np.where(related > 0.1, related, 0).sum(axis=1))
        fires, not_ = np.log(on / off), np.log((1 - on) / (1 - off))
        logit = np.log(prior / (1 - prior)) + seen @ (say * fires) + (1 - seen) @ (say * not_)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, say


def linear_classifier(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the bias last, of a logistic regression on soft labels q, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - q) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted voter hashes and classifier weights, from at most SAMPLE_ROWS labelled rows that are not held out.

    Null labels and doc_ids are left out; a doc_id that is labelled more than once
    counts as toxic if any of its labels says so, and of its texts the first in
    order is learned from.  Without labels of both kinds
    there are no voters, and the bias alone gives the share of toxic labels.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # The sample is bounded, and so is what is broadcast and what is gathered.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")

    @lean
    def fires(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                h, r, *_ = _fired(batch.column(0).slice(a, b - a))
                toxic = batch.column(1).slice(a, b - a).to_numpy()[r]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(toxic.astype(np.int64))], ["h", "toxic"])

    sample = cut(sample, "labelled")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).head()
    if not total["toxic"] or total["toxic"] == total["n"]:
        share = total["toxic"] / total["n"] if total["n"] else 0.0
        drop(sample)
        return np.empty(0, np.uint64), np.r_[np.zeros(PATTERNS + 2), np.log((share + 1e-6) / (1 - share + 1e-6))]
    support = max(SUPPORT_ROWS, SUPPORT_SHARE * total["toxic"])
    base = total["toxic"] / total["n"]
    count = sample.mapInArrow(fires, "h long, toxic long").groupBy("h").agg(F.sum("toxic").alias("on"), F.count(F.lit(1)).alias("all"))
    count = count.where((F.col("on") >= support) & (F.col("on") + base >= PRECISION * (F.col("all") + 1)))
    chosen = count.orderBy(F.desc("on"), "h").limit(VOTERS).select("h").collect()
    voters = np.sort(np.array([x["h"] for x in chosen], np.int64).view(np.uint64))

    @lean
    def seen(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                x = np.column_stack([_features(batch.column(0).slice(a, b - a), voters), batch.column(1).slice(a, b - a).to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array([row.astype(np.float32).tobytes() for row in x], pa.binary())], ["x"])

    rows = sorted(bytes(r["x"]) for r in sample.mapInArrow(seen, "x binary").collect())
    drop(sample)
    x = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    q, _ = label_model(x[:, : len(voters) + PATTERNS], x[:, -1])
    return voters, linear_classifier(x[:, :-1], q)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """docs with all its columns and a last one of scores, from 0 to 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    voters, weights = model
    fields = list(docs.schema.fields)
    at = docs.columns.index("text")

    @lean
    def score(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            out = [np.empty(0)]
            for a, b in slices(texts):
                x = _features(texts.slice(a, b - a), voters)
                out.append(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, name])

    return docs.mapInArrow(score, StructType([*fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Only texts are scored; an empty or null one gets the score of a text in which
    nothing fires.  Repeated rows get equal rows, a null doc_id is not held out,
    and columns other than doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose text scores below THRESHOLD."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, fit(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)
