"""Word-shingle sets and MinHash signatures as Arrow and numpy kernels.

A word is a run of characters other than the space and U+0009 to U+000D, after
lower-casing A-Z only.  A document's set holds its distinct five-word shingles;
a document of one to four words has one shingle, the whole sequence; a null,
empty or blank text has the empty set.  Shingles are kept as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Texts are hashed in slices of about so many bytes, which bounds the memory of a batch.
SLICE_BYTES = 1 << 19
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd multipliers that depend on the seed alone."""
    start = np.array([seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


_PLACE = constants(WIDTH, 5)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text; a longer text stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_BYTE = constants(256, 11)[_LOWER]


def word_hashes(texts: pa.Array, of_words: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in order, and the row of the text that it is in; of_words tells which bytes words are made of."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    solid = of_words[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = solid[heads]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    begins = np.flatnonzero(start)
    place = at - begins[np.cumsum(start)[at] - 1]
    weight = constants(int(place.max()) + 1, 13)
    sums = np.add.reduceat(_BYTE[data[at]] * weight[place], np.searchsorted(at, begins))
    return mix(sums), np.searchsorted(offsets, begins, side="right") - 1


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and n + 1 offsets."""
    n = len(texts)
    h, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    sums, heads = np.zeros(len(h), np.uint64), np.minimum(counts, WIDTH)
    for k in range(min(WIDTH, len(h))):
        part = h[k:] * _PLACE[k]
        inside = owner[k:] == owner[: len(owner) - k]
        sums[: len(part)] += np.where(inside, part, np.uint64(0))
    at = np.arange(len(h)) - starts[owner]
    keep = at <= counts[owner] - heads[owner]
    s, o = mix(sums[keep]), owner[keep]
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    s, o = s[first], o[first]
    return s, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=n))])


def signatures(s: np.ndarray, offsets: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash signatures, a row of uint32 for each set; an empty set's row is all ones."""
    out = np.full((len(offsets) - 1, len(multipliers)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for k, a in enumerate(multipliers):
            out[full, k] = np.minimum.reduceat(((s * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out
