"""Byte-level BPE through a table of distinct words.

A first pass splits texts into words.  Each task collects texts into chunks; a
chunk gives its distinct words ranks by frequency and its texts become ranks.
The distinct words go, packed, to as many word blocks as there are, by a hash,
so that every distinct word meets all its chunks in one block.  There each
distinct word is encoded once.  The ids go back to the chunks, where they are
joined by position.  To decode, a chunk's distinct ids are joined to the table of
pieces, and its texts are put together from what the join gives.

A frequent word takes one place in each chunk, however often it occurs, so no
key is hot; what moves is packed and compressed.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.shared import Batches, lean
from weftgraph.sources.cut import ship

#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Word blocks: one for so many documents, within these bounds.
BLOCK_DOCS, BLOCKS = 16_000, (16, 1 << 20)
#: Distinct words encoded at once.
ENCODED_WORDS = 20_000

#: Fixed values of the vocabulary: how its pre-tokenizer splits, and its special token.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Bytes and arrays of unsigned integers, compressed; arrays go as planes of bytes."""
    import zstandard

    out = []
    for part in parts:
        if isinstance(part, np.ndarray):
            flat = np.ascontiguousarray(part, np.uint32)
            part = flat.view(np.uint8).reshape(-1, 4).T.tobytes()
        out += [struct.pack("<Q", len(part)), part]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[bytes]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<Q", raw, at)
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def integers(part: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def splitter(path: str):
    """A function from a text to its words, as the pre-tokenizer of the file at path splits it.

    A pattern splits texts of Latin letters; any other text goes through the
    library's own pre-tokenizer, whose tables of letters then hold.
    """
    import regex
    from tokenizers import Tokenizer

    find, other = regex.compile(SPLIT).findall, regex.compile("[^\x00-ɏ]").search
    own = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def words(text: str) -> list[str]:
        out: list[str] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(SPECIAL)
            out += find(part) if not other(part) else [part[a:b] for _, (a, b) in own(part)]
        return out

    return words


class _Chunk:
    """Texts as ranks of words, and the chunk's distinct words."""

    def __init__(self, number: int, blocks: int):
        self.number, self.blocks, self.held = number, blocks, 0
        self.index: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []

    def add(self, doc_id: int | None, words: list[str], size: int) -> None:
        index = self.index
        self.texts.append(np.fromiter([index.setdefault(w, len(index)) for w in words], np.uint32, len(words)))
        self.ids.append(doc_id)
        self.held += size

    def rows(self) -> Iterator[pa.RecordBatch]:
        flat, lengths = np.concatenate([np.empty(0, np.uint32), *self.texts]), np.fromiter(map(len, self.texts), np.uint32, len(self.texts))
        self.texts = []
        # Not by bincount, which would widen the whole array.
        count = np.zeros(len(self.index), np.int64)
        for a in range(0, len(flat), 1 << 18):
            count += np.bincount(flat[a : a + (1 << 18)], minlength=len(count))
        by_count = np.argsort(-count, kind="stable")
        # Words that occur once rank in the order in which they occur, so one number stands for each of them.
        rank = np.empty(len(by_count), np.uint32)
        rank[by_count] = np.minimum(np.arange(len(by_count)), np.count_nonzero(count > 1))
        named = list(self.index)
        self.index = {}
        named = [named[i].encode() for i in by_count]
        block = np.fromiter([zlib.crc32(w) % self.blocks for w in named], np.uint32, len(named))
        order = np.argsort(block, kind="stable")
        bounds = np.searchsorted(block[order], np.arange(self.blocks + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            part = [named[i] for i in order[bounds[k] : bounds[k + 1]]]
            yield _row(self.number, int(k), pack(np.fromiter(map(len, part), np.uint32, len(part)), b"".join(part)), None)
        yield _row(self.number, None, pack(lengths, np.array([np.count_nonzero(count > 1)]), rank[flat], block), self.ids)


def _row(chunk: int, block: int | None, data: bytes, docs: list[int | None] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([block], pa.int32()), pa.array([data], pa.binary()), pa.array([docs], pa.list_(pa.int64()))], ["chunk", "block", "data", "docs"]
    )


_ROWS = "chunk long, block int, data binary, docs array<long>"


def _chunked(docs: DataFrame, path: str, blocks: int) -> DataFrame:
    @lean
    def split(batches: Batches) -> Batches:
        words = splitter(path)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number, blocks)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                chunk.add(doc_id, words(text), len(text))
                if chunk.held >= CHUNK_BYTES:
                    yield from chunk.rows()
                    number += 1
                    chunk = _Chunk(number, blocks)
        if chunk.ids:
            yield from chunk.rows()

    return docs.mapInArrow(split, _ROWS)


def _encoded(rows: DataFrame, path: str, blocks: int) -> DataFrame:
    """Each word block's rows with ids in the words' places; a word is encoded once in its block.  Texts pass through."""

    @lean
    def encode(batches: Batches) -> Batches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, at = Tokenizer.from_file(path), None
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, bytes] = {}
        for batch in batches:
            texts = pc.is_null(batch.column(1))
            yield batch.filter(texts)
            words_only = batch.filter(pc.invert(texts))
            for chunk, block, data in zip(*(words_only.column(i).to_pylist() for i in range(3)), strict=True):
                if block != at:
                    at, known = block, {}
                lengths, text = unpack(data)
                ends = np.cumsum(integers(lengths), dtype=np.int64)
                words = [text[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
                new = [w for w in words if w not in known]
                for s in range(0, len(new), ENCODED_WORDS):
                    part = new[s : s + ENCODED_WORDS]
                    for w, e in zip(part, tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, np.uint32).tobytes()
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                yield _row(chunk, block, pack(counts, np.frombuffer(b"".join(ids), np.uint32)), None)

    # A chunk's texts go with any of the word blocks, so the rows are computed and dealt out once.
    place = F.coalesce(F.col("block"), F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("int"))
    return rows.repartition(place).sortWithinPartitions("block", "chunk").mapInArrow(encode, _ROWS)


@lru_cache(1)
def vocabulary_pieces(path: str) -> list[bytes]:
    """The bytes of each id's piece; the vocabulary bounds this table."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    letters = sorted(ByteLevel.alphabet(), key=ord)
    # Printable bytes stand for themselves; the others follow from U+0100 on, in order.
    rest = iter(x for x in range(256) if chr(x) not in letters)
    to_byte = {c: ord(c) if ord(c) < 256 else next(rest) for c in letters}
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.content}
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i) or ""
        out.append(token.encode() if i in special else bytes(to_byte[c] for c in token))
    return out


def _assembled(rows: DataFrame, schema: str, each) -> DataFrame:
    """each(chunk, doc_ids, words in each text, ranks of the words, starts and ends by rank, ids) for every chunk."""

    @lean
    def assemble(batches: Batches) -> Batches:
        held, at = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, block, data, docs = (batch.column(i)[k].as_py() for i in range(4))
                if chunk != at:
                    at, held = chunk, []
                if block is not None:
                    held.append((block, data))
                    continue
                lengths, repeated, ranks, of_block = map(integers, unpack(data))
                del data
                ranks = np.require(ranks, requirements="W")
                once = np.flatnonzero(ranks == repeated[0])
                ranks[once] = repeated[0] + np.arange(len(once), dtype=np.uint32)
                del once
                counts, ids = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
                for _, packed in sorted(held):
                    for out, part in zip((counts, ids), unpack(packed), strict=True):
                        out.append(integers(part))
                held = []
                counts, ids = np.concatenate(counts), np.concatenate(ids)
                ends = np.cumsum(counts, dtype=np.int64)
                where = np.empty(len(of_block), np.int64)
                where[np.argsort(of_block, kind="stable")] = np.arange(len(of_block))
                yield from each(chunk, docs, lengths, ranks, (ends - counts)[where], ends[where], ids)

    # By a number, so that tasks of few chunks are not put together: a task's rows are one batch in memory, here and in what follows.
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(number, "chunk").sortWithinPartitions("chunk", F.col("block").asc_nulls_last()).mapInArrow(assemble, schema)


def _through(docs: DataFrame, path: str, schema: str, each) -> DataFrame:
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = min(max(docs.count() // BLOCK_DOCS, BLOCKS[0]), BLOCKS[1])
    return _assembled(_encoded(_chunked(docs, path, blocks), path, blocks), schema, each)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for every row of docs (doc_id, text); a null text is an empty one, which has no ids."""

    def each(chunk, docs, lengths, ranks, starts, ends, ids):
        at = 0
        for doc_id, n in zip(docs, lengths.tolist(), strict=True):
            own = ranks[at : at + n]
            at += n
            size = (ends - starts)[own]
            found = ids[np.repeat(starts[own] - np.r_[0, np.cumsum(size)[:-1]].astype(np.int64), size) + np.arange(size.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([found.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _through(docs, path, "doc_id long, ids array<int>", each)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: a table that the vocabulary bounds."""
    return spark.createDataFrame(list(enumerate(map(bytearray, vocabulary_pieces(path)))), "id int, piece binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for every row of encoded (doc_id, ids), through a join of ids to pieces.

    Bytes that are no UTF-8 become U+FFFD; null ids give an empty text, and ids
    outside the vocabulary nothing.
    """
    rows = encoded.select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id())
    placed = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("at", "id"))
    joined = placed.join(F.broadcast(_pieces(encoded.sparkSession, path)), "id", "left").groupBy("row", "doc_id")
    found = joined.agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("found"))
    data = F.aggregate("found", F.lit(b""), lambda s, x: F.concat(s, F.coalesce(x["piece"], F.lit(b""))))
    return found.select("doc_id", F.decode(data, "UTF-8").alias("text"))


def _by_text(value: Callable, join: str | bytes, lengths: np.ndarray, ranks: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> Iterator[str | bytes]:
    """Of each text, the joined values of its words' ids; a distinct word's are joined once, and only its own ids are Python numbers at a time."""
    made = [join.join(map(value, ids[a:b].tolist())) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    at = 0
    for n in lengths.tolist():
        yield join.join([made[r] for r in ranks[at : at + n].tolist()])
        at += n


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text).

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the
    decoded text in UTF-8.  A null or empty text has no ids and decodes to an
    empty text.  Texts are read whole; a very long one is a chunk of its own.  Rows
    are independent: repeated ones give equal rows, null doc_ids are kept, other
    columns are ignored, an empty table gives no rows.
    """

    def each(chunk, docs, lengths, ranks, starts, ends, ids):
        wanted = np.unique(ids)
        for a in range(0, len(wanted), 10_000):
            part = wanted[a : a + 10_000].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array(part), *(pa.nulls(len(part), t) for t in kinds)], names)
        sizes, bounds = ends - starts, np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        n = [int(sizes[ranks[a:b]].sum()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        told = [hashlib.sha256(x.encode()).hexdigest() for x in _by_text(str, ",", lengths, ranks, starts, ends, ids)]
        del sizes
        parts = [np.ascontiguousarray(x, np.uint32) for x in (lengths, ranks, starts, ends, ids)]
        data = b"".join([struct.pack("<5Q", *map(len, parts)), *parts])
        whole = [pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), *(pa.array([x], t) for x, t in zip((docs, n, told, data), kinds, strict=True))]
        del parts, data
        yield pa.RecordBatch.from_arrays(whole, names)

    names = ["chunk", "id", "docs", "n", "told", "data"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]

    @lean
    def decoded(batches: Batches) -> Batches:
        """A chunk's ids with their pieces come first, then the chunk."""
        at, pieces = None, {}
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            whole = np.flatnonzero(pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False))
            before = 0
            for k in [*whole, batch.num_rows]:
                if before < k:
                    # Rows of one chunk stay together, and chunks follow each other.
                    if chunks[before] != at:
                        at, pieces = chunks[before], {}
                    pieces |= dict(zip(batch.column(1).slice(before, k - before).to_pylist(), batch.column(6).slice(before, k - before).to_pylist(), strict=True))
                if k < batch.num_rows:
                    if chunks[k] != at:
                        at, pieces = chunks[k], {}
                    raw = batch.column(5)[int(k)].as_buffer()
                    sizes = struct.unpack_from("<5Q", raw)
                    place, parts = 40, []
                    for n in sizes:
                        parts.append(np.frombuffer(raw, np.uint32, n, place))
                        place += 4 * n
                    texts = _by_text(pieces.__getitem__, b"", *parts)
                    right = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in texts]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c)[int(k)].values for c in (2, 3, 4)), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                before = k + 1

    chunks = _through(docs, path, "chunk long, id int, docs array<long>, n array<long>, told array<string>, data binary", each)
    joined = chunks.join(F.broadcast(_pieces(docs.sparkSession, path)), "id", "left").select(*names, "piece")
    return joined.mapInArrow(decoded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
