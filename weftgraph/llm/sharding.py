"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions only.

A stable 64-bit key, the first half of the MD5 of the decimal doc_id, seeds a
linear congruential generator; each draw jumps to the next shard count at which
the key would move.  The last jump below the shard count is the shard.  There is
no ring table, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the generator's multiplier, in two 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
#: So many jumps suffice for nearly every key; the others take as many as there are shards.
USUAL_JUMPS = 48
#: Rows that are numbered in one task.
NUMBERED_ROWS = 50_000


def _next(k: str) -> str:
    """k * multiplier + 1 modulo 2^64 on a signed long, in 16-bit limbs so that nothing overflows."""
    hi, lo = MULTIPLIER_HIGH, MULTIPLIER_LOW
    k0, k1, k2, k3 = (f"(shiftrightunsigned({k}, {s}) & 65535L)" for s in (0, 16, 32, 48))
    low = f"({k0} * {lo}L + shiftleft({k1} * {lo}L & 65535L, 16) + 1L)"
    high = f"(shiftrightunsigned({low}, 32) + shiftrightunsigned({k1} * {lo}L, 16) + {k2} * {lo}L + shiftleft({k3} * {lo}L & 65535L, 16) + {k0} * {hi}L + shiftleft({k1} * {hi}L & 65535L, 16))"
    return f"(shiftleft({high} & 4294967295L, 32) | ({low} & 4294967295L))"


def jump_hash(key: str, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of the long that the SQL expression `key` gives."""
    if shards < 1:
        raise ValueError("shards must be 1 at least")

    def jumps(start: str, most: int) -> str:
        step = f"named_struct('k', {_next('s.k')}, 'b', s.j, 'j', CAST(floor((s.j + 1) * (2147483648D / (shiftrightunsigned(s.k, 33) + 1L))) AS BIGINT))"
        return f"aggregate(sequence(1, {most}), {start}, (s, i) -> CASE WHEN s.j < {shards} THEN {step} ELSE s END)"

    first = f"named_struct('k', {_next(key)}, 'b', -1L, 'j', 0L)"
    usual = jumps(first, min(shards, USUAL_JUMPS))
    if shards > USUAL_JUMPS:
        usual = f"transform(array({usual}), u -> CASE WHEN u.j < {shards} THEN {jumps('u', shards)} ELSE u END)[0]"
    return F.expr(f"CAST(({usual}).b AS INT)")


def stable_key(column: str) -> Column:
    """A long that the column's decimal text decides in any language: half of its MD5; null counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    size is the text's bytes in UTF-8 plus one; a null text has no bytes.  Slots
    number a shard's rows from 0 without gaps.  Rows are dealt into sub-blocks by
    a hash, each is numbered in a task of its own, and counts of the blocks before
    it are added.  Repeated rows are counted before that and take slots that
    follow each other, so a row that is repeated often costs no task its memory.
    A null doc_id is a key of its own.  Columns other than doc_id and text are
    ignored.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("key", stable_key("doc_id"))
    rows = rows.withColumn("shard", jump_hash("key", shards)).withColumn("grown_shard", jump_hash("key", shards + 1))
    blocks = max(1, -(-docs.count() // NUMBERED_ROWS))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    place = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("block", F.pmod(place, F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "block").agg(F.sum("times").alias("in_block"))
    offsets = offsets.select("shard", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("start", F.coalesce(F.sum("times").over(within), F.lit(0))).join(offsets, ["shard", "block"])
    at = F.col("offset") + F.col("start")
    numbered = numbered.withColumn("slot", F.explode(F.sequence(at, at + F.col("times") - 1)))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, files: int = 1) -> None:
    """Writes docs, all columns, as Parquet under path/shard=N, in about `files` files a shard."""
    key = next(k for k in ("key" + "_" * i for i in range(len(docs.columns) + 1)) if k not in docs.columns)
    named = docs.drop("shard").withColumn(key, stable_key("doc_id"))
    named = named.withColumn("shard", jump_hash(f"`{key}`", shards))
    named.repartition(shards * files, "shard", F.pmod(F.xxhash64(key), F.lit(files))).drop(key).write.partitionBy("shard").parquet(path)
