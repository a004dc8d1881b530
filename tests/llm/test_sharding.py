from __future__ import annotations

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from weftgraph.llm.sharding import jump_hash, shard, write_shards

SCHEMA = "doc_id long, text string, key string, shard string"


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(10**17, 10**17 + 200)]
    for n in (1, 2, 8, 9, 60, 1000):
        rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash("k", n).alias("s")).collect()
        assert {r["k"]: r["s"] for r in rows} == {k: jump(k % 2**64, n) for k in keys}


def check(spark, rows, shards=8):
    got = shard(spark.createDataFrame(rows, SCHEMA), shards).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        key = int(hashlib.md5(b"" if doc_id is None else str(doc_id).encode()).hexdigest()[:16], 16)
        want[doc_id, len(data) + 1, zlib.crc32(data), "key", jump(key, shards), jump(key, shards + 1)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_nulls_repeats_and_long_texts(spark):
    rows = [(i, f"té {i}", "a", "b") for i in range(300)] + [(7, "x" * 300_000, None, None), (None, None, "a", "b"), (None, "", "", "")]
    check(spark, rows + [(5, "again", "k", "s")] * 400)


def test_empty_table(spark):
    check(spark, [])


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "k", "s") for i in range(200)], SCHEMA)
    write_shards(docs, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
    assert back.select(F.countDistinct("doc_id")).head()[0] == 200
