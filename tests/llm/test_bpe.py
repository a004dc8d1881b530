from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, chunk int"


def whole(text):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


TEXTS = [
    None, "", " ", "\n\n \t x", "Hello, world! It's 3 o'clock.", "a  b   c d e", "<|endoftext|>", " a<|endoftext|><|endoftext|> b", "naïve café ßtraße", "日本語 テキスト 한국어", "مرحبا ٣٤",
    "é ́x ‍👩‍👩‍👧 \x1c\x1d\x85\x00y", "don't DON'T we'll'S", "x" * 20000, "ab " * 30000, "١٢٣ ⅷ ²³ ª º", "� \U000e0001 \U0001f9ff",
]


def test_round_trip_is_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 5000)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None)] * 3
    got = bpe.round_trip(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, text = whole(TEXTS[r["doc_id"] if r["doc_id"] is not None else 4])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_encode_then_decode(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    encoded = bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: whole(t)[0] for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_splitting_every_latin_letter():
    words, own = bpe.splitter(PATH), Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f" {c}{c} 1{c}", f"'{c} s'{c}"):
            assert words(text) == [text[a:b] for _, (a, b) in own(text)], text


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.round_trip(docs, PATH).collect():
        ids, text = whole(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and text == texts[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
