"""Each stage of the pipeline against a plain version on what the stage before it kept."""

from __future__ import annotations

import hashlib

import brute
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from weftgraph.llm import secrets, toxicity
from weftgraph.llm.mixing import mixture
from weftgraph.llm.neardup import deduplicate
from weftgraph.sources.cut import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    secret = docs.limit(1).selectExpr("1000000L AS doc_id", "'the config has password = \"hunter2hunter2\" in it' AS text", "lang", "source", "51L AS n_chars")
    docs = docs.unionByName(secret)
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    plain = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF), name)
        rows = out.collect()
        if name == "toxicity":
            assert toxic and out.columns == columns
            want = {d: r for d, r in plain.items() if d not in toxic}
        elif name == "near_dedup":
            found = brute.near_duplicates([(d, r["text"]) for d, r in plain.items()])
            want = {d: r for d, r in plain.items() if found[d][2]}
        elif name == "secret_scan":
            want = {d: r | {"text": secrets.masked(r["text"]), "n_chars": len(secrets.masked(r["text"]))} for d, r in plain.items()}
            assert any(want[d]["text"] != plain[d]["text"] for d in want)
        elif name == "mixing":
            times = {r["doc_id"]: r["copies"] for r in mixture(docs).collect()}
            assert out.columns == columns and sorted(r["doc_id"] for r in rows) == sorted(d for d, n in times.items() for _ in range(n))
            want = {r["doc_id"]: plain[r["doc_id"]] for r in rows}
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
            for r in rows:
                ids = t.encode(plain[r["doc_id"]]["text"], add_special_tokens=False).ids
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            break
        got = {r["doc_id"]: r.asDict() for r in rows}
        assert got == want, name
        docs, plain = out, want


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_deduplicate_odd_rows(spark):
    text, other = "a b c d e f g h", "p q r s t u v w"
    rows = [
        (3, text, "k"), (3, text, "k"), (2, text, "k"), (9, "other words", "k"), (9, "other words", "k"), (None, text, "k"), (None, None, "k"), (4, "", "k"), (4, "", "k"),
        (2, other, "k"), (None, "n m l k j i", "k"), (None, "n m l k j i", "k"), (7, other, "k"),
    ]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, "n m l k j i"), (2, text), (2, other), (4, ""), (4, ""), (9, "other words")]
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string, kept string")).count() == 0
