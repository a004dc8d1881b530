from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    ids = [None, 0, 1, 2, 3, 4, 5, 10**12]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", tox.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = tox.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    yes = [r for r in got if r["toxic"]]
    no = [r for r in got if not r["toxic"]]
    caught, wrong = sum(r["predicted"] for r in yes) / len(yes), sum(r["predicted"] for r in no) / len(no)
    print("caught", caught, "wrong", wrong)
    assert caught >= 0.9 and wrong <= 0.01
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_nulls_empties_repeats_and_other_columns(spark):
    text = ["a fool and a knave", "a fine day", None, "", "fool " * 50_000, "!!!"]
    rows = [(i, text[i % 6], i % 2, "t", 0.5) for i in range(60)] + [(None, text[0], 1, "t", 0.5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, label string, score double")
    labels = spark.createDataFrame([(i, int(i % 6 in (0, 4)), "x") for i in range(60)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == 62 and not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert all(r["predicted"] == int((r["doc_id"] or 0) % 6 in (0, 4)) for r in got)
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 40
    assert tox.toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in tox.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_label_model_outvotes_a_wrong_label():
    r = np.random.default_rng(1)
    y = r.random(2000) < 0.2
    votes = np.column_stack([(r.random(2000) < np.where(y, 0.6, 0.005)) for _ in range(6)]).astype(float)
    wrong = r.random(2000) < 0.04
    q, say = tox.label_model(np.column_stack([votes, votes[:, 0], votes[:, 0]]), (y ^ wrong).astype(float))
    assert ((q > 0.5) != y).mean() < 0.6 * wrong.mean()
    assert say[1] < 0.5 * say[2]
