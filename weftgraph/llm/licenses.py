"""Licence scanning with a trained paragraph classifier, in DataFrame functions only.

A text's paragraphs are parted by blank lines; within one, wrapped lines run on,
and comment signs are no words.  A paragraph's windows of words are turned into
hashed word n-grams.  A softmax regression, trained here on variants of the
templates below and on near misses, gives a probability to each licence family
and to an unknown class.  Its temperature and threshold are calibrated on
templates that were left out of training.  A prediction stands only if the words
share enough trigrams with a template of the family.

Words without a trigram of any template cannot be confirmed, so only windows that
hold one are classified, and each distinct window once.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.cut import cut

#: Hash buckets of n-grams of one to GRAM words.
BUCKETS, GRAM = 4096, 3
#: Words of a window, and the step between windows, of a paragraph that is longer.
WINDOW, STEP = 60, 30
#: Share of trigrams, of the template or of the paragraph, that confirms a family.
CONFIRMED = 0.6
#: Parts of the templates: each part is left out once when the classifier is calibrated.
FOLDS = 4
#: What parts paragraphs: a line without anything but blanks and comment signs.
BLANK_LINE = r"\n[ \t\r]*(?:[#*/;%!>-]+[ \t\r]*)?(?=\n)"
UNKNOWN = "unknown"

#: Opening and short forms of common licences, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Released under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "You should have received a copy of the GNU General Public License along with this program",
        "Licensed under the GNU Lesser General Public License version 2.1",
        "Licensed under the GNU Affero General Public License version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY-SA 4.0",
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike license",
        "To the extent possible under law the author has dedicated all copyright to the public domain under CC0 1.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
}
#: Texts that use the terms without being a licence's.
NEAR_MISSES = [
    "He lost his driving licence in March and had to walk", "The pub lost its licence to serve alcohol", "Fishing licenses are sold at the harbour office",
    "The court found that the copyright had expired long ago", "A search warrant was issued for the house", "The warranty covers parts and labour for two years",
    "All rights reserved by the publisher of this book", "The taxes redistribute income between regions", "She is a creative writer with a license to be odd",
    "License plates must be visible at all times", "The film was licensed to a television network last year", "Copyright law differs between countries",
    "Please cc the manager on every message", "A licensed plumber checked the pipes", "The software licence costs forty dollars a month",
    "General public opinion turned against the free foundation", "The Apache people lived in the south west", "MIT students released a study on public health",
    "The gnu is an antelope and the berkeley campus is closed", "Version 2.0 of the terms was published under pressure", "This creative work was distributed in the common hall",
    "The mozilla office opened to the public", "Permission was granted to use the hall free of charge", "The following conditions were met by the contractor",
]


def words_of(text: str) -> list[str]:
    """Lower-case runs of a-z and runs of digits, the latter as 0; Spark does the same in _normal."""
    import re

    return re.findall("[a-z]+|0", re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))


def grams_of(words: list[str], least: int = 1, most: int = GRAM) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)}


def _any_of(sequences: list[tuple[str, ...]]) -> str:
    """A regular expression for one of `sequences` of expressions, none of which begins another; common beginnings are tried once."""
    if sequences == [()]:
        return ""
    heads: dict[str, list[tuple[str, ...]]] = {}
    for s in sequences:
        heads.setdefault(s[0], []).append(s[1:])
    parts = [head + _any_of(rest) for head, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


@lru_cache(1)
def _forms() -> str:
    """A regular expression, for Java and Python, that finds a trigram of a template in exactly the texts whose words have one.

    A paragraph is confirmed only if it shares a trigram with a template, so none
    that could be confirmed is passed over.
    """
    letters, digits = [], []
    for gram in sorted({g for family in TEMPLATES.values() for t in family for g in grams_of(words_of(t), GRAM, GRAM)}):
        words, out = gram.split(" "), []
        for i, w in enumerate(words):
            if i:
                # A letter and a digit are two words without anything between them.
                out.append("[^A-Za-z0-9]" + ("*+" if (w == "0") != (words[i - 1] == "0") else "++"))
            last = i == len(words) - 1
            out += ["[0-9]" if last else "[0-9]++"] if w == "0" else [*w, *(["(?![A-Za-z])"] if last else [])]
        (digits if words[0] == "0" else letters).append(tuple(out))
    return "(?i)(?:" + "|".join(["(?<![A-Za-z])" + _any_of(letters)] * bool(letters) + [_any_of(digits)] * bool(digits)) + ")"


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _hashed(words: list[str]) -> np.ndarray:
    row = np.zeros(BUCKETS, np.float32)
    row[[bucket(g) for g in grams_of(words)]] = 1
    return row


def examples(seed: int, variants: int = 24, fold: int | None = None, left_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Variants of templates and near misses: hashed n-grams by row, and classes, the last being unknown.

    A variant leaves out or replaces some words and stands among words of no
    meaning, which take random buckets.  With a fold, every text but those of the
    fold, or with left_out only those; texts alternate between folds.
    """
    r = np.random.default_rng(seed)
    known = [(t, k, i) for k, family in enumerate(TEMPLATES.values()) for i, t in enumerate(family)] + [(t, len(TEMPLATES), i) for i, t in enumerate(NEAR_MISSES)]
    x, y = [], []
    for text, k, i in known:
        if fold is not None and (i % FOLDS == fold) != left_out:
            continue
        for v in range(variants):
            words = words_of(text)
            if v:
                keep = r.random(len(words)) > r.choice([0.0, 0.05, 0.15])
                words = [w if kept else f"~{r.integers(10**9)}" for w, kept in zip(words, keep, strict=True) if kept or r.random() < 0.5]
                around = [f"~{r.integers(10**9)}" for _ in range(r.choice([0, 3, 15, 40]))]
                cut_at = r.integers(len(around) + 1)
                words = around[:cut_at] + words + around[cut_at:]
            x.append(_hashed(words))
            y.append(k)
    for _ in range(16 * variants):
        words = [f"~{r.integers(10**9)}" for _ in range(r.integers(1, WINDOW))] + list(r.choice(["license", "licensed", "copyright", "public", "version", "under", "the", "of", "0"], r.integers(1, 4)))
        x.append(_hashed(list(r.permutation(words))))
        y.append(len(TEMPLATES))
    return np.array(x), np.array(y)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fitted(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets by classes) and biases; only buckets that occur are worked on."""
    classes = len(TEMPLATES) + 1
    used = np.flatnonzero(x.any(axis=0))
    part, one = np.ascontiguousarray(x[:, used]), np.eye(classes, dtype=np.float32)[y]
    w, b = np.zeros((len(used), classes), np.float32), np.zeros(classes, np.float32)
    moment = np.zeros_like(w)
    for _ in range(rounds):
        error = (_softmax(part @ w + b) - one) / len(part)
        moment = 0.9 * moment + part.T @ error + 1e-4 * w
        w -= 0.5 * moment
        b -= 0.5 * error.sum(axis=0)
    whole = np.zeros((BUCKETS, classes), np.float32)
    whole[used] = w
    return whole, b


@lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights (buckets by classes), biases, temperature and least probability; the training set is fixed and small.

    Temperature and threshold come from classifiers that have not seen the
    templates which they judge.
    """
    scores, truth = [], []
    for fold in range(FOLDS):
        w, b = _fitted(*examples(1, 6, fold), rounds=120)
        x, y = examples(2, 6, fold, left_out=True)
        scores.append(x @ w + b)
        truth.append(y)
    scores, truth = np.concatenate(scores), np.concatenate(truth)
    at = np.arange(len(truth))
    temperature = min(np.linspace(0.3, 3, 28), key=lambda t: -np.log(_softmax(scores / t)[at, truth] + 1e-12).mean())
    p = _softmax(scores / temperature)
    guess, sure = p[:, :-1].argmax(axis=1), p[:, :-1].max(axis=1)
    # The least probability at which 99 of 100 predictions of a family are right.
    for least in np.linspace(0.3, 0.95, 14):
        named = sure >= least
        if named.any() and (guess[named] == truth[named]).mean() >= 0.99:
            break
    w, b = _fitted(*examples(1), rounds=250)
    return w, b, float(temperature), float(least)


def _normal(column: str) -> str:
    """SQL for the words of a text."""
    lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all(regexp_replace({lower}, '[0-9]+', '0'), '[a-z]+|0', 0)"


def _grams(words: str, n: int) -> str:
    """SQL for the n-grams of an array of words, in order; none where there are fewer words."""
    return f"CASE WHEN size({words}) < {n} THEN array() ELSE transform(sequence(0, size({words}) - {n}), i -> array_join(slice({words}, i + 1, {n}), ' ')) END"


def _scores(windows: DataFrame) -> DataFrame:
    """id, family, probability, similarity of the distinct windows (id, words): the most probable family, and how much its templates share with the words."""
    spark = windows.sparkSession
    w, b, temperature, _ = model()
    table = spark.createDataFrame([(int(k), [float(x) for x in w[k]]) for k in np.flatnonzero(np.abs(w).max(axis=1) > 1e-6)], "bucket int, w array<double>")
    buckets = "array_distinct(transform(concat(" + ", ".join(_grams("words", n) for n in range(1, GRAM + 1)) + f"), g -> cast(crc32(cast(g AS binary)) % {BUCKETS} AS int)))"
    hashed = windows.select("id", F.explode(F.expr(buckets)).alias("bucket")).join(F.broadcast(table), "bucket")
    logits = hashed.groupBy("id").agg(*(F.sum(F.col("w")[c]).alias(f"z{c}") for c in range(len(TEMPLATES) + 1)))
    z = [(F.col(f"z{c}") + float(b[c])) / temperature for c in range(len(TEMPLATES) + 1)]
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    sure = F.array(*(F.struct((F.exp(z[c] - top) / total).alias("probability"), F.lit(f).alias("family")) for c, f in enumerate(TEMPLATES)))
    best = logits.select("id", F.array_max(sure).alias("best")).select("id", "best.*")
    own = windows.select("id", F.expr(f"array_distinct({_grams('words', GRAM)})").alias("grams"))
    shared = own.select("id", F.size("grams").alias("own"), F.explode("grams").alias("gram")).join(F.broadcast(_template_grams(spark)), "gram")
    shared = shared.groupBy("id", "own", "family", "form", "size").agg(F.count(F.lit(1)).alias("common"))
    alike = shared.groupBy("id", "family").agg(F.max(F.greatest(F.col("common") / F.col("size"), F.col("common") / F.col("own"))).alias("similarity"))
    return best.join(alike, ["id", "family"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def _template_grams(spark: SparkSession) -> DataFrame:
    """family, form, gram, size (trigrams of the form), length (its words)."""
    grams = [(f, i, g, len(gs), len(words_of(t))) for f, texts in TEMPLATES.items() for i, t in enumerate(texts) for gs in [grams_of(words_of(t), GRAM, GRAM)] for g in gs]
    return spark.createDataFrame(grams, "family string, form int, gram string, size int, length int")


def _windows(rows: DataFrame) -> DataFrame:
    """key, meant, words: what is classified of the paragraphs (key, words).

    Windows of WINDOW words that hold a trigram of a template, with a null meant,
    and stretches that hold CONFIRMED of the trigrams of one template, with its
    family.  A stretch is as long as the template and a quarter more, and begins
    with one of its trigrams.  Only keys and places move until the words are cut.
    """
    hits = rows.select("key", F.size("words").alias("n"), F.posexplode(F.expr(_grams("words", GRAM))).alias("at", "gram")).join(F.broadcast(_template_grams(rows.sparkSession)), "gram")
    hits = cut(hits, "hits")
    last = f"greatest(n - {WINDOW} + {STEP - 1}, 0) div {STEP}"
    first = F.explode(F.expr(f"filter(array(least(at div {STEP}, {last}), at div {STEP} - 1), k -> k >= 0 AND k * {STEP} + {WINDOW} >= at + {GRAM})"))
    none = F.lit(None).cast("string")
    whole = hits.select("key", "n", "at").distinct().select("key", first.alias("k")).distinct().select("key", (F.col("k") * STEP).alias("at"), F.lit(WINDOW).alias("length"), none.alias("meant"))
    forms = hits.groupBy("key", "family", "form", "size", "length").agg(F.array_sort(F.collect_list(F.struct("at", "gram"))).alias("hits"))
    # A hit of many is looked at with those after it, of which no more than `reach` are near enough.
    reach = "cast(ceil(length * 1.25) AS int)"
    near = f"array_distinct(transform(filter(slice(hits, i + 1, {reach}), y -> y.at + {GRAM} <= x.at + {reach}), y -> y.gram))"
    starts = forms.withColumn("at", F.explode(F.expr(f"filter(transform(hits, (x, i) -> CASE WHEN size({near}) >= {CONFIRMED} * size THEN x.at END), at -> at IS NOT NULL)")))
    spans = whole.unionByName(starts.select("key", F.col("at").cast("long"), F.expr(reach).alias("length"), F.col("family").alias("meant")))
    spans = spans.distinct().groupBy("key").agg(F.collect_list(F.struct("at", "length", "meant")).alias("spans"))
    pieces = F.explode(F.expr("transform(spans, s -> named_struct('words', slice(words, cast(s.at AS int) + 1, s.length), 'meant', s.meant))"))
    return rows.join(spans, "key").select("key", pieces.alias("x")).select("key", "x.meant", "x.words")


def _told(paragraphs: DataFrame) -> DataFrame:
    """key, family, probability, similarity, confirmed, families of the distinct paragraphs (key, paragraph) with a trigram of a template."""
    least = model()[3]
    rows = paragraphs.groupBy("key").agg(F.first("paragraph").alias("paragraph")).select("key", F.expr(_normal("paragraph")).alias("words"))
    text = F.array_join("words", " ")
    places = cut(_windows(cut(rows, "paragraphs")).select("key", "meant", F.unhex(F.sha2(text, 256)).alias("id"), text.alias("text")), "windows")
    judged = _scores(places.groupBy("id").agg(F.first("text").alias("text")).select("id", F.split("text", " ").alias("words")))
    # A stretch speaks for the family of its template only.
    judged = places.select("key", "meant", "id").join(judged, "id").where("meant IS NULL OR family = meant")
    judged = judged.withColumn("confirmed", (F.col("probability") >= least) & (F.col("similarity") >= CONFIRMED)).where("meant IS NULL OR confirmed")
    # By family first, so that a paragraph's windows are partial aggregates.
    order = F.struct("confirmed", F.col("meant").isNull().alias("window"), (F.col("similarity") >= CONFIRMED).alias("alike"), "probability", "similarity", "family")
    best = judged.groupBy("key", "family").agg(F.max(order).alias("best"))
    told = best.groupBy("key").agg(
        F.max("best").alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("best.confirmed"), F.struct("family", F.round("best.probability", 6).alias("probability"))))).alias("families"),
    )
    return told.select(
        "key",
        F.when(F.col("best.probability") >= least, F.col("best.family")).otherwise(UNKNOWN).alias("family"),
        F.round("best.probability", 6).alias("probability"),
        F.round("best.similarity", 6).alias("similarity"),
        F.col("best.confirmed").alias("confirmed"),
        "families",
    )


def classify(paragraphs: DataFrame) -> DataFrame:
    """paragraph, family, probability, similarity, confirmed, families for each distinct text in the column paragraph.

    A paragraph is classified by windows, and every stretch that holds most of a
    template also by itself, so that a notice counts though another stands next to
    it.  families has all confirmed families (family, probability), by name; the
    most probable confirmed window, else stretch, speaks for the paragraph.
    family is `unknown` where no family is probable enough, and the probability 0
    where the words have no trigram of a template; nothing is confirmed then.
    Nulls are left out, repeats told once, other columns ignored, long texts read
    whole; an empty table gives no rows.
    """
    rows = paragraphs.select(F.col("paragraph").cast("string").alias("paragraph")).where("paragraph IS NOT NULL").withColumn("key", F.unhex(F.sha2("paragraph", 256)))
    rows = rows.groupBy("key").agg(F.first("paragraph").alias("paragraph"))
    return rows.join(_told(rows), "key", "left").select(
        "paragraph", F.coalesce("family", F.lit(UNKNOWN)).alias("family"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
        F.coalesce("families", F.expr("cast(array() AS array<struct<family: string, probability: double>>)")).alias("families"),
    )


def _candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id and the numbered paragraphs with a trigram of a template of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    forms, parted = F.lit(_forms()), F.split("text", BLANK_LINE)
    numbered = F.transform(parted, lambda p, i: F.struct(i.alias("number"), p.alias("paragraph"), F.unhex(F.sha2(p, 256)).alias("key")))
    found = F.when(F.rlike("text", forms), F.filter(numbered, lambda x: F.rlike(x["paragraph"], forms)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """row, doc_id, number, paragraph, family, probability, similarity, confirmed, families: one row for each candidate paragraph."""
    rows = cut(_candidates(docs), "licences").select("row", "doc_id", F.explode("found").alias("x")).select("row", "doc_id", "x.*")
    return rows.join(_told(rows), "key").drop("key")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, families, n_candidates, n_confirmed, probability for every row of docs (doc_id, text).

    families joins the confirmed families' names by commas, in order; it is empty
    without any.  n_candidates counts the paragraphs with a trigram of a template,
    n_confirmed the confirmed families of every one of them.  probability is the
    highest of a confirmed family, else 0.  A null or empty text has no candidates;
    a long text is read whole, in windows.  Repeated rows give equal rows, and a
    repeated paragraph is judged once; equally probable families are told by name.
    Null doc_ids are kept, other columns are ignored, and an empty table gives no
    rows.
    """
    rows = cut(_candidates(docs), "licences")
    found = rows.select("row", F.explode("found").alias("x")).select("row", "x.key", "x.paragraph")
    judged = found.select("row", "key").join(_told(found), "key")
    told = judged.groupBy("row").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families.family")))), ",").alias("families"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum(F.size("families")).alias("n_confirmed"),
        F.max(F.array_max("families.probability")).alias("probability"),
    )
    out = rows.select("row", "doc_id").join(told, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_candidates", zero).alias("n_candidates"),
        F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
