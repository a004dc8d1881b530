from __future__ import annotations

import re
import time

import numpy as np

from weftgraph.llm import licenses

SCHEMA = "doc_id long, text string, families string, row int"


def scan(spark, texts):
    rows = [(i, t, "f", 1) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_families(spark):
    texts = [
        "some words\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.", "prose\nThis work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "LICENSED### under$$$ CC%%% BY-NC*** 4.0.", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "a\nReleased under the MIT License.\nb\nLicensed under CC BY-SA 4.0.\nReleased under the MIT License.", "SPDX-License-Identifier: MPL-2.0",
        " ".join(["word"] * 500) + " Released under the MIT License. " + " ".join(["other"] * 900),
    ]
    got = scan(spark, texts)
    assert [got[i]["families"] for i in range(len(texts))] == ["apache", "mit", "gpl", "cc", "cc", "bsd", "cc,mit", "mpl", "mit"]
    assert got[6]["n_confirmed"] == 2


def test_clean_and_odd_rows(spark):
    texts = [None, "", "\n\n", "no terms here", "He lost his driving licence last year.", "The copyright of the MIT student expired.", "license " * 20_000, "licence"]
    got = scan(spark, texts)
    assert len(got) == len(texts) and all(r["families"] == "" and r["n_confirmed"] == 0 and r["probability"] == 0 for r in got.values())
    assert all(got[i]["n_candidates"] == 0 for i in (0, 1, 2, 3, 4, 7))
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "Released under the MIT License.", None, None)] * 3
    assert [r["families"] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()] == ["mit"] * 3


def test_held_out_accuracy_and_spark_scores(spark):
    w, b, temperature, least = licenses.model()
    x, y = licenses.examples(9)
    p = licenses._softmax((x @ w + b) / temperature)
    named = p[:, :-1].max(axis=1) >= least
    assert (p[:, :-1].argmax(axis=1)[named] == y[named]).mean() >= 0.98
    assert named[y < len(licenses.TEMPLATES)].mean() >= 0.85
    texts = [t for f in licenses.TEMPLATES.values() for t in f] + licenses.NEAR_MISSES
    got = {r["paragraph"]: r for r in licenses.classify(spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "paragraph string")).collect()}
    assert len(got) == len(texts)
    assert all(got[t]["confirmed"] for f in licenses.TEMPLATES.values() for t in f)
    assert not any(got[t]["confirmed"] for t in licenses.NEAR_MISSES)


def plain_scan(text):
    """The whole scan of one text in plain Python: families, n_candidates, n_confirmed, probability."""
    w, b, temperature, least = licenses.model()
    forms = [(f, len(licenses.words_of(t)), licenses.grams_of(licenses.words_of(t), 3, 3)) for f, ts in licenses.TEMPLATES.items() for t in ts]
    known = set().union(*(g for _, _, g in forms))
    families, candidates, confirmed, most = set(), 0, 0, 0.0
    for paragraph in re.split(licenses.BLANK_LINE, text or ""):
        words = licenses.words_of(paragraph)
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        if not known & set(grams):
            continue
        candidates += 1
        last = max(len(words) - licenses.WINDOW + licenses.STEP - 1, 0) // licenses.STEP
        pieces = [(None, words[k * licenses.STEP : k * licenses.STEP + licenses.WINDOW]) for k in range(last + 1)]
        for f, length, own in forms:
            reach = -(-length * 5 // 4)
            for i, g in enumerate(grams):
                if g in own and len({x for x in grams[i : i + reach - 2] if x in own}) >= licenses.CONFIRMED * len(own):
                    pieces.append((f, words[i : i + reach]))
        own_families = {}
        for meant, piece in pieces:
            seen = licenses.grams_of(piece, 3, 3)
            if not seen & known:
                continue
            row = licenses._hashed(piece)
            p = licenses._softmax(((row @ w + b) / temperature)[None])[0][:-1]
            family = list(licenses.TEMPLATES)[int(p.argmax())]
            alike = max(max(len(seen & g) / len(g), len(seen & g) / len(seen)) for f, _, g in forms if f == family)
            if p.max() >= least and alike >= licenses.CONFIRMED and meant in (None, family):
                # The window, else the stretch, of highest probability speaks for its family.
                own_families[family] = max(own_families.get(family, (False, 0.0)), (meant is None, float(p.max())))
        families |= set(own_families)
        confirmed += len(own_families)
        most = max([most, *(p for _, p in own_families.values())])
    return ",".join(sorted(families)), candidates, confirmed, most


def test_same_as_plain_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = 0
    for r in licenses.scan(docs).collect():
        families, candidates, confirmed, most = plain_scan(texts[r["doc_id"]])
        assert (r["families"], r["n_candidates"], r["n_confirmed"]) == (families, candidates, confirmed), r
        assert abs(r["probability"] - most) < 1e-3
        found += confirmed
    assert found > 10


GRANT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:
#
#    * Redistributions of source code must retain the above copyright
#      notice, this list of conditions and the following disclaimer.
"""
MPL = """// If a copy of the MPL was not distributed with this
// file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_wrapped_headers(spark):
    texts = [GRANT, GPL, BSD, MPL, f"{GRANT}\n{GPL}", "It was\n\nthe General Public. License of the hall was granted"]
    got = scan(spark, texts)
    assert [got[i]["families"] for i in range(len(texts))] == ["mit", "gpl", "bsd", "mpl", "gpl,mit", ""]
    assert got[0]["n_candidates"] == 1 and got[1]["n_candidates"] == got[2]["n_candidates"] == 2
    for i, t in enumerate(texts):
        assert (got[i]["families"], got[i]["n_candidates"], got[i]["n_confirmed"]) == plain_scan(t)[:3]


def test_long_varied_paragraph(spark):
    r = np.random.default_rng(1)
    prose = " ".join("".join(r.choice(list("abcdefgh"), 5)) + (" of this software" if r.random() < 0.01 else "") for _ in range(170_000))
    began = time.perf_counter()
    got = scan(spark, [f"{prose}\nReleased under the MIT License.\n{prose[:1000]}"])
    print("seconds for", len(prose), "characters:", time.perf_counter() - began)
    assert got[0]["families"] == "mit" and time.perf_counter() - began < 60


def test_every_template_passes_the_gate(spark):
    forms = [(t, f) for f, texts in licenses.TEMPLATES.items() for t in texts]
    got = scan(spark, [f"prose\n// {t}\nmore" for t, _ in forms])
    assert [got[i]["families"] for i in range(len(forms))] == [f for _, f in forms]
    assert all(got[i]["n_candidates"] == got[i]["n_confirmed"] == 1 for i in range(len(forms)))


def test_gate_finds_exactly_the_trigrams_of_templates():
    import random
    import re

    trigrams = {g for f in licenses.TEMPLATES.values() for t in f for g in licenses.grams_of(licenses.words_of(t), 3, 3)}
    gate = re.compile(licenses._forms())
    r = random.Random(5)
    parts = [w for g in sorted(trigrams) for w in g.split(" ")]
    for _ in range(20_000):
        g = r.choice(sorted(trigrams)).split(" ") if r.random() < 0.7 else r.choices(parts, k=4)
        words = [str(r.randrange(10**3)) if w == "0" else r.choice([w, w.upper(), w.title()]) for w in g]
        text = r.choice(["", "x", "7", "\u00e9", " "]) + "".join(w + r.choice(["", " ", "-", ".\u00e9", "  "]) for w in words) + r.choice(["", "s", "1"])
        assert bool(gate.search(text)) == bool(trigrams & licenses.grams_of(licenses.words_of(text), 3, 3)), text


def test_all_notices_of_a_line(spark):
    mit, gpl, cc = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-SA 4.0."
    far = " ".join(["word"] * 1000)
    texts = [
        f"{mit} {far} {gpl}", f"{gpl} {far} {mit}", f"{mit} {gpl}", f"{mit} {gpl} {cc}", f"{mit}\n{gpl}", f"{mit} {far} {mit}",
        "Licensed under the MIT License or the Apache License, Version 2.0", "This project is licensed under the terms of the GNU General Public License, version 3",
        "This project is licensed under the terms of the Apache License, Version 2.0",
    ]
    got = scan(spark, texts)
    assert [got[i]["families"] for i in range(len(texts))] == ["gpl,mit", "gpl,mit", "gpl,mit", "cc,gpl,mit", "gpl,mit", "mit", "apache,mit", "gpl", "apache"]
    assert [got[i]["n_confirmed"] for i in range(len(texts))] == [2, 2, 2, 3, 2, 1, 2, 1, 1]
    assert all((got[i]["families"], got[i]["n_candidates"], got[i]["n_confirmed"]) == plain_scan(t)[:3] for i, t in enumerate(texts))
