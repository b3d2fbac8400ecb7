"""Which licence is meant, order of words, and templates of whole notices."""

from math import ceil

import numpy as np

from taskmill.llm import license_scan

GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License"


def scanned(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r.doc_id, r) for r in license_scan.license_scan(rows, **options).collect())]


def test_only_the_licence_that_is_meant(spark):
    want = {
        "This program is free software: " + GNU.format("Affero General Public License"): "agpl,gpl",  # gpl is the phrase's
        "This program is free software: " + GNU.format("General Public License"): "gpl",
        "This library is free software; " + GNU.format("Lesser General Public License"): "gpl,lgpl",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "Creative Commons Attribution-NonCommercial 4.0 International": "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "Licensed under the MIT license or licensed under the Apache License, Version 2.0": "apache-2.0,mit",
    }
    assert [r.labels for r in scanned(spark, want)] == list(want.values())
    made = {t["label"]: t for t in license_scan.compared_templates((("a", "one two three four five six seven eight nine ten"), ("b", "one two three four five six seven eight nine ten eleven"), ("c", "one two three four five six seven eight nine twelve")))}
    assert made["a"]["barred"] == ["eleven"] and made["a"]["needed"] == ["ten"]
    assert made["b"]["needed"] == ["eleven"] and made["c"]["needed"] == ["twelve"] and not made["b"]["barred"]


def test_words_in_another_order_are_no_notice(spark):
    texts = ["students under the MIT dean released license plates", "license MIT the under released", "released, under the (so-called) MIT license"]
    assert [r.labels for r in scanned(spark, texts)] == ["", "", "mit"]


def test_whole_notices_as_templates(spark):
    """A template of 600 words, wrapped, with words lost and put in, against a count by hand."""
    rng = np.random.default_rng(3)
    template = [f"w{i}" for i in rng.integers(0, 300, 600)]
    distinct = set(template)
    texts = []
    for lost in (0.0, 0.02, 0.3, 0.7):
        kept = [w for w in template if rng.random() >= lost]
        texts.append("noise\n" * 40 + " ".join(kept).replace(" w1", "\nW1") + " noise" * 40)
    texts.append(" ".join(template[:300]) + " noise" * 900 + " " + " ".join(template[300:]))
    texts.append(" ".join(sorted(template)))
    need, pairs = ceil(0.9 * len(distinct) - 1e-9), {*zip(template, template[1:], strict=False)}
    want = []
    for t in texts:
        ws, span, best = t.lower().split(), license_scan.span_of(" ".join(template)), 0
        for s in range(len(ws)):
            block = ws[s : s + span]
            k = len(distinct & set(block)) if ws[s] in distinct else 0
            if k >= need and k > best and len(pairs & {*zip(block, block[1:], strict=False)}) >= ceil(license_scan.IN_ORDER * len(pairs) - 1e-9):
                best = k
        want.append(best / len(distinct))
    got = scanned(spark, texts, templates=(("own", " ".join(template)), ("none", " ")))
    assert [r.score for r in got] == want and want[0] == 1.0 and 0 in want
    assert [r.labels for r in got] == ["own" if x else "" for x in want]


def test_no_templates_and_empty_texts(spark):
    assert [(r.labels, r.score) for r in scanned(spark, ["released under the mit license", "", None], templates=())] == [("", 0.0)] * 3
    assert [r.labels for r in scanned(spark, ["", None, "mit", "x mit"], templates=(("one", "mit"),))] == ["", "", "one", "one"]
