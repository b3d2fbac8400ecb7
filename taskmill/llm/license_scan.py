"""License scan: phrases, and an exact set-similarity join of text blocks with templates.

Spark SQL functions only.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.llm.common import text_of, written

IN, OUT = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"

#: Phrases whose words stand consecutively, and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, wording) of license notices, in lower case, words parted by spaces. Fixed values.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use "
        "or other dealings in the software",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express "
        "or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
        "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use "
        "of this software even if advised of the possibility of such damage",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("public-domain", "this work has been released into the public domain"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved no part of this publication may be reproduced"),
)
#: Notices differ in few words: at 0.8 one names another's licence.
CONTAINMENT = 0.9
#: Least share of a template's pairs of neighbouring words that stand so in a block: words in another order are no notice.
IN_ORDER = 0.6
#: Words of a block for each word of the template: a notice may have words put in.
SLACK = 1.5
#: Most words that a notice of another licence may have on top of a template's for them to bar it.
FEW = 2
#: Most words of all templates together whose table is broadcast.
BROADCAST_WORDS = 1_000_000
#: Places of the four counts in one long: template's words, needed ones, pairs, barred words.
_WORD, _NEEDED, _PAIR, _BARRED = 1, 1 << 15, 1 << 30, 1 << 45
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A text with A to Z in lower case and all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def span_of(wording: str) -> int:
    """Words of a block that is compared with a template."""
    return int(SLACK * len(wording.split()))


def _phrase(words: str) -> str:
    return (OUT + "++").join(words.split())


def base_columns(docs: DataFrame) -> list[Column]:
    """n_words, n_base, first_word, last_word, base (labels as an array) of each text."""
    text = text_of(docs)
    bound = lambda x: f"(?i)(?<!{IN})(?:{x})(?!{IN})"
    any_ = bound("|".join(_phrase(p) for p in PHRASES))
    hit = text.rlike(any_)
    words = lambda x: F.regexp_count(x, F.lit(IN + "++")).cast("long")
    head = F.regexp_extract(text, "(?s)^(.*?)" + any_, 1)
    until_last = F.regexp_extract(text, "(?s)^(.*)" + any_, 1)
    labels = F.array_compact(F.array(*[F.when(text.rlike(bound(_phrase(p))), F.lit(label)) for p, label in PHRASES.items()]))
    return [
        words(text).alias("n_words"),
        F.when(hit, F.regexp_count(text, F.lit(any_)).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_base"),
        F.when(hit, words(head)).alias("first_word"),
        F.when(hit, words(until_last)).alias("last_word"),
        F.when(hit, labels).otherwise(F.array().cast("array<string>")).alias("base"),
    ]


def token_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, n): how often each word of the templates stands in all texts."""
    word = docs.select(F.explode(F.split(lowered(text_of(docs)), OUT + "+")).alias("word"))
    return word.filter(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def compared_templates(templates=TEMPLATES, containment: float = CONTAINMENT) -> list[dict]:
    """What blocks are compared with, for each template that has words.

    Another licence's template is a rival if its words alone would be a hit of this one. Of a rival
    that lacks some of this template's words, those words are `needed` in a block; of one that has
    them all and FEW more at most, the further ones are `barred` from it. So of
    notices that differ in a word (affero, lesser, sharealike) only that which is meant is found.
    """
    out = []
    for label, text in templates:
        words = text.split()
        if words:
            tokens = list(dict.fromkeys(words))
            pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
            if max(len(tokens), len(pairs)) >= _NEEDED:
                raise ValueError(f"a template has fewer than {_NEEDED} words")
            out.append({"id": len(out), "label": label, "tokens": tokens, "pairs": pairs, "need": ceil(containment * len(tokens) - 1e-9), "need_pairs": ceil(IN_ORDER * len(pairs) - 1e-9), "n": len(tokens), "span": span_of(text)})
    for t in out:
        own = set(t["tokens"])
        rivals = [set(r["tokens"]) for r in out if r["label"] != t["label"] and len(own & set(r["tokens"])) >= t["need"]]
        t["needed"] = sorted(set().union(*(own - r for r in rivals)))
        t["barred"] = sorted(set().union(*(r - own for r in rivals if own <= r and len(r - own) <= FEW)))
    return out


def _regions(ws: Column, rare: Column, index: Column) -> Column:
    """(id, words) of the parts of a text that can hold a block with a prefix token of a template.

    Prefix tokens less than a block apart are in one part, so that a text's parts have no more
    than twice its words, for each template.
    """

    def of_template(t):
        span = t["span"]
        first = lambda at: F.filter(at, lambda x, j: F.coalesce(x - F.get(at, j - 1) >= span, F.lit(True)))
        last = lambda at: F.filter(at, lambda x, j: F.coalesce(F.get(at, j + 1) - x >= span, F.lit(True)))
        low = lambda a: F.greatest(a - span + 1, F.lit(0))
        part = lambda a, z: F.struct(t["id"].alias("id"), F.slice(ws, low(a) + 1, z + span - low(a)).alias("words"))
        places = F.transform(F.filter(rare, lambda x: F.array_contains(t["prefix"], x["w"])), lambda x: x["i"])
        # In an array of one, places are found once and named in the lambda.
        return F.flatten(F.transform(F.array(places), lambda at: F.zip_with(first(at), last(at), part)))

    return F.flatten(F.transform(F.filter(index, lambda t: F.size(ws) >= t["need"]), of_template))


def _best_block() -> Column:
    """The most words of the template in a block of `words` that meets all conditions, else 0.

    An item that stands at i, and before that at q, is new in the blocks that begin behind q and
    no more than a block before i: it adds one from the first of these on and takes one off behind i.
    The sum of all changes in order of place counts the distinct items of each block, so that
    a part of n words takes n log n steps, whatever the template's length.
    """
    worth = lambda w: F.when(F.array_contains("tokens", w), F.when(F.array_contains("needed", w), F.lit(_WORD + _NEEDED)).otherwise(F.lit(_WORD))).when(F.array_contains("barred", w), F.lit(_BARRED))
    word = lambda w, i: F.struct(w.alias("item"), i.alias("i"), worth(w).cast("long").alias("d"))
    double = lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get("words", i + 1)).alias("item"), i.alias("i"), F.lit(_PAIR).cast("long").alias("d"))
    items = F.sort_array(
        F.concat(
            F.filter(F.transform("words", word), lambda x: x["d"].isNotNull()),
            F.filter(F.transform("words", double), lambda x: F.array_contains("pairs", x["item"])),
        )
    )
    event = lambda at, rank, d: F.struct(at.alias("at"), F.lit(rank).alias("rank"), d.cast("long").alias("d"))

    def changes(items, x, j):
        before = F.get(items, j - 1)
        behind = F.when(before["item"] == x["item"], before["i"] + 1).otherwise(F.lit(0))
        reach = F.col("span") - F.when(x["d"] == _PAIR, F.lit(1)).otherwise(F.lit(0))
        both = F.array(event(F.greatest(behind, x["i"] - reach + 1), 0, x["d"]), event(x["i"] + 1, 0, -x["d"]))
        # Blocks begin with one of the template's words.
        return F.when(x["d"] < _PAIR, F.concat(both, F.array(event(x["i"], 1, F.lit(0))))).otherwise(both)

    part = lambda s, unit: F.shiftright(s, unit.bit_length() - 1).bitwiseAND(F.lit(_NEEDED - 1))
    meets = lambda s: (part(s, _WORD) >= F.col("need")) & (part(s, _NEEDED) == F.size("needed")) & (part(s, _PAIR) >= F.col("need_pairs")) & (s < _BARRED)
    step = lambda acc, e: F.struct((acc["sum"] + e["d"]).alias("sum"), F.when((e["rank"] == 1) & meets(acc["sum"]), F.greatest(acc["best"], part(acc["sum"], _WORD))).otherwise(acc["best"]).alias("best"))
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("best"))
    best = lambda items: F.aggregate(F.sort_array(F.flatten(F.transform(items, lambda x, j: changes(items, x, j)))), none, step)["best"]
    # In an array of one, so that no optimisation can put the sorting of items into the lambda.
    return F.transform(F.array(items), best)[0]


def matching_blocks(docs: DataFrame, key: Column, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(key, label, template, containment) of each text and template such that a block of the text
    has at least `containment` of the template's distinct words and IN_ORDER of its pairs of
    neighbouring words, all needed words and no barred one (see compared_templates); the greatest
    containment.

    Blocks are all runs of SLACK times as many words as the template has (or up to the text's
    end) that begin with one of its words, whatever line breaks and marks stand between: a notice
    may wrap, and words that are strewn over a long text or in another order don't make one.

    The template's tokens are put in order of their frequency in the corpus, rarest first. A
    block that has `need` of `n` tokens has one of the first n - need + 1: only parts of texts around
    such prefix tokens are looked at (prefix filter), in texts of `need` words at least (length
    filter). A part that has fewer than `need` of the template's tokens is dropped (positional
    filter). In what remains, all blocks are counted exactly, in one pass. A template may have
    thousands of words.
    """
    spark: SparkSession = docs.sparkSession
    rows = compared_templates(templates, containment)
    vocabulary = sorted({w for t in rows for w in t["tokens"]})
    # Only counts of the templates' own words reach the driver, whatever the corpus.
    count = dict(token_counts(docs, vocabulary).collect()) if vocabulary else {}
    index = [{"id": t["id"], "need": t["need"], "span": t["span"], "prefix": sorted(t["tokens"], key=lambda w: (count.get(w, 0), w))[: t["n"] - t["need"] + 1]} for t in rows]
    rare = sorted({w for t in index for w in t["prefix"]})
    some = f"(?i)(?<!{IN})(?:{'|'.join(rare)})(?!{IN})" if rare else "(?!)"
    text = text_of(docs)
    worded = docs.filter(text.rlike(some)).select(key.alias("key"), F.array_remove(F.split(lowered(text), OUT + "+"), "").alias("ws"))
    at = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(rare))
    ordered = F.from_json(F.lit(json.dumps(index)), "array<struct<id: int, need: int, span: int, prefix: array<string>>>")
    parts = worded.select("key", "ws", at.alias("rare")).select("key", F.explode(_regions(F.col("ws"), F.col("rare"), ordered)).alias("x")).select("key", "x.*")
    names = ["id", "label", "tokens", "needed", "barred", "pairs", "need", "need_pairs", "n", "span"]
    forms = spark.createDataFrame([tuple(t[c] for c in names) for t in rows], "id int, label string, tokens array<string>, needed array<string>, barred array<string>, pairs array<string>, need int, need_pairs int, n int, span int")
    if sum(t["n"] for t in rows) <= BROADCAST_WORDS:
        forms = F.broadcast(forms)
    pairs = parts.join(forms, "id").filter(F.size(F.array_intersect("words", "tokens")) >= F.col("need"))
    found = pairs.select("key", "label", F.col("id").alias("template"), (_best_block() / F.col("n")).alias("shared"))
    return found.groupBy("key", "label", "template").agg(F.max("shared").alias("containment")).filter("containment > 0")


def license_scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base columns tell where the fixed phrases stand, over words in lower case (A-Z) made of
    letters, digits and characters beyond ASCII; labels adds those of templates that a block
    contains to the threshold; score is the greatest containment of a template in one, 1 if
    a phrase stands in the text, else 0. A null text is an empty one, with empty labels. Null
    and repeated ids are kept, a row each. Other columns don't matter.
    """
    key = F.md5(text_of(docs))
    found = matching_blocks(docs, key, templates, containment)
    found = found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = docs.select(F.col(id_col), key.alias("_key"), *base_columns(docs))
    both = base.join(written(found, "license"), F.col("_key") == F.col("key"), "left")
    none = F.array().cast("array<string>")
    return both.select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
