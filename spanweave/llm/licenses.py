"""License scans: an exact set-similarity join of text blocks against license templates, in built-in functions only.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. A text's blocks are windows of
BLOCK words, one every STRIDE words, so that any run of up to STRIDE words lies whole in some block. Templates and blocks
are sets of words in one global order, from the rarest word of the corpus to the most frequent. A block matches a template
if it holds at least THRESHOLD of its words (overlap of at least alpha = ceil(THRESHOLD * n)). Filters that lose nothing:

* prefix: a match holds one of the template's n - alpha + 1 rarest words, so only blocks with such a word are looked at;
* length: a block with fewer than alpha of the templates' words can't match;
* positional: after the first common word, what is left of either side bounds the overlap.

Texts are split once: the places of the templates' and phrases' words go to a table of their own, from which all else follows.
The templates (bounded by this file) are the small side of the join and travel with the plan as literals, the corpus is
never shuffled; only the document frequencies of the templates' words are gathered. Null and empty texts have no words and
no labels. Rows are independent: ties, repeated rows and extra columns have no effect.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import saved

# Phrases of the base scan with their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Templates, sentences of the published license texts and usual notices. Each has ten different words or more, so
# that a match takes eight of them within a block; shorter notices are the phrases' business.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or any later version"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation either version 3 of the license or any later version"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license or any later version"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD, BLOCK, STRIDE = 0.8, 64, 32

#: Signs that no word holds, each by itself: Java's regexes look single characters up in a table, but test ranges one by one.
_GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]"


def _phrase(words: str) -> str:
    return rf"(?<!{_WORD})" + rf"{_GAP}+".join(f"(?i:{re.escape(w)})" for w in words.split()) + rf"(?!{_WORD})"


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def known_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words and at: place (from 0) and word of each word in the vocabulary (ASCII), in order. One split of the text.

    lower() also changes other letters than A-Z; of these only the Kelvin sign becomes a letter of A-Z, so it is replaced before.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.split(F.lower(F.replace(text, F.lit("\u212A"), F.lit("\u4E00"))), _GAP + "+")  # empty at an end without a word
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("_w"))
    empty = [F.when(F.element_at("_w", k) == "", 1).otherwise(0) for k in (1, -1)]
    n_words = F.when(F.size("_w") == 1, 1 - empty[0]).otherwise(F.size("_w") - empty[0] - empty[1]).cast("long")
    at = F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(vocabulary), F.struct((i - empty[0]).alias("i"), w.alias("w")))))
    return rows.select("doc_id", n_words.alias("n_words"), at.alias("at"))


def _starts(phrase: str) -> Column:
    """Where the phrase's words stand consecutively: then they are neighbours in column at, too."""
    own = phrase.split()

    def here(x: Column, k: Column) -> Column:
        same = x["w"] == own[0]
        for n, w in enumerate(own[1:], 1):
            then = F.get("at", k + n)
            same = same & F.coalesce((then["w"] == w) & (then["i"] == x["i"] + n), F.lit(False))
        return same

    return F.transform(F.filter("at", here), lambda x: x["i"])


def word_order(known: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary from the rarest word in the texts (by document frequency, then by code point)."""
    rows = known.select(F.explode(F.array_distinct(F.transform("at", lambda x: x["w"]))).alias("word")).groupBy("word").count().collect()  # as many rows as words at most
    count = {r["word"]: r["count"] for r in rows}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, stride: int = STRIDE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches: (block, template, overlap)."""
    if any(len(t.split()) > stride for _, t in templates):
        raise ValueError("a template is longer than the stride between blocks")
    own = {w for _, t in templates for w in t.split()}
    known = saved(known_words(docs, sorted(own | {w for p in PHRASES.values() for w in p.split()})), "license-words")
    order = word_order(known, sorted(own))
    rank = {w: i + 1 for i, w in enumerate(order)}
    sets = [sorted({rank[w] for w in t.split()}) for _, t in templates]
    alpha = [math.ceil(threshold * len(s)) for s in sets]
    prefix = [s[: len(s) - a + 1] for s, a in zip(sets, alpha, strict=True)]
    rare = [order[r - 1] for r in sorted({r for p in prefix for r in p})]
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    index = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(len(s)).alias("n"), F.lit(a).alias("alpha"), ints(p).alias("prefix"), ints(s).alias("ranks")) for k, (s, a, p) in enumerate(zip(sets, alpha, prefix, strict=True))])

    places = known.withColumn("_places", F.array(*map(_starts, PHRASES.values()))).withColumn("_all", F.flatten("_places"))
    held = [F.when(F.size(F.get("_places", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(PHRASES)]
    base = places.select("doc_id", "n_words", "at", F.size("_all").cast("long").alias("n_base"), F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"), F.array_sort(F.array_compact(F.array(*held))).alias("base"))

    def near(x: Column) -> Column:
        return F.when(x["w"].isin(rare), F.array(F.greatest(F.floor(x["i"] / stride) - 1, F.lit(0)), F.floor(x["i"] / stride)))

    def ranked(b: Column) -> Column:
        inside = F.filter("at", lambda x: (x["i"] >= b * stride) & (x["i"] < b * stride + block) & x["w"].isin(order))
        return F.array_sort(F.array_distinct(F.transform(inside, lambda x: F.array_position(_strings(order), x["w"]).cast("int"))))

    def similar(x: Column) -> Column:
        """The templates that block x matches, by filters and then by their overlap."""
        mine = x["ranks"]

        def passes(t: Column) -> Column:
            first = F.element_at(F.array_intersect(mine, t["prefix"]), 1)
            left = F.least(t["n"] - F.array_position(t["ranks"], first), F.size(mine) - F.array_position(mine, first))
            return (F.size(mine) >= t["alpha"]) & F.arrays_overlap(mine, t["prefix"]) & (left + 1 >= t["alpha"])

        verified = F.transform(F.filter(index, passes), lambda t: F.struct(x["block"].alias("block"), t["k"].alias("template"), F.size(F.array_intersect(mine, t["ranks"])).alias("overlap"), t["n"].alias("n"), t["alpha"].alias("alpha")))
        return F.filter(verified, lambda m: m["overlap"] >= m["alpha"])

    looked_at = F.array_distinct(F.flatten(F.array_compact(F.transform("at", near))))
    out = base.withColumn("blocks", F.transform(looked_at, lambda b: F.struct(b.alias("block"), ranked(b).alias("ranks")))).drop("at")
    out = out.withColumn("matches", F.flatten(F.transform("blocks", similar))).drop("blocks")
    names = _strings([label for label, _ in templates])
    labels = F.array_sort(F.array_union("base", F.transform("matches", lambda m: F.element_at(names, m["template"] + 1))))
    best = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["overlap"] / m["n"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score"), "matches")


def license_digest(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).drop("matches")
