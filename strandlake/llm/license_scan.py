"""License scan by an exact set-similarity join of text blocks against license templates.

Words are numbered through the whole text and cut into overlapping blocks of ``2 * stride`` words, so
that every passage of up to ``stride`` words lies whole inside one block. A block matches a template
when it holds at least ``theta`` of the template's distinct words (containment).

1. The frequency of each template word over the whole corpus gives the global order (rarest first).
2. Prefix filter: a matching block holds at least one of the ``size - need + 1`` rarest words of the
   template; only blocks with such a word are made at all.
3. Length and positional filters drop pairs that cannot reach ``need`` common words.
4. The rest is verified on the full sets.
5. ``told`` of a match says whether the block tells the template from the others. Three rules, each a number of words
   that the block must or must not hold: ``theta`` of the words that no other label's template has (``mit`` in "released
   under the mit license"); for every sibling, a template of another label that the template nearly holds (lgpl and gpl),
   a word that the sibling lacks; and, for every longer template of another label that holds all of this one's words
   (cc-by and cc-by-nc), not all of what that one has besides. ``told_apart`` keeps such matches only; ``license_scan``
   itself lists all that reach ``theta``.

Base phrases are consecutive words anywhere in the text. The template list bounds everything that is
sent to the driver or broadcast; the corpus is never shuffled by word.

Defined results: null or empty text has no words, no labels and score 0; rows that repeat a doc_id and a
text each get the same result; a null doc_id is a doc_id of its own; an empty table gives an empty table.
Other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, literal_rows, stored

#: Phrase words and the label they stand for.
BASE_PHRASES = {
    ("cc", "by"): "cc-by",
    ("general", "public", "license"): "gpl",
    ("all", "rights", "reserved"): "reserved",
}

#: Label and usual wording of license notices (lower case, words only).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
)


def _ordered_templates(tokens: DataFrame, templates, theta: float) -> tuple[list[dict], dict[str, int]]:
    """Templates with their words in the global frequency order, rarest first, and each word's rank in it."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    counts = {r[0]: r[1] for r in tokens.where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    out = []
    for label, text in templates:
        words = sorted(set(text.split()), key=rank.get)
        need = math.ceil(theta * len(words) - 1e-9)
        rules = telling_rules(label, set(words), templates, theta)
        out.append({"label": label, "words": words, "need": need, "prefix": words[: len(words) - need + 1], "rules": rules})
    return out, rank


def telling_rules(label: str, words: set[str], templates, theta: float) -> list[tuple[int, int, list[str]]]:
    """(least, most, words): how many of these words a block that holds the template must hold."""
    others = [set(text.split()) for name, text in templates if name != label]
    need = math.ceil(theta * len(words) - 1e-9)
    own = words - set().union(*others)
    rules = [(math.ceil(theta * len(own) - 1e-9), len(own), sorted(own))]
    rules += [(1, len(words - o), sorted(words - o)) for o in others if need <= len(words & o) < len(words)]
    rules += [(0, len(o - words) - 1, sorted(o - words)) for o in others if words < o]
    return rules


def _places(words: Column, phrase: tuple[str, ...], label: str) -> Column:
    def start(w, i):
        here = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            here = here & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(here, i.cast("long"))

    starts = F.filter(F.transform(words, start), lambda i: i.isNotNull())
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _phrase_starts(words: Column) -> Column:
    """Array of struct(at, label) for each place where a base phrase stands."""
    found = F.concat(*(_places(words, phrase, label) for phrase, label in BASE_PHRASES.items()))
    firsts = F.array(*(F.lit(p[0]) for p in BASE_PHRASES))
    return F.when(F.arrays_overlap(words, firsts), found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def license_scan(
    docs: DataFrame, templates=TEMPLATES, theta: float = 0.8, stride: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score and
    ``matches``, an array of (label, first word of the block, containment, told)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        alnum_words(ascii_lower(F.col("text"))).alias("words"),
    )
    ordered, rank = _ordered_templates(base.select(F.explode("words").alias("w")), templates, theta)
    # Words in rank order; array_intersect keeps the order of its first side.
    by_rank = F.array(*(F.lit(w) for w in sorted(rank, key=rank.get)))
    probes = F.array(*(F.lit(w) for w in sorted({w for t in ordered for w in t["prefix"]})))
    last_block = F.greatest(F.lit(0), F.ceil(F.size("words") / stride).cast("int") - 2)
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(probes, w), F.floor(i / stride).cast("int"))), lambda b: b.isNotNull())
    near = F.array_distinct(F.concat(F.transform("hit", lambda b: F.least(b, F.col("last"))), F.transform("hit", lambda b: F.greatest(F.lit(0), b - 1))))
    held = lambda b: F.array_intersect(by_rank, F.slice("words", b * stride + 1, 2 * stride))
    places, none = _phrase_starts(F.col("words")), F.array().cast("array<string>")
    digest = stored(
        base.select("doc_id", "h", "words", places.alias("places"), F.when(F.arrays_overlap("words", probes), hits).alias("hit"), last_block.alias("last")).select(
            "doc_id",
            "h",
            F.size("words").cast("long").alias("n_words"),
            F.size("places").cast("long").alias("n_base"),
            F.array_min(F.col("places.at")).alias("first_word"),
            F.array_max(F.col("places.at")).alias("last_word"),
            F.array_sort(F.array_distinct(F.col("places.label"))).alias("base"),
            F.transform(near, lambda b: F.struct(b.alias("block"), held(b).alias("held"))).alias("blocks"),
        ),
        "license-blocks",
    )
    blocks = digest.select("doc_id", "h", F.explode("blocks").alias("b")).select("doc_id", "h", "b.*").select("doc_id", "h", "block", "held", F.posexplode("held").alias("j", "w"))

    index = literal_rows(
        spark,
        [(w, i, len(t["words"]), t["need"], t["label"], t["words"], [{"least": a, "most": b, "words": w} for a, b, w in t["rules"]]) for t in ordered for i, w in enumerate(t["prefix"])],
        "w string, i int, t_size int, need int, label string, t_words array<string>, rules array<struct<least:int;most:int;words:array<string>>>",
    )
    size = F.size("held")
    found = (
        blocks.join(F.broadcast(index), "w")  # as many rows as the template list has prefix words
        .where((size >= F.col("need")) & (1 + F.least(F.col("t_size") - F.col("i") - 1, size - F.col("j") - 1) >= F.col("need")))
        .withColumn("common", F.size(F.array_intersect("held", "t_words")))
        .where(F.col("common") >= F.col("need"))
        .withColumn("told", F.forall("rules", lambda r: F.size(F.array_intersect("held", r["words"])).between(r["least"], r["most"])))
        .groupBy("doc_id", "h")
        .agg(
            F.max(F.col("common") / F.col("t_size")).alias("best"),
            F.collect_set("label").alias("found"),
            F.collect_set(F.struct("label", (F.col("block") * stride).alias("at"), (F.col("common") / F.col("t_size")).alias("containment"), "told")).alias("matches"),
        )
    )
    joined = digest.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    return joined.select(
        "d.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.array_sort("matches").alias("matches"),
    )


def told_apart(scanned: DataFrame) -> DataFrame:
    """Result of license_scan with labels and score from base phrases and the matches that are told from siblings."""
    sure = F.filter(F.coalesce("matches", F.array().cast(scanned.schema["matches"].dataType)), lambda m: m["told"])
    base = F.array_remove(F.split("base_labels", ","), "")
    return scanned.withColumns(
        {
            "labels": F.array_join(F.array_sort(F.array_union(base, F.transform(sure, lambda m: m["label"]))), ","),
            "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(sure, lambda m: m["containment"])), F.lit(0.0))),
            "matches": F.when(F.size(sure) > 0, sure),
        }
    )
