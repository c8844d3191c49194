"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by how many texts of the corpus have them, rarest first. A block
that holds a share t of a template's tokens holds at least one of the template's
rarest |T| - ceil(t |T|) + 1 tokens (prefix filter), has at least ceil(t |T|) tokens
of any template (length filter), and from the first common token on both have that
many tokens left (positional filter). Candidates that pass are counted exactly.
Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.session import stored

#: What ends a word: ASCII that is no digit or lower-case letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place is reported.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Public license notices, as their publishers word them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text):
    """Words of a text column, lower-cased."""
    return F.array_remove(F.split(F.lower(text), GAP), "")


def template_tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for w in re.split(GAP, text.lower()) if w))


def _tokens(words) -> list[str]:
    return sorted({w for _, t in words for w in t})


def token_order(texts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Rank of each template token by the number of texts that have it, rarest first; ties by the token.

    The result has a row for each template token at most, so it fits the driver.
    """
    vocab = F.array(*map(F.lit, tokens))
    counts = {r["token"]: r["n"] for r in texts.select(F.explode(F.array_intersect("words", vocab)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (counts.get(w, 0), w)))}


def longest(templates) -> int:
    """Words of the longest template, repeated ones counted."""
    return max(sum(1 for w in re.split(GAP, t.lower()) if w) for _, t in templates)


def similar_blocks(texts: DataFrame, templates=TEMPLATES, threshold: float = 0.9, step: int | None = None) -> DataFrame:
    """key, block, label, template, containment of every block that holds a template to ``threshold``.

    ``texts`` has key and words; equal keys must have equal words. Blocks are runs of
    2 * ``step`` words that start at each multiple of ``step`` (by default the largest
    number of distinct tokens of a template), so any run of ``step`` words lies inside one. The containment is the
    share of the template's distinct tokens that stand in the block.
    """
    sets = [(label, template_tokens(t)) for label, t in templates]
    order = token_order(texts, _tokens(sets))
    step = step or max(len(t) for _, t in sets)
    index, needs = [], {}
    for k, (label, t) in enumerate(sets):
        ranks = sorted(order[w] for w in t)
        needs[k] = math.ceil(threshold * len(t) - 1e-9)
        index += [(k, label, ranks, needs[k], len(t), i, ranks[i]) for i in range(len(t) - needs[k] + 1)]
    spark = texts.sparkSession
    least = min(needs.values())
    # both tables have as many rows as the templates have tokens, whatever the corpus
    vocab = F.broadcast(spark.createDataFrame(list(order.items()), "token string, rank int"))
    prefixes = F.broadcast(spark.createDataFrame(index, "template int, label string, ranks array<int>, need int, size int, i int, rank int"))
    rare = F.array(*[F.lit(w) for w in sorted({w for w, r in order.items() if r in {x[-1] for x in index}})])
    candidates = texts.filter(F.arrays_overlap("words", rare)).dropDuplicates(["key"])
    placed = candidates.select("key", F.posexplode("words").alias("place", "token")).join(vocab, "token")
    at = F.floor(F.col("place") / step)
    blocks = placed.select("key", "rank", F.explode(F.array(at, at - 1)).alias("block")).filter("block >= 0")
    blocks = blocks.groupBy("key", "block").agg(F.sort_array(F.collect_set("rank")).alias("own")).filter(F.size("own") >= least)
    # a block's own prefix: past it, fewer tokens are left than any template needs
    prefix = blocks.select("*", F.posexplode(F.slice("own", F.lit(1), F.size("own") - (least - 1))).alias("j", "rank"))
    met = prefix.join(prefixes, "rank").filter((F.size("own") >= F.col("need")) & (F.col("size") - F.col("i") >= F.col("need")) & (F.size("own") - F.col("j") >= F.col("need")))
    held = F.size(F.array_intersect("own", "ranks"))
    met = met.select("key", "block", "label", "template", held.alias("held"), "need", "size").filter("held >= need").dropDuplicates(["key", "block", "template"])
    return met.select("key", "block", "label", "template", (F.col("held") / F.col("size")).alias("containment"))


def _phrase(words: str, phrase: str):
    parts = phrase.split(" ")

    def here(i):
        met = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            met &= F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return met

    return F.when(F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    n_base counts places of the base phrases; first_word and last_word are their smallest
    and largest starts. labels adds those of templates found by :func:`similar_blocks`;
    score is the best containment, and 1 where a base phrase stands. A null text has no
    words. Repeated rows give equal results row by row, also with a null id. Other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.md5("text").alias("key"), words_of(F.col("text")).alias("words"))
    found = similar_blocks(texts.select("key", "words"), templates, threshold, longest(templates)).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    places = {f"p{k}": _phrase("words", phrase) for k, (phrase, _) in enumerate(BASE_PHRASES)}
    base = texts.withColumns(places).withColumn("every", F.flatten(F.array(*places)))
    own = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE_PHRASES)]))
    base = base.select("id", "key", F.size("words").cast("long").alias("n_words"), F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"), F.sort_array(F.array_distinct(own)).alias("own"))
    # the rows written are small: counts and labels, no text
    joined = stored(base, "license-base").join(found, "key", "left")
    every = F.sort_array(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
