"""License scans: phrases, and an exact set-similarity join of text blocks with license templates. SQL functions only.

A template is found in a text if some run of as many words as the template has, over any line breaks, holds at least
``threshold`` of the template's distinct words, and all of those that tell it from its like (marked by a star in it,
such as a version). Runs are found by blocks: with s the words of the longest template, block k is the words from k * s
on, 2 * s of them, so that every run lies in a block. A block's set is its distinct words. A text whose words all
together hold too few of every template is done with; the blocks of others are joined by prefix filtering, for
containment:

* Tokens are ordered by how many of these blocks of the whole corpus hold them, rarest first (ties by token). Words that no
  template has can match nothing, so a block's set keeps the templates' words only; its size stays exact for the
  overlap, which is all that containment asks of it.
* Prefix: a template of n words needs an overlap of c = ceil(threshold * n), so one of its n - c + 1 rarest words is in
  every block that matches, and likewise one of a block's m - c + 1 rarest. Candidates come from an equi-join on those.
* Length: m >= c.
* Position: if the shared word is at place i of the template's order and j of the block's, at most
  min(n - i, m - j) words can follow and the first shared word has none before it, so 1 + min(...) >= c.
* What is left is verified: by the overlap of the sets, and then by the runs of the block that start with one of the
  template's words (others hold no more than the next such run).

Blocks with the same set of template words are one row, made before the shuffle; the templates' side is as small as
the list of templates and is broadcast (its words times templates, fixed by the parameter). Pairs of a set and a
template that are left are written, and Spark ships them to the blocks if they're small by their written size, and
shuffles otherwise. The frequencies are counts over these blocks by template word: as many rows as the templates have
words. Nothing is sampled or capped.

Defined results: a null text counts as empty, has no words, no labels and score 0; a text of any length is read whole;
repeated rows get equal results; a null doc_id is carried through; an empty table gives no rows; a template without
words is ignored; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut

#: Phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Sentences of public licenses and notices, by the label they stand for. A star follows a word that must be there.
TEMPLATES = {
    "gpl-3.0": ("This work is licensed under the GNU* General Public License, version 3*.", "GNU* General Public License version 3*"),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU* General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but without any warranty*",
    ),
    "apache-2.0": (
        "Licensed under the Apache* License, Version 2*.0.",
        'Licensed under the Apache* License, Version 2*.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "mit-text": (
        "Released under the MIT* License*.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software',
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    "cc-by-nc-4.0": ("Licensed under CC* BY-NC* 4*.0.", "This work is licensed under a Creative Commons* Attribution-NonCommercial* 4*.0 International License"),
    "cc-by-4.0": ("This work is licensed under a Creative Commons* Attribution* 4*.0 International License",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla* Public License",),
}
THRESHOLD = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_words(text: str) -> list[str]:
    """The same words, of a template."""
    import re

    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def phrase_columns(text: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels from a text's words, each written as |word|."""
    marks = {p: "".join(f"|{w}|" for w in p.split()) for p in phrases}
    found = {p: F.contains(text, F.lit(m)) for p, m in marks.items()}
    count = lambda t, m: ((F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m)).cast("long")
    before = lambda t, at: count(F.substring(t, F.lit(1), at - 1), "||")
    first, last, total, labels = [], [], [], []
    for p, m in marks.items():
        at = F.locate(m, text)
        # The text before the place ends with a whole word, so its words are one more than its "||", if it has any.
        first.append(F.when(found[p], F.when(at == 1, F.lit(0)).otherwise(before(text, at) + 1).cast("long")))
        back = F.length(text) - F.locate(m[::-1], F.reverse(text)) - len(m) + 2
        last.append(F.when(found[p], F.when(back == 1, F.lit(0)).otherwise(before(text, back) + 1).cast("long")))
        total.append(F.when(found[p], count(text, m)).otherwise(F.lit(0).cast("long")))
        labels.append(F.when(found[p], F.lit(phrases[p])))
    return {
        "n_base": reduce(lambda a, b: a + b, total),
        "first_word": F.least(*first) if len(first) > 1 else first[0],
        "last_word": F.greatest(*last) if len(last) > 1 else last[0],
        "_base": F.array_compact(F.array(*labels)),
    }


class Template(NamedTuple):
    id: str
    label: str
    words: list[str]  # distinct, sorted
    need: int  # how many of them a run must hold
    span: int  # words of a run
    must: list[str]  # those that it must hold


def parsed(templates: Mapping[str, tuple[str, ...]], threshold: float) -> list[Template]:
    """The templates that have a word."""
    out = []
    for label, group in sorted(templates.items()):
        for k, text in enumerate(group):
            own = template_words(text)
            ws = sorted(set(own))
            must = sorted({template_words(x)[-1] for x in text.split("*")[:-1] if template_words(x)})
            if ws:
                out.append(Template(f"{label}/{k}", label, ws, max(1, math.ceil(threshold * len(ws) - 1e-9)), len(own), must))
    return out


def _strings(values: Iterable[str]) -> Column:
    """An array of strings; an empty one too."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def blocks_of(tokens: Column, known: Column, span: int, least: int) -> Column:
    """array<struct<words, set>>: a text's blocks that hold at least least known words. words: null where it isn't known."""
    block = lambda k: F.slice(tokens, k * span + 1, F.lit(2 * span))
    mark = lambda k: F.struct(
        F.transform(block(k), lambda w: F.when(F.array_contains(known, w), w)).alias("words"),
        F.array_sort(F.array_intersect(block(k), known)).alias("set"),
    )
    last = F.floor((F.size(tokens) - 1) / span).cast("int")
    every = F.transform(F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>")), mark)
    return F.filter(every, lambda x: F.size(x["set"]) >= least)


def block_matches(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """_row, label, containment: the best containment of each label's templates that reaches the threshold.

    rows: _row, words, set; see blocks_of.
    """
    spark = rows.sparkSession
    least = min((t.need for t in templates), default=1)  # of the smallest template
    tally = rows.groupBy("set").agg(F.count("*").alias("n"))
    frequency = tally.select(F.explode("set").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    order = F.broadcast(frequency)  # a row per template word
    shape = "id string, label string, size int, need int, span int, must array<string>, token string"
    each = [F.struct(F.lit(t.id), F.lit(t.label), F.lit(len(t.words)), F.lit(t.need), F.lit(t.span), _strings(t.must), F.lit(w)) for t in templates for w in t.words]
    held = spark.range(1).select(F.inline(F.array(*each).cast(f"array<struct<{shape.replace(' ', ':').replace(',:', ',')}>>")))
    held = held.join(order, "token", "left")
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))))
    held = held.groupBy("id", "label", "size", "need", "span", "must").agg(ranked.alias("own"))
    prefix = held.select("*", F.posexplode(F.slice("own", F.lit(1), F.col("size") - F.col("need") + 1)).alias("i", "shared"))
    prefix = prefix.select("id", "label", "size", "need", "span", "must", "i", F.transform("own", lambda x: x["token"]).alias("wanted"), F.col("shared.token").alias("token"))
    tokens = tally.filter(F.size("set") >= least).select("set", F.explode("set").alias("token")).join(order, "token")
    sorted_sets = tokens.groupBy("set").agg(ranked.alias("order"))
    own = sorted_sets.select("set", F.size("set").alias("m"), F.posexplode(F.slice("order", F.lit(1), F.greatest(F.size("order") - least + 1, F.lit(0)))).alias("j", "shared"))
    near = own.select("set", "m", "j", F.col("shared.token").alias("token")).join(F.broadcast(prefix), "token")
    near = near.filter((F.col("m") >= F.col("need")) & (F.col("j") <= F.col("m") - F.col("need")))
    near = near.filter(1 + F.least(F.col("size") - 1 - F.col("i"), F.col("m") - 1 - F.col("j")) >= F.col("need"))
    near = near.filter((F.size(F.array_intersect("set", "wanted")) >= F.col("need")) & (F.size(F.array_intersect("set", "must")) == F.size("must")))
    near = cut(near.select("set", "id", "label", "size", "need", "span", "must", "wanted").dropDuplicates(["set", "id"]), "near")
    run = lambda i: F.slice("words", i + 1, F.col("span"))
    whole = lambda i: F.size(F.array_intersect(run(i), F.col("must"))) == F.size("must")
    best = F.array_max(F.transform("words", lambda w, i: F.when(F.array_contains("wanted", w) & whole(i), F.size(F.array_intersect(run(i), F.col("wanted"))))))
    found = rows.join(near, "set").withColumn("best", best).filter(F.col("best") >= F.col("need"))
    return found.groupBy("_row", "label").agg(F.max(F.col("best") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 if a phrase is found, else the greatest containment of a template, which is below the threshold nowhere.
    """
    held = parsed(templates, threshold)
    known = _strings(sorted({w for t in held for w in t.words}))
    # Equal (doc_id, text) rows get equal results, so a row's key is made of both and matches are joined by it.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_of = F.col("doc_id").cast("long")
    key = F.struct(id_of.isNull(), F.coalesce(id_of, F.lit(0)), F.xxhash64(text), F.octet_length(text))
    rows = docs.select(id_of.alias("doc_id"), key.alias("_row"), words(text).alias("_words")).withColumn("_known", F.array_intersect("_words", known))
    some = reduce(lambda a, b: a | b, [F.size(F.array_intersect("_known", _strings(t.words))) >= t.need for t in held], F.lit(False))
    none = F.array().cast("array<struct<words:array<string>,set:array<string>>>")
    blocks = blocks_of(F.col("_words"), known, max((t.span for t in held), default=1), min((t.need for t in held), default=1))
    rows = rows.select("doc_id", "_row", F.when(some, blocks).otherwise(none).alias("_blocks"), F.size("_words").cast("long").alias("n_words"), F.concat(F.lit("|"), F.array_join("_words", "||"), F.lit("|")).alias("_text"))
    base = phrase_columns(F.col("_text"), phrases)
    rows = cut(rows.select("doc_id", "_row", "_blocks", "n_words", *[c.alias(k) for k, c in base.items()]), "blocks")
    matches = block_matches(rows.select("_row", F.inline("_blocks")), held)
    best = matches.groupBy("_row").agg(F.collect_set("label").alias("_own"), F.max("containment").alias("_score"))
    out = rows.join(best, "_row", "left")
    own = F.coalesce(F.col("_own"), _strings(()))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("_score"), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("_base")).alias("base_labels"), join(F.concat("_base", own)).alias("labels"), score.alias("score"))
