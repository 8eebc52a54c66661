"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a line of a text; its set are its distinct words. A template matches a block that contains at least
`threshold` of the template's distinct words. Tokens are ordered by their frequency over all blocks, rarest first, and

- prefix filter: a block that has t of a template's n tokens has one of its n - t + 1 rarest;
- length filter: a block has at least t tokens of the templates' vocabulary;
- positional filter: if the first of those common tokens is the template's i-th and the block's j-th, then no more than
  the smaller of the tokens left in both can be common.

What passes is counted in full, so the join is exact. The templates and their index are fixed and small: they are
literals of the plan and nothing is shuffled but the counts of the templates' own words.

Notices are wrapped, so a template is also held against runs of lines: windows of as many words as it has itself divided
by `threshold`, in one document, from each of its words on. Only documents with enough of a template's words are cut
into windows.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import small, stored

#: Texts with matches are broadcast up to so many (some 100 bytes each); beyond, rows are shuffled to them.
TEXTS_AT_ONCE = 200_000
#: Java's regex for what is between words; words themselves are compared after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base scan and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences of public licenses and the labels they give.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-warranty": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution International License",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
}


def _tokens(text: str) -> list[str]:
    return sorted({x for x in re.split(NOT_WORD, text.lower()) if x})


def words(text: Column) -> Column:
    """The words of a text in order, as they are written; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else: lower() may make ASCII letters of other characters, so those are set apart first."""
    return F.when(text.rlike("[\\u0130\\u212A]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _required(n: int, threshold: float) -> int:
    return max(1, math.ceil(n * threshold - 1e-9))


def blocks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(of, block, tokens): of each line the distinct words that are in `vocabulary`, if there are any."""
    known = F.array(*map(F.lit, vocabulary))
    lines = docs.select("of", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    return lines.select("of", "block", F.array_intersect(words(lowered(F.col("line"))), known).alias("tokens")).where(F.size("tokens") > 0)


def frequencies(found: DataFrame) -> dict[str, int]:
    """In how many blocks of all documents each word of the vocabulary occurs: at most as many rows as that has words."""
    rows = found.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def match(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(of, block, template, containment) of every line that holds at least `threshold` of a template's words.

    docs: text and of, the text's hash, by which results are told apart: equal texts have equal ones. A null or empty text
    has no block; so has an empty table. Ties need no order: each pair of block and template that reaches the threshold is
    returned once for each row. Blocks, which are a fraction of the text, are stored once, counted and matched.
    """
    sets = {k: _tokens(v) for k, v in (templates or TEMPLATES).items()}
    vocabulary = sorted({x for v in sets.values() for x in v})
    every = stored(blocks(docs, vocabulary), "blocks")
    count = frequencies(every)
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (count.get(x, 0), x)))}
    entries = []
    for name, tokens in sets.items():
        order = sorted(tokens, key=rank.__getitem__)
        need = _required(len(order), threshold)
        entries += [(x, name, i, order, need) for i, x in enumerate(order[: len(order) - need + 1])]
    index = docs.sparkSession.createDataFrame(entries, "token string, template string, i int, body array<string>, need int")
    least = min(e[4] for e in entries)
    # only lines with a prefix token and enough words of the vocabulary go on
    prefix = F.array(*(F.lit(x) for x in sorted({e[0] for e in entries})))
    found = every.where((F.size("tokens") >= least) & F.arrays_overlap("tokens", prefix))
    ranks = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    by_rank = F.transform(F.array_sort(F.transform("tokens", lambda x: F.struct(F.element_at(ranks, x).alias("r"), x.alias("token")))), lambda x: x["token"])
    found = found.withColumn("tokens", by_rank).select("*", F.posexplode("tokens").alias("j", "token"))
    pairs = found.join(F.broadcast(index), "token").where(
        (F.size("tokens") >= F.col("need"))
        & (F.least(F.size("body") - F.col("i"), F.size("tokens") - F.col("j")) >= F.col("need"))
        & (F.size(F.array_intersect(F.slice("body", 1, F.col("i")), "tokens")) == 0)
    )
    pairs = pairs.withColumn("common", F.size(F.array_intersect("body", "tokens"))).where("common >= need")
    return pairs.select("of", "block", "template", (F.col("common") / F.size("body")).alias("containment"))


def passages(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(of, block, template, containment) of every window over several lines that holds at least `threshold` of a
    template's words; block is the line of its first one. Of windows from one line on, the best is returned.

    docs: as in match().
    """
    bodies = templates or TEMPLATES
    facts = []
    for name, body in bodies.items():
        n = len([x for x in re.split(NOT_WORD, body) if x])
        facts.append((name, _tokens(body), math.ceil(n / threshold - 1e-9), _required(len(_tokens(body)), threshold)))
    vocabulary = sorted({x for f in facts for x in f[1]})
    listed = lambda xs: F.array(*map(F.lit, xs))
    fact = lambda name, of, width, need: F.struct(F.lit(name).alias("template"), listed(of).alias("body"), F.lit(width).alias("width"), F.lit(need).alias("need"))
    every = F.array(*(fact(*f) for f in facts))
    # arrays of one element and their explosion make sure that what stands in them is computed once
    enough = F.transform(F.array(F.array_intersect(words(lowered(F.col("text"))), listed(vocabulary))), lambda have: F.filter(every, lambda t: F.size(F.array_intersect(have, t["body"])) >= t["need"]))
    found = docs.where(F.col("text").contains("\n")).select("of", "text", F.explode(F.flatten(enough)).alias("t"))
    by_line = F.transform(F.split("text", "\n"), lambda line, i: F.transform(words(lowered(line)), lambda w: F.struct(i.alias("block"), w.alias("word"))))
    placed = F.transform(F.flatten(by_line), lambda x, i: F.struct(i.alias("at"), x["block"].alias("block"), x["word"].alias("word")))
    hits = found.select("of", "t", F.explode(F.array(F.filter(placed, lambda x: F.array_contains(F.col("t.body"), x["word"])))).alias("hits"))

    def window(x: Column, i: Column) -> Column:
        held = F.filter(F.slice("hits", i + 1, F.col("t.width")), lambda y: y["at"] < x["at"] + F.col("t.width"))
        return F.transform(F.array(held), lambda h: F.struct(x["block"].alias("block"), F.element_at(h, -1)["block"].alias("last"), F.size(F.array_distinct(F.transform(h, lambda y: y["word"]))).alias("common")))[0]

    windows = hits.select("of", "t", F.explode(F.transform("hits", window)).alias("x")).where("x.common >= t.need and x.last > x.block")
    return windows.groupBy("of", "x.block", "t.template").agg(F.max(F.col("x.common") / F.size("t.body")).alias("containment"))


def _stands(parts: list[str]):
    return lambda x, i: F.when(functools.reduce(operator.and_, (x[f"w{k}"] == p for k, p in enumerate(parts))), i)


def _place(size: int, label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.lit(label).alias("label"))


def phrase_places(text: Column, phrases: dict[str, str] | None = None) -> Column:
    """array<struct<at, size, label>> of all places, in words from 0, where a phrase's words stand one after the other."""
    found = F.array().cast("array<struct<at:int,size:int,label:string>>")
    low = words(lowered(text))
    for phrase, label in (phrases or PHRASES).items():
        parts = phrase.split()
        # cheap test of the whole text first; only texts that may have the phrase are cut into words
        may = F.coalesce(text.rlike("(?i)" + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+".join(parts)), F.lit(False))
        # each place with the words from there on; `low` stands outside the lambdas, so it is made once a text
        beside = F.arrays_zip(*(F.slice(low, k + 1, 1 << 30).alias(f"w{k}") for k in range(len(parts))))
        hits = F.filter(F.transform(beside, _stands(parts)), lambda x: x.isNotNull())
        places = F.transform(hits, _place(len(parts), label))
        found = F.concat(found, F.when(may, places).otherwise(F.array().cast("array<struct<at:int,size:int,label:string>>")))
    return found


def scan(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, places, templates array<struct<template, block, containment>>) for each row of docs: templates
    that match a line, or a passage over several lines from that line on.

    A null text counts as empty: no words, places or templates. Repeated rows are kept, each with its own result, and equal
    texts have equal ones. Texts of any length are read in full; other columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("of", F.xxhash64("text"))
    found = match(docs, threshold=threshold).unionByName(passages(docs, threshold=threshold))
    by_text = stored(found.groupBy("of").agg(F.sort_array(F.collect_set(F.struct("template", "block", "containment"))).alias("templates")), "matches")
    n = F.size(words(F.col("text"))).cast("long")
    facts = docs.select("of", "doc_id", n.alias("n_words"), phrase_places(F.col("text")).alias("places"))
    none = F.array().cast("array<struct<template:string,block:int,containment:double>>")
    return facts.join(small(by_text, TEXTS_AT_ONCE), "of", "left").select("doc_id", "n_words", "places", F.coalesce("templates", none).alias("templates"))
