"""License scans: an exact set-similarity join of text blocks with notice templates.

Blocks are the lines of a text, and its paragraphs (runs of lines between blank ones). A
block carries a template's label if it holds at least `percent` of the template's distinct
words. Words are ordered by how many documents hold them, rarest first: a block that meets
the threshold holds one of the first |T| - need + 1 words of the template (prefix filter),
has `need` words at least (length filter), and its first shared word leaves enough words
after it in the order (positional filter). What passes is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import let

# Phrases and labels of the base, and notices as the licenses word them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files, to deal in the Software without restriction",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of"
        " the GNU General Public License as published by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification,"
        " are permitted provided that the following conditions are met",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
]
THRESHOLD_PERCENT = 90

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case; no other letter becomes one of a-z."""
    kept = text
    for letter in ("K", "İ"):
        kept = F.replace(kept, F.lit(letter), F.lit("ı"))
    return F.lower(kept)


def spaced(text: Column) -> Column:
    """The words of a lower-case text, one space between them and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _BETWEEN, " ")), F.lit(" "))


def _word_array(spaced_text: Column) -> Column:
    return F.filter(F.split(F.trim(spaced_text), " "), lambda w: w != "")


def _places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == part)
        return F.coalesce(hit, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words)), here)


def _template_words(spark, templates) -> DataFrame:
    """(template, label, words): distinct words of each template."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, text string")
    return table.select("template", "label", F.array_distinct(_word_array(spaced(lowered(F.col("text"))))).alias("words"))


def license_scan(
    docs: DataFrame, templates=tuple(TEMPLATES), phrases=None, percent: int = THRESHOLD_PERCENT
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    Words are runs of 0-9, a-z after lower-casing A-Z, and characters beyond ASCII. The base
    counts all places of `phrases`; labels are those of the base and of the templates that a
    block meets; score is the best containment found, 1 with a base label, else 0. A null or
    empty text has no words, no labels and score 0. Rows may repeat; other columns are
    ignored. The work that finds labels depends on the text alone, so it is joined back by
    the text's hash and length, not by doc_id.
    """
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    text = lowered(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", text.alias("_low"))
    wanted = _template_words(spark, templates)
    # The templates are the caller's own short list; their words are its vocabulary.
    given = wanted.collect()
    vocabulary = sorted({w for t in given for w in t["words"]})
    held = F.array_intersect(_word_array(spaced(F.col("_low"))), F.array(*map(F.lit, vocabulary)))
    counts = (
        rows.select(F.explode(held).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    df = {r["word"]: r["df"] for r in counts.collect()}
    ordered = [(t["template"], t["label"], sorted(t["words"], key=lambda w: (df.get(w, 0), w))) for t in given]
    needs = {t: max(1, -(-len(words) * percent // 100)) for t, _, words in ordered}
    index = spark.createDataFrame(
        [
            (word, t, label, pos, needs[t], words)
            for t, label, words in ordered
            for pos, word in enumerate(words[: len(words) - needs[t] + 1])
        ],
        "word string, template int, label string, pos int, need int, words array<string>",
    )
    key = [F.xxhash64("_low").alias("_key"), F.length("_low").alias("_len")]
    matches = _matches(rows, index, ordered, needs, key)
    out = _base(rows, phrases).select("*", *key)
    out = out.join(matches, ["_key", "_len"], "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def _base(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    def of(spaced_text: Column) -> Column:
        marks = [F.contains(spaced_text, F.lit(f" {p} ")) for p in phrases]
        anywhere = marks[0]
        for mark in marks[1:]:
            anywhere = anywhere | mark
        every = let(_word_array(spaced_text), lambda w: F.concat(*(_places(w, p) for p in phrases)))
        labels = F.array(*(F.when(m, F.lit(label)) for m, label in zip(marks, phrases.values())))
        gaps = F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit(""))) - 1
        return F.struct(
            F.when(spaced_text == "  ", 0).otherwise(gaps).cast("long").alias("n_words"),
            F.array_distinct(F.array_compact(labels)).alias("_base"),
            # Places are looked up only in the texts that hold a phrase.
            F.when(anywhere, every).otherwise(F.array().cast("array<int>")).alias("_places"),
        )

    found = rows.select("doc_id", "_low", let(spaced(F.col("_low")), of).alias("_b"))
    return found.select(
        "doc_id",
        "_low",
        "_b.n_words",
        "_b._base",
        F.size("_b._places").cast("long").alias("n_base"),
        F.array_min("_b._places").cast("long").alias("first_word"),
        F.array_max("_b._places").cast("long").alias("last_word"),
    )


def _matches(rows: DataFrame, index: DataFrame, ordered, needs, key) -> DataFrame:
    """(_key, _len, _found, _best): labels and best containment of the texts with a match."""
    firsts = sorted({w for t, _, words in ordered for w in words[: len(words) - needs[t] + 1]})
    some = F.arrays_overlap(_word_array(spaced(F.col("_low"))), F.array(*map(F.lit, firsts)))
    texts = rows.filter(some).select(*key, "_low")
    lines = F.split("_low", "\n")
    paragraphs = F.filter(F.split("_low", r"\n[\x20\x09-\x0D]*\n"), lambda p: F.contains(p, F.lit("\n")))
    blocks = texts.select("_key", "_len", F.posexplode(F.concat(lines, paragraphs)).alias("block", "_text"))
    sets = blocks.select(
        "_key", "_len", "block", F.array_distinct(_word_array(spaced(F.col("_text")))).alias("held")
    )
    tokens = sets.select(
        "_key", "_len", "block", "held", F.explode(F.array_intersect("held", F.array(*map(F.lit, firsts)))).alias("word")
    )
    near = tokens.join(index, "word").filter(
        # Length: enough words in the block. Position: enough words of the template from here on.
        (F.size("held") >= F.col("need")) & (F.size("words") - F.col("pos") >= F.col("need"))
    )
    shared = F.size(F.array_intersect("held", "words"))
    met = near.filter(shared >= F.col("need")).select(
        "_key", "_len", "label", (shared / F.size("words")).alias("_share")
    )
    return met.groupBy("_key", "_len").agg(
        F.array_sort(F.collect_set("label")).alias("_found"), F.max("_share").alias("_best")
    )
