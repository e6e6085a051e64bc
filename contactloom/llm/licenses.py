"""License scans: phrase places, and an exact set-similarity join of text blocks with notice templates.

A block is any window of ``SPAN`` times as many words as the template has, over line
breaks, so that wrapped and interrupted notices count; it matches a template if it
holds at least ``threshold`` of the template's distinct words. The words of all
templates are ordered by the number of documents of the whole corpus that hold them,
rarest first. A block can only reach the needed overlap if it holds one of the rarest
``size - needed + 1`` words of the template (prefix filter): the rare words of all
texts meet these prefixes in an equi-join. The template's words from the hit on in
the global order must still suffice, in the text and then in the surroundings of each
place of the hit (length and positional filter); what passes is counted out, window
by window, each from its rarest template word.

The prefixes are a table of at most as many rows as the templates have words. Hits are
joined back to the rows by doc_id and a key of the text; texts are never shuffled.

Defined cases: NULL text is an empty one; repeated rows are scanned one by one;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Openings of well-known notices, as single lines carry them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"),
)
THRESHOLD, SPAN = 0.8, 2
#: Prefix tables of up to so many rows are broadcast; larger ones are left to the optimiser.
BROADCAST_ROWS = 200_000


def _sequence(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(_sequence(text)))


def _flat(text: Column) -> Column:
    """The words of a text, each between single spaces: ``" a b "``."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, " ")), F.lit(" "))


def _literals(found: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in found])


def word_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The words of all templates, those of the fewest documents first (ties: the smaller word); ``docs`` has flat."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    held = F.array_intersect(_literals(vocabulary), F.split("flat", " "))
    counts = docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    of = {r["w"]: r["n"] for r in counts.collect()}  # at most one row for each word of the templates
    return sorted(vocabulary, key=lambda w: (of.get(w, 0), w))


def needed(words: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * words - 1e-9)


def prefixes(spark: SparkSession, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """word, label, rest (the template's words from this one on, in global order), size, need, span: the prefix words of all templates."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for label, text in templates:
        ws = sorted(template_words(text), key=rank.__getitem__)
        need = needed(len(ws), threshold)
        rows += [(ws[i], label, ws[i:], len(ws), need, SPAN * len(_sequence(text))) for i in range(len(ws) - need + 1)]
    return spark.createDataFrame(rows, "word string, label string, rest array<string>, size int, need int, span int")


def template_hits(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, own (labels), share: the documents with a block that meets a template; ``docs`` has doc_id, key and flat."""
    table = prefixes(docs.sparkSession, word_order(docs, templates), templates, threshold)
    wanted = sorted({r["word"] for r in table.select("word").collect()})  # at most one for each word of the templates
    words = docs.select("doc_id", "key", F.split(F.trim("flat"), " ").alias("w"))
    # only the prefix words that a text holds leave it, so texts without any end here
    held = words.select("doc_id", "key", "w", F.explode(F.array_intersect("w", _literals(wanted))).alias("word"))
    hits = held.join(F.broadcast(table) if len(wanted) <= BROADCAST_ROWS else table, "word")
    hits = hits.where(F.size(F.array_intersect("rest", "w")) >= F.col("need"))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) == F.col("word"))

    def most(p: Column) -> Column:
        near = F.slice("w", F.greatest(p - F.col("span") + 2, F.lit(1)), F.least(p + 1, F.col("span")) + F.col("span") - 1)

        def counted(x: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(x) - F.col("span") + 1, F.lit(1)))
            windows = F.transform(starts, lambda i: F.size(F.array_intersect("rest", F.slice(x, i, F.col("span")))))
            return F.when(F.size(F.array_intersect("rest", x)) >= F.col("need"), F.array_max(windows)).otherwise(0)

        return let(near, counted)

    hits = hits.select("doc_id", "key", "label", "size", "need", F.array_max(F.transform(places, most)).alias("most"))
    found = hits.where("most >= need").select("doc_id", "key", "label", (F.col("most") / F.col("size").cast("double")).alias("share"))
    return found.groupBy("doc_id", "key").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))


def _places(flat: Column, phrases) -> Column:
    """Structs (start, label) of all places of all phrases; texts without any skip the word array."""
    def here(w: Column, parts: list[str]):
        def test(i: Column) -> Column:
            found = F.get(w, i) == parts[0]
            for k, p in enumerate(parts[1:], 1):
                found = found & (F.get(w, i + k) == p)
            return F.coalesce(found, F.lit(False))

        return test

    def named(label: str):
        return lambda i: F.struct(i.cast("bigint").alias("p"), F.lit(label).alias("label"))

    def find(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 1)
        return F.concat(*[F.transform(F.filter(places, here(w, phrase.split(" "))), named(label)) for phrase, label in phrases])

    any_ = F.lit(False)
    for phrase, _ in phrases:
        any_ = any_ | F.contains(flat, F.lit(f" {phrase} "))
    return F.when(any_, let(F.split(F.trim(flat), " "), find)).otherwise(F.array().cast("array<struct<p:bigint,label:string>>"))


def license_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_).alias("key"), _flat(text_).alias("flat"))
    hits = template_hits(docs, templates, threshold).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "own", "share")
    n_words = F.when(F.trim("flat") == "", 0).otherwise(F.regexp_count("flat", F.lit(" ")) - 1).cast("bigint")
    df = docs.select("doc_id", "key", n_words.alias("n_words"), _places(F.col("flat"), phrases).alias("_at"))
    at = F.col("_at")
    base = F.array_sort(F.array_distinct(at["label"]))
    df = df.select(
        "doc_id", "key", "n_words", F.size(at).cast("bigint").alias("n_base"), F.array_min(at["p"]).alias("first_word"), F.array_max(at["p"]).alias("last_word"), base.alias("base")
    )
    df = df.join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    return df.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0))).alias("score"),
    )
