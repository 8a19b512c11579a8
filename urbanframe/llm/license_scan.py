"""Licence texts by an exact set-similarity join of text blocks with templates.

A block is a line; a template is the set of words of a licence sentence. A block
matches when it holds at least ``threshold`` of a template's words. The join
orders all template words by how many blocks of the corpus have them, rarest
first, and meets block and template only on a template's prefix: so many of its
rarest words that a matching block must have one. Blocks with too few template
words (length filter) and meetings too late in the order to still reach the
threshold (positional filter) are dropped before the words are compared.

Beside it stand the base phrases, counted wherever their words follow each other.

Words are runs of digits, letters and all characters beyond ASCII, after
lower-casing A-Z. Null counts as empty: no words, no labels, score 0. Rows that
repeat id and text have equal results; other columns are ignored; ties need no
rule. An empty table gives an empty result. Everything is DataFrame expressions;
the template side is a fixed list, so it may be broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanframe.llm.common import ascii_lower, shared

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of licences (label, sentence).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
)


def needed(words: int, threshold: float) -> int:
    """Words of a template that a matching block must have."""
    return math.ceil(threshold * words - 1e-9)


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))


def template_blocks(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, h, line, words: the blocks with template words, each once."""
    universe = sorted({w for _, t in templates for w in t.split()})
    lines = docs.select("doc_id", "h", F.posexplode(F.split("low", "\n")).alias("line", "block"))
    words = lines.select("doc_id", "h", "line", F.array_distinct(F.filter(_words("block"), lambda w: w.isin(universe))).alias("words"))
    return words.where(F.size("words") > 0)


def ordered_templates(spark: SparkSession, blocks: DataFrame, threshold: float, templates=TEMPLATES) -> DataFrame:
    """A row for each word of a template's prefix, with what the filters need."""
    rows = [(i, label, w) for i, (label, t) in enumerate(templates) for w in sorted(set(t.split()))]
    words = spark.createDataFrame(rows, "template int, label string, word string")
    held = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = words.join(held, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = lambda by: Window.partitionBy(*by).orderBy("n", "word")
    rarer = Window.partitionBy(F.lit(0)).orderBy("n", "word").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumn("rarer", F.array_remove(F.collect_set("word").over(rarer), F.col("word")))  # a fixed list of words
    own = Window.partitionBy("template").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = words.withColumns({"at": F.row_number().over(order(["template"])) - 1, "all_words": F.collect_list("word").over(own)})
    size = F.size("all_words")
    return words.withColumn("needed", F.ceil(threshold * size - 1e-9).cast("int")).where(F.col("at") <= size - F.col("needed"))


def matches(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, h, line, template, label, share of every block that meets the threshold; docs: doc_id, h, low."""
    blocks = shared(template_blocks(docs, templates))
    prefixes = shared(ordered_templates(spark, blocks, threshold, templates))
    met = blocks.select("doc_id", "h", "line", "words", F.explode("words").alias("word")).join(F.broadcast(prefixes), "word")
    met = met.where(F.size("words") >= F.col("needed"))
    before = F.size(F.array_intersect("words", F.slice("all_words", F.lit(1), F.col("at"))))
    rest = F.least(F.size("all_words") - F.col("at"), F.size("words") - F.size(F.array_intersect("words", "rarer")))
    met = met.where(before + rest >= F.col("needed"))
    shared_words = F.size(F.array_intersect("words", "all_words"))
    found = met.where(shared_words >= F.col("needed"))
    return found.select("doc_id", "h", "line", "template", "label", (shared_words / F.size("all_words")).alias("share")).distinct()


def phrase_places(words: str) -> Column:
    """Array of (start, label) of every place where the words of a phrase follow each other."""
    tests = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        at = " AND ".join(f"get({words}, i + {k}) = '{p}'" for k, p in enumerate(parts))
        tests.append(f"WHEN {at} THEN '{label}'")
    label = f"CASE {' '.join(tests)} END"
    return F.expr(f"filter(transform(sequence(0, size({words})), i -> struct(i AS start, {label} AS label)), x -> x.label IS NOT NULL)")


def scanned(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    low = docs.select("doc_id", ascii_lower(F.col("text")).alias("low")).withColumn("h", F.xxhash64("low"))
    found = matches(spark, low, threshold, templates).groupBy("doc_id", "h").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("score")
    )
    any_phrase = F.lit(False)
    for phrase in PHRASES:
        any_phrase = any_phrase | F.contains(F.col("low"), F.lit(phrase.split()[-1]))
    base = low.select(
        "doc_id", "h", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(any_phrase, _words("low")).otherwise(F.array().cast("array<string>")).alias("words"),
    ).withColumn("places", phrase_places("words"))
    base = base.select(
        "doc_id", "h", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"), F.array_max("places.start").cast("long").alias("last_word"),
        F.array_distinct("places.label").alias("own"),
    )
    found = found.select(F.col("doc_id").alias("_doc_id_"), F.col("h").alias("_h_"), "more", "score")
    both = base.join(shared(found), F.col("doc_id").eqNullSafe(F.col("_doc_id_")) & (F.col("h") == F.col("_h_")), "left")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("own")).alias("base_labels"),
        joined(F.concat("own", F.coalesce("more", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """Every line compared with every template, without filters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sets = ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for label, t in templates)
    tests = []
    for phrase, label in PHRASES.items():
        at = " AND ".join(f"lead(word, {k}) OVER s = '{p}'" if k else f"word = '{p}'" for k, p in enumerate(phrase.split()))
        tests.append(f"WHEN {at} THEN '{label}'")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{WORD}') AS words FROM d),
o AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w),
p AS (SELECT doc_id, pos, CASE {' '.join(tests)} END AS label FROM o WINDOW s AS (PARTITION BY doc_id ORDER BY pos)),
b AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         list(DISTINCT label) AS own FROM p WHERE label IS NOT NULL GROUP BY doc_id
), l AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS block FROM d),
v AS (SELECT doc_id, list_distinct(regexp_extract_all(block, '{WORD}')) AS words FROM l),
t(label, words) AS (VALUES {sets}),
m AS (SELECT doc_id, label, len(list_intersect(v.words, t.words)) AS n, len(t.words) AS size FROM v, t),
f AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(n / size) AS score FROM m
  WHERE n >= ceil({threshold} * size - 1e-9) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN f ON w.doc_id = f.doc_id
"""
