"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are windows over the words of a document, so that a notice may be
wrapped, indented or set in comment signs: with s the words of the longest
template, block i holds the 2 s words from place i s on. Any s + 1 consecutive
words are thus together in a block. A template matches a block that holds at
least ``threshold`` tenths of its distinct words. The words of all templates are
ordered by the number of blocks they occur in, over all documents, rarest first. With o the least overlap of a template:

* length filter: a block with fewer than o template words can't match;
* prefix filter: a matching block shares a word of its own first
  ``size - o + 1`` words with the template's first ``size - o + 1``;
* positional filter: at the first shared word, what follows on either side
  still allows an overlap of o.

Pairs that pass are counted in full, so the result is exact. Words outside the
templates never count for an overlap and are dropped while a text is read, so
only blocks with enough template words leave the scan. Texts are split into
words once: what blocks hold is written to a table (a few words of the
templates each), which both the counts and the join read.

Besides, base phrases are counted where their words stand consecutively in the
whole text. All of it is DataFrame expressions.

Defined results: null and empty texts have no words, no labels and score 0;
rows are keyed by doc_id and text, so repeated rows get equal results, one row
each; a null doc_id stays null.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import common

# Everything but 0-9, a-z and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Usual notice texts, as lower-case words, and their labels.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license version"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spaced(text: Column) -> Column:
    """Every word of a lower-cased text between two blanks of its own: ' a  b  c '."""
    inner = F.trim(F.regexp_replace(text, SEPARATORS, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def words_in(spaced_text: Column) -> Column:
    """Number of words, as half the number of blanks."""
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("long")


def phrase_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """n_words, n_base, first_word, last_word and found (labels) in place of ``spaced``."""
    counts, firsts, lasts, found = [], [], [], []
    out = docs.withColumn("n_words", words_in(F.col("spaced")))
    for phrase, label in phrases.items():
        words = phrase.split()
        if len(set(words)) < len(words):
            raise ValueError(f"a base phrase must not repeat a word: {phrase}")
        mark = "".join(f" {w} " for w in words)
        here = F.col("spaced").contains(mark)
        without = F.length(F.replace(F.col("spaced"), F.lit(mark), F.lit("")))
        counts.append(F.when(here, (F.length("spaced") - without) / len(mark)).otherwise(0).cast("long"))
        firsts.append(F.when(here, words_in(F.substring_index("spaced", mark, 1))))
        tail = words_in(F.substring_index("spaced", mark, -1))
        lasts.append(F.when(here, F.col("n_words") - tail - len(words)))
        found.append(F.when(here, F.lit(label)))
    least = firsts[0] if len(firsts) == 1 else F.least(*firsts)
    most = lasts[0] if len(lasts) == 1 else F.greatest(*lasts)
    return out.select(
        *[c for c in docs.columns if c != "spaced"],
        "n_words",
        functools.reduce(lambda a, b: a + b, counts).alias("n_base"),
        least.alias("first_word"),
        most.alias("last_word"),
        F.array_compact(F.array(*found)).alias("found"),
    )


def stride(templates: list[tuple[str, str]]) -> int:
    """Words from the beginning of a block to that of the next: those of the longest template."""
    return max(len(words.split()) for _, words in templates)


def blocks(spaced_text: Column, vocabulary: list[str], step: int, least: int) -> Column:
    """Array of (block, held): the template words of each block that has at least ``least`` of them."""

    def of(words: Column) -> Column:
        last = F.greatest(F.ceil(F.size(words) / step).cast("int") - 2, F.lit(0))
        every = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.alias("block"),
                F.array_intersect(F.lit(vocabulary), F.slice(words, i * step + 1, F.lit(2 * step))).alias("held"),
            ),
        )
        return F.filter(every, lambda b: F.size(b["held"]) >= least)

    # as the element of an array, the words are split once and not anew for each block
    return F.flatten(F.transform(F.array(F.split(F.trim(spaced_text), "  ")), of))


def template_matches(held: DataFrame, templates: list[tuple[str, str]], threshold: int) -> DataFrame:
    """(did, text_key, block, label, containment) of every block that meets a template's threshold.

    ``held`` has the template words of the blocks as (did, text_key, block, held). ``threshold`` is in tenths.
    Templates are a fixed list, so their words are a bounded vocabulary; the driver receives one count for each.
    """
    sets, least = template_sets(templates, threshold)
    words = sorted({w for _, s in sets for w in s})
    counted = held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    seen = {r["word"]: r["n"] for r in counted}
    ordered = sorted(words, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(ordered)}
    index = [
        (k, label, need, len(s), token, i)
        for k, ((label, s), need) in enumerate(zip(sets, least, strict=True))
        for i, token in enumerate(sorted(s, key=place.get)[: len(s) - need + 1])
    ]
    spark = held.sparkSession
    prefixes = spark.createDataFrame(
        index, "template int, label string, need int, size int, word string, t_place int"
    )
    full = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(sets)], "template int, words array<string>")
    many = F.size("held")
    in_order = held.withColumn("held", F.array_intersect(F.lit(ordered), F.col("held")))
    posted = in_order.select("*", F.posexplode(F.slice("held", F.lit(1), many - min(least) + 1)).alias("place", "word"))
    # both tables have a fixed size: the list of templates
    candidates = (
        posted.join(F.broadcast(prefixes), "word")
        .where((many >= F.col("need")) & (F.col("place") <= many - F.col("need")))
        .where(F.least(many - F.col("place"), F.col("size") - F.col("t_place")) >= F.col("need"))
        .groupBy("did", "text_key", "block", "template", "label", "need", "size")
        .agg(F.first("held").alias("held"))
    )
    shared = F.size(F.array_intersect("held", "words"))
    return (
        candidates.join(F.broadcast(full), "template")
        .withColumn("shared", shared)
        .where(F.col("shared") >= F.col("need"))
        .select("did", "text_key", "block", "label", (F.col("shared") / F.col("size")).alias("containment"))
    )


def template_sets(templates: list[tuple[str, str]], threshold: int) -> tuple[list[tuple[str, list[str]]], list[int]]:
    """Labels and distinct words of the templates, and the least overlap of each."""
    sets = [(label, sorted(set(words.split()))) for label, words in templates]
    return sets, [-(-threshold * len(s) // 10) for _, s in sets]


def scan(
    docs: DataFrame,
    *,
    phrases: dict[str, str] = BASE_PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: int = 9,
) -> DataFrame:
    """One row per document: word and phrase counts, labels and the best containment."""
    sets, least = template_sets(templates, threshold)
    vocabulary = sorted({w for _, s in sets for w in s})
    texts = common.whole_texts(docs)
    texts = texts.select("did", F.xxhash64("text").alias("text_key"), spaced(lowered(F.col("text"))).alias("spaced"))
    held = blocks(F.col("spaced"), vocabulary, stride(templates), min(least)).alias("blocks")
    places = common.settle(phrase_places(texts.select("*", held), phrases), "license_blocks")
    matched = (
        template_matches(places.select("did", "text_key", F.inline("blocks")), templates, threshold)
        .groupBy("did", "text_key")
        .agg(F.collect_set("label").alias("matched"), F.max("containment").alias("best"))
    )
    none = F.array().cast("array<string>")
    return places.join(matched, ["did", "text_key"], "left").select(
        common.restore_id(),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("found", F.coalesce("matched", none))), ",").alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
