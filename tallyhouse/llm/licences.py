"""Licence notices found in whole texts, with Spark's own functions only.

Base labels: places where the words of a phrase stand consecutively. The method adds
an exact set-similarity join between text blocks and notice templates. A block of a
template of ``m`` words is a run of ``ceil(SPREAD * m)`` consecutive words (fewer at the
end of a text) that starts with a word of the template, wherever lines end; it holds the
template when at least ``CONTAINMENT`` of the template's distinct words are in it. Every
place where a block can start is looked at, so a notice is found however it is wrapped,
and words far apart in a long line hold nothing.

* Texts are read and cut into words once. What is stored of them is the words of the
  templates and phrases, each with its position, and the number of words.
* Words of a template are ordered by how often the corpus has them, rarest first; that
  order is counted over all documents.
* Prefix filter: of the ``n`` distinct words of a template ``need`` must be met, so a
  block has one of the first ``n - need + 1``. A block is looked at from the rarest word
  that it has, at that word's first place in it, and so exactly once.
* Length and positional filter: around that place there must be ``need`` distinct words
  of the template that are no rarer.
* What passes is verified: blocks that start up to the place, by intersection.

The inverted list of prefixes is a literal map, bounded by the templates (a parameter),
so every text finds its templates in the row where it stands: no shuffle but for the
word counts, and no group of texts is ever formed. A place looks at the stored words
less than a block's length away, so the work is linear in a text.

A null text is an empty one: no words, no places, no labels, score 0. Repeated rows are
answered each for itself, null ids too. A row's other columns are not read. A word that
a template has twice counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import materialize

CONTAINMENT = 0.9
#: Words of a block for each word of the template: room for words put between.
SPREAD = 1.25
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Common notices with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("all rights reserved", "proprietary"),
)


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def needed(template: str, containment: float = CONTAINMENT) -> int:
    """How many distinct words of a template a block must have."""
    return ceil(round(containment * len({*template.split()}), 9))


def width(template: str, spread: float = SPREAD) -> int:
    """How many words a block of a template has."""
    return ceil(round(spread * len(template.split()), 9))


def known_words(docs: DataFrame, vocabulary: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, and the words of the vocabulary with their places, in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _words(_lowered(F.col(text_col))).alias("words"))
    spots = F.transform("words", lambda w, i: F.when(w.isin(*vocabulary), F.struct(w.alias("w"), i.alias("i"))))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(spots).alias("hits"))


def word_order(known: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary, rarest in the corpus first; ties by the word."""
    counted = known.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # one row per word of the vocabulary
    n = {r.w: r.n for r in counted}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _phrase_places(parts: Sequence[str]) -> Column:
    """Where the words of a phrase stand one after another."""

    def here(x: Column, h: Column) -> Column:
        test = x["w"] == F.lit(parts[0])
        for j, part in enumerate(parts[1:], 1):
            behind = F.get(F.col("hits"), h + j)
            test = test & F.coalesce((behind["w"] == F.lit(part)) & (behind["i"] == x["i"] + j), F.lit(False))
        return test

    return F.array_compact(F.transform("hits", lambda x, h: F.when(here(x, h), x["i"].cast("long"))))


def _prefix_lists(order: Sequence[str], templates: Sequence[tuple[str, str]], containment: float, spread: float) -> dict[str, Column]:
    """For every word, the templates that have it in their prefix, as an array."""
    rank = {w: k for k, w in enumerate(order)}
    lists: dict[str, list[Column]] = {}
    for text, label in templates:
        words = sorted({*text.split()}, key=rank.__getitem__)
        need = needed(text, containment)
        for place, w in enumerate(words[: len(words) - need + 1]):
            entry = F.struct(
                F.lit(label).alias("label"), F.lit(need).alias("need"), F.lit(len(words)).alias("n"), F.lit(width(text, spread)).alias("width"),
                _strings(words[:place]).alias("rarer"), _strings(words[place:]).alias("tail"),
            )
            lists.setdefault(w, []).append(entry)
    return {w: F.array(*entries) for w, entries in lists.items()}


def _blocks(prefixes: dict[str, Column]) -> Column:
    """Every block that holds a template: label, first_word, score."""
    lists = F.create_map(*(x for w, entries in prefixes.items() for x in (F.lit(w), entries)))
    distinct = lambda hits: F.size(F.array_distinct(F.transform(hits, lambda y: y["w"])))

    def around(x: Column, h: Column, t: Column) -> Column:
        # places differ, so what is less than a width away is less than as many entries away
        first = F.greatest(h + 2 - t["width"], F.lit(1))
        return F.filter(F.slice(F.col("hits"), first, h + 1 + t["width"] - first), lambda y: F.abs(y["i"] - x["i"]) < t["width"])

    def verified(x: Column, t: Column, near: Column) -> Column:
        def held(start: Column) -> Column:
            run = F.filter(near, lambda y: (y["i"] >= start["i"]) & (y["i"] < start["i"] + t["width"]))
            sooner = F.exists(run, lambda y: F.array_contains(t["rarer"], y["w"]) | ((y["w"] == x["w"]) & (y["i"] < x["i"])))
            common = distinct(F.filter(run, lambda y: F.array_contains(t["tail"], y["w"])))
            block = F.struct(t["label"].alias("label"), start["i"].cast("long").alias("first_word"), (common / t["n"]).alias("score"))
            return F.when((common >= t["need"]) & ~sooner, block)

        starts = F.filter(near, lambda y: (y["i"] <= x["i"]) & F.array_contains(t["tail"], y["w"]))
        return F.array_compact(F.transform(starts, held))

    def of_place(x: Column, h: Column) -> Column:
        def of_template(t: Column) -> Column:
            near = around(x, h, t)
            enough = distinct(F.filter(near, lambda y: F.array_contains(t["tail"], y["w"]))) >= t["need"]
            return F.when(enough, verified(x, t, near))

        return F.flatten(F.array_compact(F.transform(F.try_element_at(lists, x["w"]), of_template)))

    found = F.transform("hits", lambda x, h: F.when(x["w"].isin(*prefixes), of_place(x, h)))
    return F.flatten(F.array_compact(found))


def licences(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
    containment: float = CONTAINMENT, spread: float = SPREAD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, at (places of phrases), base (their labels) and blocks (label,
    first_word and score of every block that holds a template) of every row."""
    texts = [text for text, _ in [*templates, *phrases]]
    vocabulary = sorted({w for text in texts for w in text.split()})
    known = materialize(docs.sparkSession, known_words(docs, vocabulary, id_col, text_col), "licence-words")
    prefixes = _prefix_lists(word_order(known, vocabulary), templates, containment, spread)
    rows = known.withColumns({f"p{k}": _phrase_places(p.split()) for k, (p, _) in enumerate(phrases)})
    return rows.select(
        "doc_id", "n_words", F.concat(*(F.col(f"p{k}") for k in range(len(phrases)))).alias("at"),
        F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)))).alias("base"),
        _blocks(prefixes).alias("blocks"),
    )


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    n_blocks of every row of ``licences``. The score is 1 with a base place, else the
    largest containment of a block, else 0."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "blocks.label")).alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.score"), F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
