"""License scan: an exact set-similarity join of text blocks with license templates.

A template's blocks are all runs of a text's words that are as long as the template divided by `threshold`, wherever
lines end; a block matches if it holds at least `threshold` of the template's distinct words. So neither a block that is
too short (length filter) nor one that is too long for the template counts. Words are ordered by how many texts of the
corpus have them, rarest first. A block can only match if it has one of the template's prefix, its |T| - overlap + 1
rarest words (prefix filter), and if, counted from the place of the first of these that it has, the template has enough
words left (positional filter). Only the words around prefix words are looked at, against the templates whose prefix they
share; blocks that pass are compared in full. The templates are one constant array. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: License notices that the join looks for, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
}
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Words of a text, lower case, with one space before and behind each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words_before(text: Column) -> Column:
    """Words in the part of a normal text that ends before a phrase's leading space."""
    return F.greatest(_spaces(text), F.lit(0))


def word_counts(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many texts of the corpus (normal) have each word of the vocabulary; at most as many rows as that has come to the driver."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    rows = texts.select(F.explode(F.array_intersect(known, F.split("normal", " "))).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def template_array(ordered: list[tuple[str, list[str], int, int]]) -> Column:
    """Constant array of the templates: label, words (rarest first), prefix, least (words that a block must hold) and width (words in a block)."""
    texts = lambda words: F.array(*[F.lit(w) for w in words])
    return F.array(*[F.struct(F.lit(label).alias("label"), texts(words).alias("words"), texts(words[: len(words) - least + 1]).alias("prefix"), F.lit(least).alias("least"), F.lit(width).alias("width")) for label, words, least, width in ordered])


def matched(near: Column, templates: Column) -> Column:
    """Array of (label, share): of each template that a block among these words matches, the largest share that one holds."""

    def likely(t: Column) -> Column:
        first = F.array_position(F.transform(t["words"], lambda w: F.array_contains(near, w)), True)
        return (F.size(near) >= t["least"]) & F.arrays_overlap(t["prefix"], near) & (F.size(t["words"]) - first + 1 >= t["least"])

    def share(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(near) - t["width"] + 1))
        held = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(t["words"], F.slice(near, i, t["width"])))))
        return F.struct(t["label"].alias("label"), F.when(held >= t["least"], held / F.size(t["words"]).cast("double")).alias("share"))

    return F.filter(F.transform(F.filter(templates, likely), share), lambda x: x["share"].isNotNull())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Lower case is of A-Z only; words are runs of anything but ASCII other than letters and digits. n_base counts the
    places where a phrase's words stand consecutively; first_word and last_word are the smallest and largest of their
    starts, or null. labels adds those of templates that a block of their number of words divided by `threshold`, any run
    of the text's words, holds at least `threshold` of. score is 1 with a phrase, else the largest share that a matched
    block holds of its template, else 0. blocks: distinct (label, share) of the matches.
    Null and empty texts have no words. Ids are carried along, null or repeated; other columns are not looked at.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    sets = [(label, sorted(set(t.split())), math.floor(len(t.split()) / threshold + 1e-9)) for t, label in sorted(templates.items())]
    texts = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("normal"))
    counts = word_counts(texts, sorted({w for _, s, _ in sets for w in s}))
    ordered = [(label, sorted(s, key=lambda w: (counts[w], w)), math.ceil(threshold * len(s) - 1e-9), width) for label, s, width in sets]
    rare = sorted({w for _, s, least, _ in ordered for w in s[: len(s) - least + 1]})

    out = texts.withColumn("n_words", F.when(F.col("normal") == "  ", 0).otherwise(_spaces(F.col("normal")) - 1).cast("long"))
    n = sum((F.regexp_count("normal", F.lit(f" {p}(?= )")) for p in phrases), F.lit(0))
    firsts = [F.when(F.locate(f" {p} ", F.col("normal")) > 0, _words_before(F.expr(f"substring(normal, 1, locate(' {p} ', normal) - 1)"))) for p in phrases]
    lasts = [F.when(F.locate(f" {p} ", F.col("normal")) > 0, F.col("n_words") - _spaces(F.expr(f"substring_index(normal, ' {p} ', -1)")) - len(p.split())) for p in phrases]
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.locate(f" {p} ", F.col("normal")) > 0, F.lit(label)) for p, label in phrases.items()]), lambda x: x.isNotNull())))

    def some(columns: list[Column], pick: str) -> Column:
        return getattr(F, pick)(F.array(*columns)).cast("long")

    # Only texts that have a prefix word are split into words; what stands around each, as far as a block reaches, is looked at.
    reach = max(width for *_, width in ordered) - 1
    every = F.when(F.col("normal").rlike(f" (?:{'|'.join(rare)}) "), F.split(F.trim("normal"), " ")).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("all", every)
    places = F.filter(F.transform("all", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    near = F.transform(places, lambda i: F.slice("all", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1))
    constant = template_array(ordered)
    out = out.withColumn("blocks", F.array_distinct(F.flatten(F.transform(near, lambda w: matched(w, constant)))))
    out = out.withColumn("base", base).withColumn("n_base", n.cast("long"))
    every = F.array_sort(F.array_union("base", F.col("blocks.label")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("blocks.share")), F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", some(firsts, "array_min").alias("first_word"), some(lasts, "array_max").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "blocks")
