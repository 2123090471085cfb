"""License scan as an exact set-similarity join, in DataFrame functions only.

Method
    Templates - license notices - and text blocks are sets of words. A block matches a template
    if it holds at least ``THRESHOLD`` of the template's words. All words of templates are counted
    over the whole corpus, and every set is sorted by that count, rarest word first. A block that
    reaches the overlap o with a template of m words shares a word of the template's first
    m - o + 1 with the block's own first n - o + 1 (prefix filter), has n >= o (length filter),
    and at the first shared word enough words are left on both sides (positional filter). What
    passes is verified in its blocks. Words of no template cannot be shared, so texts are reduced to
    template words first, and the join is made once for a text: what a block holds, its text holds.
    Blocks of a template are the lines of a text, of any length, and every run of ``SPREAD`` times as
    many words as the notice has, over any line breaks.

Defined results: a null text is an empty one; a null id is carried along; every row is judged on
its own, so repeated rows give repeated results; ties between templates give all their labels; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, materialise, read_table, texts_of

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Words of a run, as a multiple of the notice's own: as many words may stand between them.
SPREAD = 2

#: Phrases of the contract: label and words.
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

#: Notices by which works state their license, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License You may obtain a copy of the License at apache org licenses"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved no part of this publication may be reproduced"),
)

# Word characters are 0-9, letters and all of U+0080 and above.
_OTHER = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
_WORD = f"[^{_OTHER}]"
_GAP = f"[{_OTHER}]+"


def words_of(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _alternatives(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings, so that matching it is cheap."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    return "|".join(head + ("" if rest == [""] else f"(?:{_alternatives(rest)})") for head, rest in heads.items())


def _phrase_pattern() -> str:
    each = "|".join(_GAP.join(words) for words in PHRASES.values())
    return f"(?<!{_WORD})(?i:{each})(?!{_WORD})"


def _n_words(text: Column) -> Column:
    """Number of words: pieces between gaps, without the empty ones that an end may have."""
    return F.size(F.array_remove(F.split(text, _GAP), "")).cast("long")


def _token_counts(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs in all texts. One row a template word comes back."""
    words = texts.select(F.explode(F.split("text", _GAP)).alias("word")).where(F.lower("word").isin(vocabulary))
    counted = words.select(ascii_lower(F.col("word")).alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def _base(text: Column, found: Column, n_words: Column) -> dict[str, Column]:
    """Places of the phrases, by marking them and counting the words between the marks."""
    clean = F.translate(text, "\x01", "\x03")
    parts = F.split(F.regexp_replace(clean, _phrase_pattern(), "\x01$0\x01"), "\x01")
    places = F.filter(parts, lambda p, i: i % 2 == 1)
    first_letter = F.map_from_arrays(F.array(*(F.lit(w[0][0]) for w in PHRASES.values())), F.array(*map(F.lit, PHRASES)))
    labels = F.array_sort(F.array_distinct(F.transform(places, lambda p: F.element_at(first_letter, F.lower(F.substring(p, 1, 1))))))
    return {
        "n_base": F.when(found, F.size(places).cast("long")).otherwise(F.lit(0).cast("long")),
        "first_word": F.when(found, _n_words(F.element_at(parts, 1))),
        "last_word": F.when(found, n_words - _n_words(F.element_at(parts, -1)) - _n_words(F.element_at(places, -1))),
        "base": F.when(found, labels).otherwise(F.array().cast("array<string>")),
    }


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, number of words, the phrases' places and labels, all labels, and the best containment
    (1 where a phrase of the contract stands)."""
    texts = texts_of(df, id_col, text_col)
    sets = [(label, set(words_of(text))) for label, text in templates]
    runs = [int(SPREAD * len(words_of(text))) for _, text in templates]
    vocabulary = sorted(set().union(*(words for _, words in sets)))
    counts = _token_counts(texts, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    # The templates are part of this module or a parameter: a few rows.
    ordered = []
    for k, (label, words) in enumerate(sets):
        tokens = sorted(rank[w] for w in words)
        need = math.ceil(round(threshold * len(tokens), 9))
        ordered += [(label, tokens, need, runs[k], i, tokens[i]) for i in range(len(tokens) - need + 1)]
    spark = df.sparkSession
    prefixes = F.broadcast(spark.createDataFrame(ordered, "label string, tokens array<int>, need int, run int, i int, token int"))
    by_rank = sorted(rank, key=rank.get)
    rare = [by_rank[token] for *_, token in ordered]
    least = min(need for _, _, need, *_ in ordered)

    # Plain searches in the lower-cased text tell which texts need the exact patterns at all.
    text, low, has_phrase = F.col("text"), F.col("low"), F.col("has_phrase")
    maybe_phrase = reduce(or_, (reduce(and_, (F.contains(low, F.lit(w)) for w in words)) for words in PHRASES.values()))
    looked = texts.select("doc_id", "text", F.lower("text").alias("low")).select(
        "doc_id", "text", _n_words(text).alias("n_words"), (maybe_phrase & text.rlike(_phrase_pattern())).alias("has_phrase"),
        (low.rlike(_alternatives(rare)) & text.rlike(f"(?<!{_WORD})(?i:{_alternatives(rare)})(?!{_WORD})")).alias("has_rare"))
    facts = materialise(looked.select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), "n_words",
        *(c.alias(name) for name, c in _base(text, has_phrase, F.col("n_words")).items()),
        F.when(F.col("has_rare"), _places(text, rank)).alias("places"),
    ), "licenses")

    # What a text holds of the templates at all, rarest first; each template is met at the first word shared.
    words = F.array_sort(F.array_distinct(F.col("places.rank")))
    reduced = facts.where(F.size("places") >= least).select("row_id", "places", words.alias("words"))
    tokens = reduced.select("row_id", "places", "words", F.size("words").alias("n"), F.posexplode("words").alias("j", "token"))
    left = F.least(F.size("tokens") - 1 - F.col("i"), F.col("n") - 1 - F.col("j"))
    candidates = tokens.join(prefixes, "token").where(
        (F.col("n") >= F.col("need")) & (F.col("j") <= F.col("n") - F.col("need")) & (left + 1 >= F.col("need")))
    shared = F.array_intersect("words", "tokens")
    candidates = candidates.where((F.size(shared) >= F.col("need")) & (F.element_at(shared, 1) == F.col("token")))
    own = F.filter("places", lambda p: F.array_contains("tokens", p["rank"]))
    overlaps = candidates.select("row_id", "label", "tokens", "need", "run", own.alias("own")).withColumn("overlap", _overlap())
    matched = overlaps.where(F.col("overlap") >= F.col("need")).select("row_id", "label", (F.col("overlap") / F.size("tokens")).alias("held"))
    best = matched.groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max("held").alias("held"))

    has_base = F.col("n_base") > 0
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return facts.join(best, "row_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.when(has_base, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"))


def _places(text: Column, rank: dict[str, int]) -> Column:
    """The template words of a text in order: line, place among the text's words, and rank."""
    lines = F.split(ascii_lower(text), "\\r\\n|[\\r\\n]")
    ranks = F.create_map(*reduce(lambda out, item: [*out, F.lit(item[0]), F.lit(item[1])], rank.items(), []))
    line_words = F.transform(lines, lambda line, i: F.transform(
        F.array_remove(F.split(line, _GAP), ""), lambda w: F.struct(i.alias("line"), F.try_element_at(ranks, w).alias("rank"))))
    every = F.transform(F.flatten(line_words), lambda w, i: F.struct(w["line"].alias("line"), i.alias("at"), w["rank"].alias("rank")))
    return F.filter(every, lambda w: w["rank"].isNotNull())


def _overlap() -> Column:
    """Most distinct words of the template that one block holds; ``own`` are the places of its words."""
    # Bound as the variable of a transform, or the optimiser would put the filter that makes it in every step.
    return F.element_at(F.transform(F.array("own"), _most_held), 1)


def _most_held(own: Column) -> Column:
    n = F.size(own)
    distinct = lambda places: F.size(F.array_distinct(F.transform(places, lambda p: p["rank"])))
    # A run begins at a word of the template.
    runs = F.transform(own, lambda p, i: distinct(F.filter(F.slice(own, i + 1, F.col("run")), lambda q: q["at"] < p["at"] + F.col("run"))))
    # A line's places stand together; its first one is where the line changes.
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(own, i - 2)["line"] != F.get(own, i - 1)["line"], F.lit(True)))
    upto = lambda first, k: F.coalesce(F.try_element_at(first, k + 2), n + 1)
    line = lambda first, i, k: distinct(F.slice(own, i, F.greatest(upto(first, k) - i, F.lit(0))))
    lines = F.element_at(F.transform(F.array(starts), lambda first: F.transform(first, lambda i, k: line(first, i, k))), 1)
    return F.when(n > 0, F.array_max(F.concat(runs, lines))).otherwise(F.lit(0))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE_SQL: dict[str, str] = {}
