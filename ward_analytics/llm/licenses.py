"""License scans by an exact set-similarity join. Native functions only.

Each paragraph of a text is a block, a set of words, so a notice that is wrapped over lines lies in one; each license notice is a template. A block
meets a template if it holds at least a given share of the template's words, and a share of its pairs of neighbouring words side by
side, which common words in any other order don't, and of the words that no other template has. Words are ordered by how many blocks hold them, rarest first, over the whole table, so a
block that meets a template holds one of the few rarest words of it (prefix filter), has enough words (length
filter), and enough words of the template from the one that was found on (positional filter). What is left is verified on the sets, then on the
text.

Templates are a small fixed table; blocks never meet one another. The base rules, phrases that stand in a text word by word, are native, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Share of a template's words that a block must hold.
CONTAINED_PERCENT = 75
#: Share of a template's pairs of neighbouring words that must be neighbours in the block.
ORDERED_PERCENT = 50
#: Share of the words that a template has and no other one, so that notices which differ by a name alone are told apart.
OWN_PERCENT = 50
#: What parts paragraphs.
BLANK_LINE = "\n[\x09\x0B\x0C\x0D\x20]*\n"

# Phrases with their labels, and notices as licenses word them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
    " as published by the free software foundation",
    "lgpl": "gnu lesser general public license as published by the free software foundation",
    "agpl": "gnu affero general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "mit-release": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced",
}


def lowered(text: Column) -> Column:
    """A-Z as a-z and nothing else; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _template_words() -> dict[str, list[str]]:
    return {label: sorted(set(text.split())) for label, text in TEMPLATES.items()}


def pairs_of(text: str) -> list[str]:
    """Neighbouring words of a template, each pair once, as they stand in a text whose words are set apart by blanks."""
    words = text.split()
    return sorted({f" {a} {b} " for a, b in zip(words, words[1:])})


def own_words(label: str) -> list[str]:
    """The words of a template that no other template has."""
    every = _template_words()
    return sorted(set(every[label]) - {w for other, words in every.items() if other != label for w in words})


def _blocks(keyed: DataFrame) -> DataFrame:
    """A row for each paragraph that holds words of templates: row key, its text, those words, and how many different words it has in all."""
    known = sorted({w for words in _template_words().values() for w in words})
    block = F.explode(F.split(F.col("low"), BLANK_LINE))
    blocks = keyed.select("doc_id", "name", block.alias("block")).withColumn("words", F.array_distinct(words_of(F.col("block"))))
    return blocks.select(
        "doc_id", "name", "block", F.size("words").alias("n"), F.array_intersect("words", F.array(*map(F.lit, known))).alias("words")
    ).where(F.size("words") > 0)


def prefix_size(n: int) -> int:
    """How many of a template's rarest words include one of any block that meets it."""
    return n - least_words(n) + 1


def least_words(n: int) -> int:
    return -(-CONTAINED_PERCENT * n // 100)


def _prefixes(spark: SparkSession, blocks: DataFrame) -> list[tuple[str, int, str, list[str], list[str], list[str]]]:
    """For each word of the prefix of each template: its place, the label, the template's words in order, by the blocks that hold them, its pairs and its
    own words."""
    held = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rows = []
    for label, words in _template_words().items():
        ordered = sorted(words, key=lambda w: (held.get(w, 0), w))
        rows += [(ordered[i], i, label, ordered, pairs_of(TEMPLATES[label]), own_words(label)) for i in range(prefix_size(len(ordered)))]
    return rows


def meetings(keyed: DataFrame) -> DataFrame:
    """doc_id, name, label and share: each template that a block of a text meets, with the largest share of its words in one block.

    keyed: doc_id, name (of the text) and low (the text in lower case).
    """
    spark = keyed.sparkSession
    blocks = _blocks(keyed)
    prefixes = _prefixes(spark, blocks)
    table = spark.createDataFrame(prefixes, "word string, place int, label string, template array<string>, pairs array<string>, own array<string>")
    first = F.lit(sorted({word for word, *_ in prefixes}))
    least = F.floor((F.size("template") * CONTAINED_PERCENT + 99) / 100)
    found = (
        blocks.withColumn("hits", F.array_intersect("words", first)).where(F.size("hits") > 0)
        .select("doc_id", "name", "block", "n", "words", F.explode("hits").alias("word"))
        .join(F.broadcast(table), "word")
        .where(F.col("n") >= least)  # length
        .where(F.size(F.array_intersect("words", F.expr("slice(template, place + 1, size(template))"))) + F.col("place") >= least)  # position
        .withColumn("held", F.size(F.array_intersect("words", "template"))).where(F.col("held") >= least)
        .where(100 * F.size(F.array_intersect("words", "own")) >= OWN_PERCENT * F.size("own"))
    )
    plain = F.concat(F.lit(" "), F.array_join(words_of(F.col("block")), " "), F.lit(" "))
    beside = F.size(F.filter("pairs", lambda p: F.contains(F.col("plain"), p)))
    ordered = found.withColumn("plain", plain).where(100 * beside >= ORDERED_PERCENT * F.size("pairs"))
    return ordered.groupBy("doc_id", "name", "label").agg(F.max(F.col("held") / F.size("template")).alias("share"))


def _starts(words: Column, phrase: str) -> Column:
    """Places, from 0, where the words of a phrase stand one after another."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        return reduce(lambda x, y: x & y, (F.get(words, i + k) == part for k, part in enumerate(parts)))

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of characters other than ASCII ones that are no letter or digit, A-Z read as a-z. n_base counts the places of all phrases,
    first_word and last_word are the smallest and largest place a phrase starts at, else null. labels adds the templates that a paragraph
    meets; paragraphs end at lines without any character but white space. The score is 1 with a phrase, else the largest share of a template that
    a paragraph which meets it holds, else 0.
    A null text is empty. Repeated rows get equal results, also if doc_id is null; other columns don't matter; an empty table gives an
    empty table.
    """
    base = documents.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("low"))
    base = base.withColumn("name", F.md5(F.col("low").cast("binary")))
    loose = "|".join("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+".join(p.split()) for p in PHRASES)
    words = F.when(F.col("low").rlike(loose), words_of(F.col("low"))).otherwise(F.array().cast("array<string>"))
    placed = base.withColumn("n_words", F.regexp_count("low", F.lit(WORD)).cast("long")).withColumn("words", words)
    starts = [_starts(F.col("words"), p) for p in PHRASES]
    placed = placed.select(
        "doc_id", "name", "n_words", F.concat(*starts).alias("starts"),
        F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, label in zip(starts, PHRASES.values(), strict=True)])).alias("base"),
    )
    met = meetings(base).groupBy("doc_id", "name").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    met = met.select(F.col("doc_id").alias("m_doc"), F.col("name").alias("m_name"), "more", "share")
    joined = placed.join(met, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("name") == F.col("m_name")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
