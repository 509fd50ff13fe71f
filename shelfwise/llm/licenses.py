"""License scans: MinHash bands over overlapping windows, exact containment after.

Everything is DataFrame expressions. A template is a set of five-word shingles (all its
words as one, if it has fewer). Templates of about one length share windows of that
length, laid every eighth of it, so that a window over a copy of the template is nearly
the copy. Each window has ``BANDS`` MinHash values, each a band of one row; equal bands
retrieve templates. A window whose Jaccard similarity with a template is j meets it with
probability 1 - (1 - j) ** 12: over 0.9998 at 0.5, which holds for all copies that keep
80 % of the shingles. Retrieved templates are then verified: at least 80 % of their
shingles must lie in the window or one step beside it.

Windows are only laid over words of a small set such that no text can hold 80 % of a
template's shingles without one of them; this loses nothing and spares most texts.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
BANDS = 12
PERCENT = 80
STEPS_PER_WINDOW = 8

# Notices and sentences of public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
        " compliance with the License. You may obtain a copy of the License at"
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met"
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions"
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at"
    ),
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def shape(n_words: int) -> tuple[int, int, int]:
    """(words of a shingle, shingles of a window, step) for a template of so many words."""
    size = min(SHINGLE_WORDS, n_words)
    shingles, window = n_words - size + 1, 1
    while window < shingles:
        window = max(window + 1, window * 19 // 16)
    return size, window, max(1, window // STEPS_PER_WINDOW)


def gate_words(templates: dict[str, str]) -> list[str]:
    """Words of which every text with 80 % of a template's shingles holds at least one.

    For each template, longest words first, until the shingles without any of them are
    fewer than 80 %.
    """
    chosen: set[str] = set()
    uses = Counter(w for text in templates.values() for w in set(plain_words(text)))
    for text in templates.values():
        words = plain_words(text)
        size = min(SHINGLE_WORDS, len(words))
        shingles = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        order = sorted(set(words), key=lambda w: (w not in chosen, -len(w), -uses[w], w))
        for word in order:
            left = [s for s in shingles if not chosen & set(s)]
            if 100 * len(left) < PERCENT * len(shingles):
                break
            chosen.add(word)
    return sorted(chosen)


def _words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))


def _shingles(words: Column, size: Column, low: Column, high: Column) -> Column:
    """Hashes of the shingles at word positions low to high, as far as there are any."""
    last = F.least(high, F.size(words) - size)
    made = F.transform(
        F.sequence(low, F.greatest(low, last)),
        lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")),
    )
    return F.when(last >= low, made).otherwise(F.array().cast("array<long>"))


def _bands(shape_id: Column, shingles: Column) -> Column:
    """The band keys of a set of shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.xxhash64(shape_id, band, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band)))),
    )


def template_keys(spark: SparkSession, templates: dict[str, str], shapes: list[tuple[int, int, int]]) -> DataFrame:
    """(key, license, wanted): a row for each template and band; the template list bounds it."""
    rows = [
        (name, plain_words(text), shapes.index(shape(len(plain_words(text)))))
        for name, text in templates.items()
        if plain_words(text)
    ]
    frame = spark.createDataFrame(rows, "license string, words array<string>, shape int")
    size = F.least(F.lit(SHINGLE_WORDS), F.size("words"))
    wanted = F.array_distinct(_shingles(F.col("words"), size, F.lit(0), F.size("words")))
    return frame.select("license", "shape", wanted.alias("wanted")).select(
        F.explode(_bands(F.col("shape"), F.col("wanted"))).alias("key"), "license", "wanted"
    )


def licenses(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_licenses, licenses): the templates each document holds, sorted, comma-joined.

    Words are runs of ASCII letters and digits, A-Z lower-cased. A template is held if at
    least 80 % of its shingles lie together in one stretch of about its length.

    Null, empty and unmatched texts have no license and an empty list. Rows repeated with
    the same id and text give one row; null ids are an id like others. Other columns play
    no part; an empty table gives no rows, an empty template list no match.
    """
    templates = TEMPLATES if templates is None else templates
    spark = documents.sparkSession
    shapes = sorted({shape(len(plain_words(t))) for t in templates.values() if plain_words(t)})
    gate = gate_words(templates)
    lowered = F.lower(F.col("text").cast("string"))
    passes = F.lit(False)
    for word in gate:
        passes = passes | F.contains(lowered, F.lit(word))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.when(F.coalesce(passes, F.lit(False)), _words("text")).alias("words"),
    )
    gates = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.array(*map(F.lit, gate)), F.get("words", i))
    )
    rows = rows.withColumn("gates", F.when(F.size("words") > 0, gates)) if gate else rows.withColumn("gates", F.lit(None).cast("array<int>"))

    def windows(number: int, size: int, window: int, step: int) -> Column:
        reach = window + size - 1

        def around(p: Column) -> Column:
            first = F.greatest(F.lit(0), F.ceil((p - reach + 1) / step).cast("int") * step)
            return F.sequence(first, F.floor(p / step).cast("int") * step, F.lit(step))

        starts = F.array_distinct(F.flatten(F.transform("gates", around)))
        return F.transform(
            starts,
            lambda s: F.struct(
                F.lit(number).alias("shape"),
                F.lit(size).alias("size"),
                F.lit(window).alias("window"),
                F.greatest(F.lit(0), s - step).alias("low"),
                s.alias("start"),
                (s + window - 1 + step).alias("high"),
            ),
        )

    made = [windows(k, *one) for k, one in enumerate(shapes)]
    every = F.concat(*made) if made else F.lit(None).cast(
        "array<struct<shape:int,size:int,window:int,low:int,start:int,high:int>>"
    )
    windowed = rows.select("doc_id", "text_hash", "words", F.explode_outer(every).alias("w")).select(
        "doc_id",
        "text_hash",
        "w",
        F.when(F.col("w").isNotNull(), _shingles(F.col("words"), F.col("w.size"), F.col("w.low"), F.col("w.high"))).alias("near"),
    )
    core = F.slice("near", F.col("w.start") - F.col("w.low") + 1, F.col("w.window"))
    keyed = windowed.select(
        "doc_id",
        "text_hash",
        "near",
        F.explode_outer(F.when(F.size(core) > 0, _bands(F.col("w.shape"), core))).alias("key"),
    )
    found = keyed.join(F.broadcast(template_keys(spark, templates, shapes)), "key", "left")
    held = F.size(F.array_intersect("near", "wanted")) * 100 >= F.size("wanted") * PERCENT
    return (
        found.groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.when(held, F.col("license")))).alias("held"))
        .select(
            "doc_id",
            F.size("held").cast("long").alias("n_licenses"),
            F.array_join("held", ",").alias("licenses"),
        )
    )
