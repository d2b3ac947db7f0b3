"""License scan: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame functions only.

A template of L shingles (SHINGLE words each) belongs to the class of the next width c >= L of a fixed ladder. A text's
shingles are read in windows of 2c every c shingles, so wherever a template stands, one window holds it whole. Windows
without any shingle of their class's templates cannot match and are left out. A window and a template that contains at
least `least` of its shingles there have a Jaccard similarity of J = least * L / (2c + (1 - least) * L) or more; the number
of one-row bands is chosen so that (1 - J) ^ bands <= MISS for every template. Windows that share a band with a template
are its candidates; the containment of the template in the window is then counted exactly.

Words are runs of a-z and 0-9 of the lower-cased text. Defined cases: null and short texts match nothing; rows that repeat
an id are reported as one document, null ids as one as well; extra columns are not read; texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.llm.common import whole_text

SHINGLE = 3
LEAST = 0.8
MISS = 1e-6
# Notices by which licenses are told.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _shingle(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])


def _shingles(words: Column) -> Column:
    """The different shingle hashes of an array of words."""
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(at, lambda i: _shingle(words, i))))


def width_class(length: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, 16, 24, ... that is not below the length."""
    power = 1 << max(0, length - 1).bit_length()
    return power * 3 // 4 if power >= 4 and power * 3 // 4 >= length else power


def bands_needed(length: int, width: int, least: float) -> int:
    similar = least * length / (2 * width + (1 - least) * length)
    return math.ceil(math.log(MISS) / math.log(1 - similar))


def _minima(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))


def _once(frame: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column that is computed once per row. As a plain projection it would be copied into the filters and lambdas
    above it, there to be computed for every element; nothing is copied through a generator."""
    return frame.select("*", F.explode(F.array(column)).alias(name))


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, shingles."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()]))
    return spark.range(1).select(rows.alias("t")).select("t.license", _shingles(words_of(F.col("t.text"))).alias("shingles"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment, matched (shingles), window_start (in shingles): the best window of each template found."""
    spark = docs.sparkSession
    known = [(r["license"], r["shingles"]) for r in _templates(spark, templates).collect()]  # as many as there are templates
    if any(not s for _, s in known):
        raise ValueError(f"a template needs {SHINGLE} words or more")
    classes: dict[int, set[int]] = {}
    for _, shingles in known:
        classes.setdefault(width_class(len(shingles)), set()).update(shingles)
    bands = max(bands_needed(len(s), width_class(len(s)), least) for _, s in known)
    everything = sorted(set().union(*classes.values()))

    w = F.col("words")
    at = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    split = _once(docs.select("doc_id", whole_text("text").alias("_text")), "words", words_of(F.col("_text"))).drop("_text")
    hits = _once(split, "hits", F.when(F.size("words") >= SHINGLE, F.filter(at, lambda i: _shingle(w, i).isin(everything))))

    def windows(width: int, own: set[int]) -> Column:
        kept = F.filter("hits", lambda i: _shingle(w, i).isin(sorted(own)))
        numbers = F.array_distinct(F.flatten(F.transform(kept, lambda i: F.array(F.floor(i / width) - 1, F.floor(i / width)))))
        return F.transform(F.filter(numbers, lambda j: j >= 0), lambda j: F.struct(
            F.lit(width).alias("width"), (j * width).alias("start"),
            F.slice(w, (j * width + 1).cast("int"), F.lit(2 * width + SHINGLE - 1)).alias("words")))

    cut = hits.select("doc_id", F.explode(F.concat(*[windows(c, own) for c, own in sorted(classes.items())])).alias("w"))
    signed = _once(cut, "shingles", _shingles(F.col("w.words"))).select("doc_id", "w.width", "w.start", "shingles")
    banded = signed.select("*", F.posexplode(_minima(F.col("shingles"), bands)).alias("band", "least"))
    # The templates are a parameter of a few rows; so are their bands.
    wanted = _templates(spark, templates).select(
        "license", F.col("shingles").alias("whole"), F.element_at(F.create_map(*[
            F.lit(x) for k, s in known for x in (k, width_class(len(s)))]), F.col("license")).alias("width"),
        F.posexplode(_minima(F.col("shingles"), bands)).alias("band", "least"))
    candidates = banded.join(F.broadcast(wanted), ["width", "band", "least"])
    far = 1 << 40
    matched = F.size(F.array_intersect("shingles", "whole")).cast("long")
    checked = candidates.select("doc_id", "license", matched.alias("n"), F.size("whole").alias("size"), "start").filter(F.col("n") >= least * F.col("size"))
    best = checked.groupBy("doc_id", "license", "size").agg(F.max(F.col("n") * far + (far - 1 - F.col("start"))).alias("best"))
    n = F.floor(F.col("best") / far)
    return best.select("doc_id", "license", (n / F.col("size")).alias("containment"), n.alias("matched"),
                       (far - 1 - F.pmod(F.col("best"), F.lit(far))).alias("window_start"))


def scan_sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same by counting every template's shingles in every window."""
    rows = []
    for name, text in templates.items():
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        shingles = list(dict.fromkeys(" ".join(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))
        rows.append(f"('{name}', {width_class(len(shingles))}, {shingles})")
    return f"""
WITH t(license, c, whole) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS words FROM documents),
p AS (SELECT doc_id, r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w),
s AS (SELECT doc_id, r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS sh FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
u AS (SELECT license, c, len(whole) AS size, unnest(whole) AS sh FROM t),
h AS (SELECT doc_id, r, license, c, size, sh, unnest([i // c, i // c - 1]) AS j FROM s JOIN u USING (sh)),
m AS (SELECT doc_id, license, size, j * c AS start, count(DISTINCT sh) AS n FROM h WHERE j >= 0 GROUP BY doc_id, r, license, c, size, j)
SELECT doc_id, license, max(n)::DOUBLE / any_value(size) AS containment, max(n)::BIGINT AS matched,
  arg_max(start, n * 1099511627776 - start)::BIGINT AS window_start
FROM m WHERE n >= {least} * size GROUP BY doc_id, license
"""
