"""License scans with Spark expressions only.

Every line of every whole text, and the whole text of a licence file, is compared with license templates by
the cosine of TF-IDF vectors over the words of the templates; document frequencies are counted over all
documents. Only lines with one of the weighty words of a template are compared: the other words of a
template together stay below the threshold, so no match is lost. A text in which no line is found is read again
as one run of words, whatever its line breaks: every window of as many words as a template has is compared with
that template, where the text has words enough of it. Licences that differ in one word are close to each other by
cosine, so a template only matches where the words of MARKS (Affero, ShareAlike, version numbers, 'not') are the same,
those next to a window and those that the line before ends with, if no sign follows them, included; of several matches the longest template counts, as the most particular. Files without a license of their own get
that of the nearest directory above them that holds a licence file, by joins of distinct directories.

Edge cases: null and empty texts and null paths have no license; words are ASCII letters and digits in
lower case; of templates of one length the higher cosine wins, then the later name; several licence files in a
directory: the highest cosine, then the later name; a very long text costs its words times those of each template
that it has words enough of; repeated rows are each reported; scan() keeps other columns but those named like its
results; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import set_aside
from .session import stored

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License"
_CC = "This work is licensed under the Creative Commons Attribution{} 4.0 International License."

#: License names and the wording that announces them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CC.format("-NonCommercial")),
    ("CC-BY-ND-4.0", _CC.format("-NoDerivatives")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CC.format("-ShareAlike")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CC.format("")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero ", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", _GNU.format("Lesser ", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser ", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Words by which licences differ. What is compared with a template must have the same of them.
MARKS = ("affero", "lesser", "library", "nc", "nd", "never", "no", "noderivatives", "noderivs", "noncommercial", "not", "sa", "sharealike", *"123456789")

#: Words before and after a window whose marks count with it; the last words of a line that the next one goes on from.
BEFORE, AFTER, UNFINISHED = 2, 1, r"((?:[A-Za-z0-9]+[^A-Za-z0-9]+)?[A-Za-z0-9]+)[ \t\r]*\z"

#: Cosine from which a line carries a license; share of its words that must be template words.
COSINE, SHARE = 0.8, 0.5

LICENCE_FILE = r"(^|/)(LICENSE|LICENCE|COPYING)(\.[A-Za-z]+)?$"

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_AZ, _az)))


VOCABULARY = sorted({w for _, t in TEMPLATES for w in words_of(t)})


def marks_of(text: str) -> list[str]:
    return sorted(set(words_of(text)) & set(MARKS))


def marks(e: Column) -> Column:
    """The different words of MARKS among words, in order."""
    return F.array_join(F.sort_array(F.array_intersect(e, F.array(*map(F.lit, MARKS)))), " ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(c, _AZ, _az), F.lit("([a-z0-9]+)"), F.lit(1))


def idf(docs: DataFrame) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) + 1 for each template word."""
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    hits = docs.select(F.explode(F.array_intersect(words(F.col("text")), vocabulary)).alias("w"))
    df = {r["w"]: r["n"] for r in hits.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most
    n = docs.count()
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}


def weighty(weight: dict[str, float]) -> list[str]:
    """Words of which each line with a cosine of COSINE or more has one."""
    out = set()
    for _, t in TEMPLATES:
        v = {w: k * weight[w] for w, k in Counter(words_of(t)).items()}
        norm, light = sum(x * x for x in v.values()), 0.0
        for w in sorted(v, key=lambda w: (v[w], w)):
            light += v[w] ** 2
            if light >= (COSINE - 1e-9) ** 2 * norm:
                out.add(w)
    return sorted(out)


def _lookup(d: dict[str, float]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*(F.lit(float(x)) for x in d.values())))


def _sum_of(keys: Column, values: Column) -> Column:
    return F.aggregate(keys, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(values, x), F.lit(0.0)))


def matched(files: DataFrame, weight: dict[str, float]) -> DataFrame:
    """files with the license of their own text and its cosine; null without one."""
    pattern = "(?i)(^|[^a-z0-9])(" + "|".join(weighty(weight)) + ")([^a-z0-9]|$)"
    none = F.expr("cast(array() as array<struct<u:string,before:string>>)")
    before = lambda ls, i: F.when(i > 0, F.regexp_extract(F.get(ls, i - 1), UNFINISHED, 1)).otherwise("")
    each_line = lambda ls: F.filter(F.transform(ls, lambda u, i: F.when(u.rlike(pattern), F.struct(u.alias("u"), before(ls, i).alias("before")))), lambda x: x.isNotNull())
    whole = F.when(F.col("path").rlike(LICENCE_FILE), F.array(F.struct(F.col("text").alias("u"), F.lit("").alias("before")))).otherwise(none)
    units = F.concat(F.element_at(F.transform(F.array(F.split("text", "\n")), each_line), 1), whole)
    known = _lookup(weight)

    def best(unit: Column) -> Column:
        every = words(unit["u"])

        return F.element_at(F.transform(F.array(every), lambda e: scored(e, F.concat(words(unit["before"]), e), TEMPLATES)), 1)

    def scored(e: Column, around: Column, templates) -> Column:
        def of(own: Column) -> Column:
            norm = F.sqrt(F.aggregate(F.array_distinct(own), F.lit(0.0), lambda a, t: a + F.pow(F.size(F.filter(own, lambda y: y == t)) * F.element_at(known, t), F.lit(2.0))))
            found = []
            for name, t in templates:
                v, length = vector(t)
                cosine = F.round(_sum_of(own, _lookup({w: x * weight[w] / length for w, x in v.items()})) / norm, 6)
                same = marks(around) == F.lit(" ".join(marks_of(t)))
                found.append(F.when(same & (cosine >= COSINE), F.struct(F.lit(len(words_of(t))).alias("n"), cosine.alias("cosine"), F.lit(name).alias("license"))))
            return F.when((F.size(own) > 0) & (F.size(own) >= SHARE * F.size(e)), F.array_max(F.array(*found)))

        return F.element_at(F.transform(F.array(F.filter(e, lambda x: F.array_contains(vocabulary, x))), of), 1)

    def vector(t: str) -> tuple[dict[str, float], float]:
        v = {w: k * weight[w] for w, k in Counter(words_of(t)).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def windows(e: Column, present: Column) -> Column:
        tops = []
        for name, t in TEMPLATES:
            v, length = vector(t)
            size = len(words_of(t))
            # without these words no window can reach the threshold
            enough = _sum_of(present, _lookup({w: x * x for w, x in v.items()})) >= (COSINE - 1e-6) ** 2 * length**2
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(e) - (size - 1)))
            near = lambda i: F.slice(e, F.greatest(i - BEFORE, F.lit(1)), size + AFTER + i - F.greatest(i - BEFORE, F.lit(1)))  # noqa: B023, E731
            each = F.transform(starts, lambda i: F.element_at(F.transform(F.array(F.slice(e, i, size)), lambda u: scored(u, near(i), [(name, t)])), 1))  # noqa: B023
            tops.append(F.when(enough, F.array_max(each)))
        return F.array_max(F.array(*tops))

    vocabulary = F.array(*map(F.lit, VOCABULARY))

    found = F.array_max(F.transform(F.coalesce(units, none), best))
    out = files.withColumn("__found", F.when(F.col("text").rlike(pattern), found))
    run = F.element_at(F.transform(F.array(words(F.col("text"))), lambda e: F.element_at(F.transform(F.array(F.array_intersect(e, vocabulary)), lambda p: windows(e, p)), 1)), 1)
    out = out.withColumn("__found", F.coalesce("__found", F.when(F.col("text").rlike(pattern), run)))
    return out.withColumn("own_license", F.col("__found.license")).withColumn("cosine", F.col("__found.cosine")).drop("__found", "text")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(found: DataFrame) -> DataFrame:
    """found with license and licence_dir: a file's own, or that of the nearest directory above it."""
    at = found.withColumn("__dir", _directory(F.col("path")))
    holders = (
        at.where(F.col("path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull())
        .groupBy(F.col("__dir").alias("__above"))
        .agg(F.max(F.struct("cosine", "own_license")).alias("__best"))
        .select("__above", F.col("__best.own_license").alias("__license"))
    )
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    directories = at.where("own_license is null and path is not null").select("__dir").distinct()
    nearest = (
        directories.select("__dir", F.explode(F.array_distinct(above)).alias("__above"))
        .join(holders, "__above")
        .groupBy("__dir")
        .agg(F.max(F.struct(F.length("__above").alias("n"), "__above", "__license")).alias("__near"))
    )
    out = at.join(nearest, "__dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        *found.columns,
        F.coalesce("own_license", "__near.__license").alias("license"),
        F.when(own, "own").when(F.col("__near").isNotNull(), "directory").otherwise("none").alias("basis"),
        F.when(~own, F.col("__near.__above")).alias("licence_dir"),
    )


def scan(files: DataFrame) -> DataFrame:
    """License of each row of files, which has path and text; other columns but text stay, those named like a result are replaced.

    Texts are scored once: what they give is written before the joins read it as holders, directories and result."""
    results = ("own_license", "cosine", "license", "basis", "licence_dir")
    files = files.select(*(c for c in files.columns if c.lower() not in results))
    own, moved = set_aside(files, ("__found", "__dir", "__above", "__near", "__best", "__license"))
    return inherited(stored(matched(own, idf(own)))).withColumnsRenamed(moved)


#: The documents table has no paths: each hundred documents of a source and language share a directory, whose first one is its licence file; the first of ten thousand is the source's.
PATH_SQL = "concat(source, '/', CASE WHEN doc_id % 10000 = 0 THEN 'LICENSE' ELSE concat(lang, '/', CAST(doc_id // 100 AS VARCHAR), '/', CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE concat(CAST(doc_id AS VARCHAR), '.txt') END) END)"


def report(docs: DataFrame) -> DataFrame:
    """One row per document of a table with doc_id, source, lang and text."""
    i = F.col("doc_id").cast("long")
    name = F.when(i % 100 == 0, "LICENSE").otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.concat("source", F.lit("/"), F.when(i % 10000 == 0, "LICENSE").otherwise(F.concat("lang", F.lit("/"), F.floor(i / 100).cast("string"), F.lit("/"), name)))
    return scan(docs.select(i.alias("doc_id"), path.alias("path"), "text")).select("doc_id", "path", "own_license", "cosine", "license", "basis", "licence_dir")
