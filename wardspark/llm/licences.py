"""Licence scans: Dice coefficient of word bigrams against licence templates.

Units of a document are its lines, the whole text where it has several, and its windows of as many
words as the template (those that jut out at an end too), so one-line notices, full texts, and
either of them wrapped over lines or inside a longer text are found. A unit is normalised to lower-case
letters and digits. Dice of two sets A and B of bigrams is 2|A & B| / (|A| + |B|).

It can reach ``least`` only if the unit, and so its document, holds at least
least / (2 - least) of the template's bigrams. An equi-join of the documents' bigrams counts these
first; lines, whole texts and windows are made only of documents and templates left. Windows
aren't scored one by one: a place whose bigram came last at place ``p`` adds a distinct bigram
to the windows that begin after ``p``, so running sums over the first places give all scores in
linear time, and only blocks near enough shared bigrams are looked at.

A null or empty text, or one without a similar unit, has no licence (nulls and score 0).
Ties go to a line or whole text before a window, then to the first template by name, then the first
unit. Templates with fewer than two words and repeated rows with one id are harmless: rows are found
again by id and text.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark.llm.common import KEY, row_key, small, whole_row, written

LEAST = 0.8
WHOLE, WINDOW = -1, -2

# Public licence notices, and the full texts and headers of the folder.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-2-Clause condition": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"),
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 line": "Released into the public domain under CC0 1.0.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."),
    "LGPL-3.0 line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "MPL-2.0 line": ("This Source Code Form is subject to the terms of the Mozilla Public "
                     "License, v. 2.0."),
    "Unlicense line": "This is free and unencumbered software released into the public domain.",
    **{file.stem: file.read_text(encoding="utf-8")
       for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))},
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    rows = list((TEMPLATES if templates is None else templates).items())
    return spark.createDataFrame(rows, "template string, text string")


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def pairs(words: Column) -> Column:
    """Neighbouring pairs in order; none for fewer than two words."""
    found = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                       lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.filter(found, lambda x: x.isNotNull())


def bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs."""
    return F.array_distinct(pairs(words))


def known_bigrams(templates: DataFrame) -> DataFrame:
    """``template, n_t, places, bigram``: ``places`` counts the pairs, ``n_t`` the distinct ones."""
    words = normal_words(F.col("text"))
    return written(templates.select("template", bigrams(words).alias("b"),
                                    (F.size(words) - 1).alias("places"))
                   .filter(F.size("b") > 0)
                   .select("template", F.size("b").alias("n_t"), "places",
                           F.explode("b").alias("bigram")), "templates")


def _need(least: float) -> Column:
    """Bigrams of a template that a unit has to share."""
    return F.greatest(F.ceil(F.col("n_t") * least / (2 - least) - 1e-6), F.lit(1)).cast("int")


def likely(docs: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """``k1, k2, template``: documents (``k1, k2, text``) that hold enough of the template's bigrams."""
    owners = known.groupBy("bigram").agg(
        F.collect_list(F.struct("template", _need(least).alias("need"))).alias("owners"))
    met = (docs.select(*KEY, F.explode(bigrams(normal_words(F.col("text")))).alias("bigram"))
           .join(small(written(owners, "owners")), "bigram").select(*KEY, F.inline("owners")))
    return (met.groupBy(*KEY, "template", "need").count().filter("count >= need")
            .select(*KEY, "template"))


def whole_units(docs: DataFrame, known: DataFrame, found: DataFrame,
                least: float = LEAST) -> DataFrame:
    """``k1, k2, unit, template, score``: lines and whole texts (``WHOLE``) with ``least`` or more."""
    reach = (2 - least) / least
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    whole = F.array(F.struct(F.lit(WHOLE).alias("unit"), F.col("text").alias("part")))
    parts = F.transform(lines, lambda x, i: F.struct(i.alias("unit"), x.alias("part")))
    units = docs.select(*KEY, F.explode(
        F.when(F.size(lines) > 1, F.concat(whole, parts)).otherwise(parts)).alias("u"))
    sized = units.select(*KEY, "u.unit", bigrams(normal_words(F.col("u.part"))).alias("b"))
    met = (sized.select(*KEY, "unit", F.size("b").alias("n_u"), F.explode("b").alias("bigram"))
           .join(small(known), "bigram")
           .filter((F.col("n_u") <= F.col("n_t") * reach) & (F.col("n_t") <= F.col("n_u") * reach))
           .join(small(found), [*KEY, "template"], "left_semi"))
    shared = met.groupBy(*KEY, "unit", "n_u", "template", "n_t").count()
    score = 2 * F.col("count") / (F.col("n_u") + F.col("n_t"))
    return (shared.select(*KEY, "unit", "template", score.alias("score"))
            .filter(F.col("score") >= least))


def windows(docs: DataFrame, known: DataFrame, found: DataFrame, least: float = LEAST) -> DataFrame:
    """``k1, k2, unit, template, score``: the score of the best window (``WINDOW``), if ``least``
    or more."""
    texts = docs.select(*KEY, pairs(normal_words(F.col("text"))).alias("p"))
    hits = (texts.select(*KEY, F.posexplode("p").alias("pos", "bigram"))
            .join(small(known), "bigram")
            .join(small(found), [*KEY, "template"], "left_semi")
            .groupBy(*KEY, "template", "n_t", "places")
            .agg(F.array_sort(F.collect_list("pos")).alias("h"), _need(least).alias("need")))
    # a place is near if as many shared ones as needed, from it on, fit a window
    near = F.filter(F.transform("h", lambda x, i: F.when(
        F.get("h", i + F.col("need") - 1) - x < F.col("places"), F.floor(x / F.col("places")))),
        lambda x: x.isNotNull())
    blocks = F.array_distinct(F.flatten(F.transform(
        F.array_distinct(near), lambda x: F.array(x - 1, x, x + 1))))
    areas = (hits.select(*KEY, "template", "n_t", "places",
                         F.filter(blocks, lambda x: x >= 0).alias("blocks"))
             .filter(F.size("blocks") > 0).join(texts, KEY))
    begin = F.col("places")
    inside = F.flatten(F.transform("blocks", lambda b: F.transform(
        F.slice("p", (b * begin + 1).cast("int"), begin),
        lambda x, i: F.struct((b * begin + i).alias("pos"), x.alias("bigram")))))
    each = Window.partitionBy(*KEY, "template", "bigram").orderBy("pos")
    first = F.col("pos") - F.col("places") + 1
    marked = (areas.select(*KEY, "template", "n_t", "places", F.inline(inside))
              .join(small(known.select("template", "bigram", F.lit(1).alias("own"))),
                    ["template", "bigram"], "left")
              .withColumn("first", F.greatest(first, F.lag("pos").over(each) + 1))
              .withColumn("own", F.coalesce("own", F.lit(0))))
    steps = marked.select(*KEY, "template", "n_t", F.inline(F.array(
        F.struct(F.col("first").alias("at"), F.lit(1).alias("all"), F.col("own")),
        F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("all"), (-F.col("own")).alias("own")))))
    summed = steps.groupBy(*KEY, "template", "n_t", "at").agg(
        F.sum("all").alias("all"), F.sum("own").alias("own"))
    # no more rows than a document has places
    until = (Window.partitionBy(*KEY, "template").orderBy("at")
             .rowsBetween(Window.unboundedPreceding, 0))
    score = 2 * F.sum("own").over(until) / (F.sum("all").over(until) + F.col("n_t"))
    return (summed.select(*KEY, "template", score.alias("score")).filter(F.col("score") >= least)
            .groupBy(*KEY, "template").agg(F.max("score").alias("score"))
            .select(*KEY, F.lit(WINDOW).alias("unit"), "template", "score"))


def candidates(docs: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """``k1, k2, unit, template, score``: units with a Dice coefficient of ``least`` or more. Unit
    -1 is the whole text, -2 the best window, the others are line numbers."""
    known = known_bigrams(templates)
    texts = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    found = written(likely(texts, known, least), "likely")
    kept = written(texts.join(small(found.select(*KEY).distinct()), KEY, "left_semi")
                   .dropDuplicates(KEY), "likely-texts")
    return whole_units(kept, known, found, least).unionByName(windows(kept, known, found, least))


def scan(docs: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """``_row, licence, unit, score, licences`` for each row of ``docs`` (``doc_id, text``, ...):
    the best match, and the sorted names of all templates found."""
    found = written(candidates(docs.select("doc_id", "text"), templates, least), "found")
    best = F.min(F.struct((-F.col("score")).alias("s"), (F.col("unit") == WINDOW).alias("inside"),
                          "template", "unit"))
    by_doc = found.groupBy(*KEY).agg(
        best.alias("best"), F.array_sort(F.collect_set("template")).alias("licences"))
    rows = docs.select(whole_row(docs).alias("_row"), *row_key(docs["doc_id"], docs["text"]))
    joined = rows.join(by_doc, KEY, "left")
    return joined.select("_row", F.col("best.template").alias("licence"),
                         F.col("best.unit").alias("unit"),
                         F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("score"),
                         F.coalesce("licences", F.array().cast("array<string>")).alias("licences"))
