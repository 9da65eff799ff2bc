"""Licence scans with a trained paragraph classifier, in DataFrame functions and Spark ML only.

A paragraph is a run of lines up to one without words. It is looked at in windows: each line with the words that follow
it in its paragraph, as many as the longest template has, so a notice wrapped over lines stands whole in the window of the
line it starts on. A multinomial logistic regression over hashed word unigrams and bigrams is trained on the
templates below, alone and inside sampled windows, against a class of unknown windows from a bounded sample of the
corpus. The bar a family's probability must pass is calibrated on unknown windows kept from training. A
prediction counts once a template of that family is found in the window: a given share of the template's word bigrams
stands in it, and every bigram that holds a number or names a GNU licence, so that versions are told apart.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.texts import hash_share
from tastegrid.session import stage

UNKNOWN = "unknown"
# Public licence notices by family; a family's name comes first. "GPL" is the sentence that names no version.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL v2.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "GPL": [
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
}
# Bounds (on average; twice as many at most) of the sample of unknown paragraphs: rows of documents, and paragraphs.
SAMPLE_DOCS, SAMPLE = 2_000, 4_000
WIDTH = 1 << 14
TEMPLATE_SHARE = 0.75
# A window that holds this share of a template is no example of unknown text.
PARTLY = 0.5
# Bigrams that a confirmed template may not lack.
DECIDING = r"\d|\bgnu\b"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Each word with the next; a single word stands alone."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                                                F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                                lambda a, b: F.concat_ws(" ", a, b))).otherwise(words)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraphs(docs: DataFrame, longest: int) -> DataFrame:
    """(row, doc_id, paragraph, own, words): a window for every line that holds a word. ``paragraph`` numbers all lines from 0,
    ``own`` are the line's words, ``words`` those and up to ``longest`` - 1 following ones of the same paragraph."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    none = F.array().cast("array<string>")

    def after(t: Column) -> Column:
        gap = F.array_position(t, none).cast("int")
        return F.slice(F.flatten(F.when(gap > 0, F.slice(t, 1, gap - 1)).otherwise(t)), 1, longest - 1)

    def windows(w: Column) -> Column:
        return F.transform(w, lambda own, i: F.struct(own.alias("own"), F.when(
            F.size(own) > 0, _let(F.slice(w, i + 2, F.lit(longest - 1)), after)).otherwise(none).alias("after")))
    # Numbered before the lines are cut: beside the generator every line would get a number of its own.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = numbered.select("row", "doc_id", F.posexplode(_let(F.transform(lines, tokens), windows)).alias("paragraph", "u"))
    return cut.filter(F.size("u.own") > 0).select("row", "doc_id", "paragraph", F.col("u.own").alias("own"), F.concat("u.own", "u.after").alias("words"))


def _templates(spark) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("template")) for f, ts in TEMPLATES.items() for t in ts]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return one.select("family", "template", tokens(F.col("template")).alias("words"))


class Known:
    """The templates with their bigrams, as literals: some dozens of rows, the same for every corpus."""

    def __init__(self, spark):
        self.rows = _templates(spark).select("family", "template", F.size("words").alias("n"),
                                             F.array_distinct(bigrams(F.col("words"))).alias("grams")).collect()
        self.longest = max(r.n for r in self.rows)
        # Fewer bigrams of any template than this confirm none.
        self.fewest = min(math.ceil(TEMPLATE_SHARE * len(r.grams)) for r in self.rows)
        # Without any of these words too many bigrams of every template are missing.
        self.anchors = sorted({w for r in self.rows for w in self._anchors(r.grams)})

    @staticmethod
    def _anchors(grams) -> list[str]:
        """The longest words of a template, as many as leave less than the needed share of its bigrams without them."""
        found, left = [], list(grams)
        for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
            if len(left) < TEMPLATE_SHARE * len(grams):
                break
            found.append(word)
            left = [g for g in left if word not in g.split(" ")]
        return found

    @staticmethod
    def _words(values) -> Column:
        return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")

    def some(self, words: Column) -> Column:
        """Whether a window holds bigrams enough to confirm the shortest template; others cannot be confirmed."""
        every = self._words(sorted({g for r in self.rows for g in r.grams}))
        return F.arrays_overlap(words, self._words(self.anchors)) & (F.size(F.array_intersect(bigrams(words), every)) >= self.fewest)

    def partly(self, grams: Column) -> Column:
        """Whether a window holds a good part of some template."""
        shares = [F.size(F.array_intersect(self._words(r.grams), grams)) >= PARTLY * len(r.grams) for r in self.rows]
        return reduce(lambda a, b: a | b, shares)

    def best(self, grams: Column, probabilities: Column) -> Column:
        """The confirmed template of the most probable family: (probability, share, template, family), or null."""
        number = {f: k + 1 for k, f in enumerate(TEMPLATES)}
        all_ = F.array(*[F.struct(F.get(probabilities, F.lit(number[r.family])).alias("probability"), self.share(r, grams).alias("share"),
                                  F.lit(r.template).alias("template"), F.lit(r.family).alias("family")) for r in self.rows])
        return F.array_max(F.filter(all_, lambda t: t["share"] >= TEMPLATE_SHARE))

    def share(self, r, grams: Column) -> Column:
        """Share of a template's bigrams among ``grams``; 0 if one of those that decide is missing."""
        must = [g for g in r.grams if re.search(DECIDING, g)]
        found = F.size(F.array_intersect(self._words(r.grams), grams)) / len(r.grams)
        return F.when(F.size(F.array_except(self._words(must), grams)) == 0, found).otherwise(0.0) if must else found

    def own(self, grams: Column, template: Column) -> Column:
        """The share of the template named in ``template``."""
        return F.coalesce(*[F.when(template == r.template, self.share(r, grams)) for r in self.rows])


def _features():
    return [NGram(n=2, inputCol="words", outputCol="pairs"),
            HashingTF(numFeatures=WIDTH, binary=True, inputCol="grams", outputCol="features")]


def _with_features(rows: DataFrame) -> DataFrame:
    pairs, hashed = _features()
    return hashed.transform(pairs.transform(rows).withColumn("grams", F.concat("words", "pairs"))).drop("pairs", "grams")


def train(docs: DataFrame, templates: Known):
    """(model, bar): the fitted classifier and the probability that a family must pass."""
    spark = docs.sparkSession
    order = F.xxhash64("words", F.lit(7))
    pick = hash_share(docs.select("doc_id", "text"), F.xxhash64("doc_id", "text"), SAMPLE_DOCS, docs.count())
    found = stage(paragraphs(pick, templates.longest).select("words").dropDuplicates(["words"]), "paragraphs")
    sample = hash_share(found, order, SAMPLE, found.count()).withColumns({"o": F.pmod(order, F.lit(4)), "_grams": bigrams(F.col("words"))})
    sample = stage(sample.filter(~templates.partly(F.col("_grams"))).drop("_grams"), "unknown")
    known = _templates(spark)
    label = {f: float(k + 1) for k, f in enumerate(TEMPLATES)}
    number = F.coalesce(*[F.when(F.col("family") == f, n) for f, n in label.items()])
    # Templates inside other paragraphs: each with the sampled paragraphs whose hash picks it.
    count = known.count()
    numbered = known.withColumn("t", F.pmod(F.xxhash64("template"), F.lit(1 << 30))).select("family", "words", "t")
    spread = sample.filter("o <> 0").select(F.col("words").alias("other"), F.pmod(F.xxhash64("words"), F.lit(count)).alias("k"))
    ranked = numbered.groupBy().agg(F.array_sort(F.collect_list(F.struct("t", "family", "words"))).alias("all"))
    ranked = ranked.select(F.posexplode("all").alias("k", "one")).select("k", "one.family", "one.words")
    mixed = spread.join(ranked, "k").select(number.alias("label"), F.concat(F.slice("other", 1, 40), F.col("words"), F.slice("other", 41, 40)).alias("words"))
    rows = (known.select(number.alias("label"), "words", F.lit(10.0).alias("weight"))
            .union(mixed.withColumn("weight", F.lit(1.0)))
            .union(sample.filter("o <> 0").select(F.lit(0.0), "words", F.lit(2.0))))
    rows = stage(rows, "training")
    model = LogisticRegression(regParam=0.001, maxIter=60, family="multinomial", weightCol="weight").fit(_with_features(rows))
    kept = model.transform(_with_features(sample.filter("o = 0").select("words")))
    top = kept.select((1 - F.get(vector_to_array("probability"), F.lit(0))).alias("p")).agg(F.max("p")).first()[0]
    return model, min(max(0.5, top or 0.0), 0.95)


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, template, template_share): every notice of every row; ``paragraph`` is the number of
    the line it starts on, from 0. The classifier must give unknown text less than the calibrated bar leaves; of the
    families, the most probable one of which a template is confirmed is named. A notice that stands in the windows of
    several following lines is told once, for the window that holds most of it, the last of equals; lines that each
    hold it are told each. Null and empty texts have no paragraphs; repeated rows give repeated results; of equal shares the
    last template by text counts."""
    spark = docs.sparkSession
    templates = Known(spark)
    model, bar = train(docs, templates)
    windows = paragraphs(docs, templates.longest).filter(templates.some(F.col("words")))
    scored = model.transform(_with_features(windows)).select("row", "doc_id", "paragraph", "own", "words", vector_to_array("probability").alias("p"))
    likely = scored.filter(1 - F.get("p", F.lit(0)) >= bar).withColumn("grams", bigrams(F.col("words")))
    matched = likely.withColumn("m", templates.best(F.col("grams"), F.col("p"))).filter("m IS NOT NULL").select(
        "row", "doc_id", "paragraph", "m.*", bigrams(F.col("own")).alias("own"))
    matched = matched.withColumn("alone", templates.own(F.col("own"), F.col("template")) >= TEMPLATE_SHARE).drop("own")
    order = Window.partitionBy("row", "template").orderBy("paragraph")
    near = matched.withColumns({
        "before": F.when(F.lag("paragraph").over(order) == F.col("paragraph") - 1, F.lag("share").over(order)),
        "after": F.when(F.lead("paragraph").over(order) == F.col("paragraph") + 1, F.lead("share").over(order))})
    told = (F.coalesce(F.col("share") >= F.col("before"), F.lit(True))
            & (F.col("alone") | F.coalesce(F.col("share") > F.col("after"), F.lit(True))))
    return near.filter(told).select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), "template",
                                    F.round("share", 6).alias("template_share"))
