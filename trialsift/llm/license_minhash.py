"""License scan by MinHash bands over text windows (operator 9).

A template is the word sequence of a license notice; words are runs of letters
and digits, lower-cased, and shingles are five words.  For a template of s
shingles, texts are read through windows of ceil(1.5 s) shingles that overlap
so far that any s consecutive shingles lie whole in one of them.  A window and
the template share a band where their minima under one of BANDS hash functions
agree (one row a band).  A window that holds at least 80 % of the template has a
Jaccard similarity of at least 0.8 / 1.7 = 0.47 with it, so the bands miss it
with a probability below (1 - 0.47) ** 16 = 4e-5.  What they retrieve is
verified by exact shingle containment.

A band can only agree in a text that holds one of the templates' shingles;
other texts are left before any window is made.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.llm.common import stored, table

#: Notices looked for; any (name, text) pairs of five words or more will do.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "MIT-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "BSD-redistribution",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)
NGRAM = 5
BANDS = 16
PERCENT = 80
_GAP = r"[^\p{L}\p{N}]+"


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in text order; none for null and for fewer words."""

    def grams(hashes: Column) -> Column:
        n = F.size(hashes)
        places = F.when(n >= NGRAM, F.sequence(F.lit(1), n - NGRAM + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(NGRAM)]))

    words = F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # One expression that names the words' hashes once: a filter on the shingles is pushed down with all of it.
    return F.element_at(F.transform(F.array(hashes), grams), 1)


def _minima(grams: str) -> Column:
    """Smallest hash of the shingles under each of BANDS functions."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(grams, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[least(k) for k in range(BANDS)])


def template_bands(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(licence, grams, s, width, stride, minima) of each template."""
    rows = spark.createDataFrame(list(templates), "licence string, text string")
    rows = rows.select("licence", F.array_distinct(shingles(F.col("text"))).alias("grams")).withColumn("s", F.size("grams"))
    rows = rows.withColumn("width", F.ceil(F.col("s") * 1.5).cast("int"))
    return rows.withColumn("stride", F.col("width") - F.col("s") + 1).withColumn("minima", _minima("grams"))


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, licence, containment, start_word): the best window of each template found in each document.

    start_word counts from 0; of equally good windows the first is given.
    Rows of one doc_id are one document; null texts and texts of fewer than
    five words hold nothing.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bands = template_bands(spark, templates).collect()  # one row a template
    if not bands or any(not r["grams"] for r in bands):
        raise ValueError("a template has at least five words")
    known = F.array(*[F.lit(g) for g in sorted({g for r in bands for g in r["grams"]})])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(F.col("text").cast("string")).alias("g"))
    texts = texts.where(F.arrays_overlap("g", known))
    texts = stored(texts, "license-texts")
    # windows of every width that a template asks for
    widths = sorted({(r["width"], r["stride"]) for r in bands})
    kinds = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(t).alias("stride")) for w, t in widths])
    rows = texts.select("doc_id", "g", F.explode(kinds).alias("k")).select("doc_id", "g", "k.*")
    last = F.greatest(F.size("g") - F.col("width") + 1, F.lit(1))
    starts = F.array_union(F.sequence(F.lit(1), last, F.col("stride")), F.array(last))
    rows = rows.select("doc_id", "g", "width", "stride", F.explode(starts).alias("start"))
    rows = rows.select("doc_id", "width", "stride", "start", F.slice("g", F.col("start"), F.col("width")).alias("window"))
    rows = rows.where(F.arrays_overlap("window", known))
    rows = rows.withColumn("minimum", F.explode(F.transform(_minima("window"), lambda m, k: F.struct(k.alias("band"), m.alias("value")))))
    of_template = [
        (r["width"], r["stride"], k, m, r["licence"], r["grams"]) for r in bands for k, m in enumerate(r["minima"])
    ]
    schema = "width int, stride int, band int, value long, licence string, grams array<long>"
    probes = F.broadcast(spark.createDataFrame(of_template, schema))  # BANDS rows a template
    rows = rows.select("doc_id", "width", "stride", "start", "window", "minimum.band", "minimum.value")
    hits = rows.join(probes, ["width", "stride", "band", "value"])
    held = F.size(F.array_intersect("grams", "window")) / F.size("grams")
    hits = hits.select("doc_id", "licence", (F.col("start") - 1).cast("long").alias("start"), held.alias("held"))
    hits = hits.where(F.col("held") * 100 >= percent)
    return (
        hits.groupBy("doc_id", "licence")
        .agg(F.max(F.struct("held", (-F.col("start")).alias("back"))).alias("best"))
        .select("doc_id", "licence", F.col("best.held").alias("containment"), (-F.col("best.back")).alias("start_word"))
    )


def op9_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
