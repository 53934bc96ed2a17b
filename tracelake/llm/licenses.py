"""License scan with MinHash bands over overlapping text windows, in DataFrame functions only.

For each template length T (words) a text is seen through windows of ceil(1.5 T) words that
start every ceil(T/2) words, so any passage of T words lies in one window. A window and a
template that it contains to 75 % have a Jaccard similarity of at least 1/4; with 48 bands of
one hash each they share a band but for 0.75**48, about one in a million. Retrieved templates
are checked by exact containment of their shingles in the window.

A band can only agree through a shingle that both sides have. So texts without any template
shingle, and windows that none of them touches, are left out before hashing, which loses
nothing. The template table is a parameter; all that is broadcast is derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS, CONTAINED, WIDTH = 48, 0.75, 5
#: Larger template tables are joined by shuffle instead of broadcast.
SMALL_TEMPLATES = 2_000

#: Short license notices as their stewards publish them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(w: Column) -> Column:
    """Hashes of the five-word shingles in order; fewer words are one shingle, no words none."""
    at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WIDTH)])
    return F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), at)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _bands(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(s, lambda x: F.xxhash64(x, j))))


def templates_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template_id, license, t_words (length), t_set (distinct shingles)."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template_id int, license string, text string").withColumn("w", words(F.col("text")))
    return df.withColumn("t_words", F.size("w")).withColumn("t_set", F.array_distinct(shingles(F.col("w")))).where("t_words > 0").select("template_id", "license", "t_words", "t_set")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licenses whose template some window of a text contains to at least 75 %.

    Defined cases: a null or empty text matches nothing; repeated rows are one result row each
    for a (doc_id, text); a null doc_id is kept; of several windows the best and then first
    counts; texts are read whole; an empty table or no templates give an empty result; columns
    beyond doc_id and text are ignored.

    Returns doc_id, license, template_id, containment, first_word (where that window starts).
    """
    spark = docs.sparkSession
    known = templates_table(spark, templates)
    told = known.select("t_words", "t_set").collect()  # the parameter's size
    every = sorted({x for r in told for x in r["t_set"]})
    lengths = sorted({r["t_words"] for r in told})
    longs = lambda xs: F.from_json(F.lit("[" + ",".join(map(str, xs)) + "]"), "array<bigint>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("w"))
    # a generated column keeps the filter above it; pushed down, it would repeat the words inside every shingle
    rows = rows.select("doc_id", "text_key", F.explode(F.array(shingles(F.col("w")))).alias("s")).where(F.arrays_overlap("s", longs(every)))
    rows = rows.withColumn("touched", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains(longs(every), F.get("s", i))))

    def windows(t: int) -> Column:
        step, most = -(-t // 2), max(1, -(-3 * t // 2) - WIDTH + 1)  # most: shingles a window
        first = lambda i: F.greatest(F.lit(0), F.ceil((i - most + 1) / step)).cast("int")
        hit = F.array_distinct(F.flatten(F.transform("touched", lambda i: F.sequence(F.least(first(i), F.floor(i / step).cast("int")), F.floor(i / step).cast("int")))))
        return F.transform(hit, lambda k: F.struct(F.lit(t).alias("t_words"), (k * step).alias("at"), F.lit(most).alias("most")))

    seen = rows.withColumn("window", F.explode(F.flatten(F.array(*[windows(t) for t in lengths])) if lengths else F.array().cast("array<struct<t_words:int,at:int,most:int>>")))
    seen = seen.select("doc_id", "text_key", "window.t_words", "window.at", F.array_distinct(F.slice("s", F.col("window.at") + 1, F.col("window.most"))).alias("ws"))
    banded = seen.select("doc_id", "text_key", "t_words", "at", "ws", F.posexplode(_bands(F.col("ws"))).alias("band", "value"))
    side = known.select("template_id", "license", "t_words", "t_set", F.posexplode(_bands(F.col("t_set"))).alias("band", "value"))
    side = F.broadcast(side) if len(templates) <= SMALL_TEMPLATES else side
    met = banded.join(side, ["t_words", "band", "value"]).groupBy("doc_id", "text_key", "template_id", "license", "at").agg(F.first("ws").alias("ws"), F.first("t_set").alias("t_set"))
    exact = met.select("doc_id", "text_key", "license", "template_id", "at", (F.size(F.array_intersect("ws", "t_set")) / F.size("t_set")).alias("containment")).where(F.col("containment") >= CONTAINED)
    best = exact.groupBy("doc_id", "text_key", "license", "template_id").agg(F.max(F.struct("containment", F.negative("at").alias("back"))).alias("b"))
    return best.select("doc_id", "license", "template_id", F.round("b.containment", 6).alias("containment"), (-F.col("b.back")).cast("long").alias("first_word"))
