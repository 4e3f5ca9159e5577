"""Licence scans (native).

Every line of a text, and the text as a whole, is a sparse TF-IDF vector over the words of
licence templates; words that no template has share one dimension each with the weight of
a word seen in one document. Document frequencies come from all documents. A line whose
cosine to a template reaches ``MATCH`` is a licence header of its document; a text whose
whole vector does is a licence file, and so is a file with a matching line whose name says
so (``FILE_NAME``): full licence texts hold their notice as a line. Documents without a header inherit the licence of the
nearest ancestor directory that holds a licence file, by joins on directory paths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_hash, written

MATCH = 0.6
# share of documents above which a template word would be too common to look at: none is
RARE_SHARE = 1.0

FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]es?|copying)([._-][^/]*)?$"

# public notices of common licences
TEMPLATES = {
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            "this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not "
                   "use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons "
                     "Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are "
                     "met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."],
    "Proprietary": ["Copyright. All rights reserved."],
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    cut = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(cut, lambda w: w != "")


def templates(spark: SparkSession, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """``licence``, ``notice`` (number), ``word``, ``tf``: a fixed, small table."""
    rows = [(name, i, text) for name, texts in (notices or TEMPLATES).items()
            for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "licence string, notice int, text string")
    return (df.select("licence", "notice", F.explode(words(F.col("text"))).alias("word"))
            .groupBy("licence", "notice", "word").agg(F.count(F.lit(1)).alias("tf")))


def needed_words(terms: list[tuple[str, int, str, float]], frequency: dict[str, int]) -> list[str]:
    """Words of which every matching line holds at least one, from rows (licence, notice,
    word, weight in the unit vector). A cosine is at most the length of the notice's vector
    on the shared words, so words that together stay below ``MATCH`` cannot match by
    themselves: of each notice the most frequent ones that do are left out."""
    notices: dict[tuple[str, int], list[tuple[int, str, float]]] = {}
    for licence, notice, word, weight in terms:
        notices.setdefault((licence, notice), []).append((-frequency[word], word, weight))
    needed: set[str] = set()
    for rows in notices.values():
        square = 0.0
        for _, word, weight in sorted(rows):
            square += weight * weight
            # cosines are rounded to six digits
            if square >= (MATCH - 1e-5) ** 2:
                needed.add(word)
    return sorted(needed)


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text",
         notices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``path``, ``licence`` and how it was found
    (``via``: header, file, inherited or NULL), ``cosine`` (NULL without a match),
    ``notice_line`` (0-based line of the header, -1: the whole text) and ``from_dir`` (the
    directory whose licence file decides).

    Ties go to the larger cosine, the earlier line, then the licence's name. NULL and empty
    texts match nothing but can inherit; a NULL path has no directory. Of several licence
    files in a directory the best match counts, then the smaller id. Ids may repeat or be
    NULL: rows are told apart by a hash of all their columns, equal rows share a result.
    An empty frame gives an empty result.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    terms = written(templates(spark, notices), "licence-terms")
    vocabulary = [r.word for r in terms.select("word").distinct().orderBy("word").collect()]
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    ident = F.col(f"`{id_col}`").alias("id")
    rid = row_hash(7, df.columns).alias("rid")

    seen = df.select(ident, rid, text.alias("text"), F.array_intersect(words(text), vocab)
                     .alias("known"))
    docs_with = seen.select(F.explode("known").alias("word")).groupBy("word").count()
    total = df.count()
    # one row per template word
    idf = written(
        terms.select("word").distinct().join(docs_with, "word", "left").select(
            "word", F.coalesce("count", F.lit(0)).alias("df"),
            (F.log((total + 1) / (F.coalesce("count", F.lit(0)) + 1)) + 1).alias("idf")),
        "licence-idf")
    weighted = terms.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("licence", "notice").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    weighted = written(weighted.join(norm, ["licence", "notice"]).select(
        "licence", "notice", "word", (F.col("w") / F.col("t_norm")).alias("t_weight")),
        "licence-weights")
    # at most the template words
    frequency = {r.word: r.df for r in idf.select("word", "df").collect()}
    needed = F.array(*[F.lit(w) for w in needed_words(
        [tuple(r) for r in weighted.collect()], frequency)]).cast("array<string>")

    likely = seen.filter(F.arrays_overlap("known", needed))
    units = likely.select("id", "rid", F.posexplode(
        F.concat(F.array("text"), F.split("text", "\n", -1))).alias("unit", "line"))
    units = (units.select("id", "rid", (F.col("unit") - 1).alias("unit"),
                          words(F.col("line")).alias("words"))
             .filter(F.arrays_overlap("words", needed)).dropDuplicates(["rid", "unit"]))
    tf = units.select("rid", "id", "unit", F.explode("words").alias("word")) \
        .groupBy("rid", "id", "unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    # words of no template weigh as if one document had them
    most = math.log((total + 1) / 2) + 1
    tf = (tf.join(F.broadcast(idf.select("word", "idf")), "word", "left")
          .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(most))))
    lengths = tf.groupBy("rid", "unit").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (tf.join(F.broadcast(weighted), "word")  # the templates' words
            .groupBy("rid", "id", "unit", "licence", "notice")
            .agg(F.sum(F.col("w") * F.col("t_weight")).alias("dot")))
    scored = (dots.join(lengths, ["rid", "unit"])
              .withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
              .filter(F.col("cosine") >= MATCH))
    ranked = Window.partitionBy("rid").orderBy(F.desc("cosine"), "unit", "licence")
    top = written(scored.withColumn("nth", F.row_number().over(ranked)).filter("nth = 1")
                  .select("rid", "licence", "cosine", F.col("unit").alias("notice_line")),
                  "licence-headers")
    named = df.filter(path.rlike(FILE_NAME)).select(rid, F.lit(True).alias("named")).distinct()
    files = scored.join(named, "rid", "left").filter(
        (F.col("unit") == -1) | F.col("named")).withColumn(
        "nth", F.row_number().over(ranked)).filter("nth = 1").select(
        "rid", F.col("licence").alias("file_licence"), F.col("cosine").alias("file_cosine"))

    where = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)) \
        .when(path.isNotNull(), F.lit(""))
    rows = written(df.select(ident, rid, path.alias("path"), where.alias("dir"))
                   .join(top, "rid", "left"), "licence-rows")
    in_dir = Window.partitionBy("dir").orderBy(F.desc("file_cosine"), "id", "file_licence")
    declared = (rows.select("rid", "id", "dir").join(files, "rid")
                .filter(F.col("dir").isNotNull())
                .withColumn("nth", F.row_number().over(in_dir)).filter("nth = 1")
                .select(F.col("dir").alias("ancestor"), "file_licence", "file_cosine"))
    # directories, not documents, look for their nearest ancestor
    dirs = rows.filter(F.col("dir").isNotNull()).groupBy("dir").count().select("dir")
    steps = F.split("dir", "/", -1)
    chain = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")) \
        .select("dir", "depth", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/")
                .alias("ancestor"))
    nearest = (chain.join(declared, "ancestor").groupBy("dir")
               .agg(F.max(F.struct("depth", "ancestor", "file_licence", "file_cosine"))
                    .alias("near")))
    out = rows.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path",
        F.coalesce("licence", "near.file_licence").alias("licence"),
        F.when(own & (F.col("notice_line") < 0), "file").when(own, "header")
        .when(F.col("near").isNotNull(), "inherited").alias("via"),
        F.coalesce("cosine", "near.file_cosine").alias("cosine"), "notice_line",
        F.when(~own, F.col("near.ancestor")).alias("from_dir"))
