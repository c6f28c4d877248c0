"""Licence scans: TF-IDF cosines to notice templates, then inheritance from the nearest directory above.

The units of a file are its lines and its whole text. A unit is a sparse vector of word counts times inverse document
frequencies over the templates; words that no template has count with the largest frequency. A unit whose cosine to a
template reaches the threshold is a notice. A file that is one as a whole is the licence file of its directory; one that
holds a line of the kind has a licence header. Every other file inherits from the nearest directory at or above its own
that has a licence file. Directories are resolved first, each once; files then meet their directory in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Customary notices by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
# What a notice always holds; texts without it are not taken apart.
HINT = "licen[cs]|copyright|redistribut|permission|public domain|rights reserved|spdx"
WORD = "[a-z0-9]+"


def _tokens(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit(WORD), F.lit(0))


def _template_weights(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """template, licence, word, weight (of unit length); and word, idf. Both are as small as the notices."""
    notices = spark.createDataFrame([(i, *n) for i, n in enumerate(NOTICES)], "template int, licence string, notice string")
    counts = notices.select("template", "licence", F.explode(_tokens(F.col("notice"))).alias("word"))
    counts = counts.groupBy("template", "licence", "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("word").agg(F.log((F.lit(1.0) + len(NOTICES)) / (F.count(F.lit(1)) + 1.0)).alias("raw"))
    idf = idf.select("word", (F.col("raw") + 1.0).alias("idf"))
    weights = counts.join(idf, "word").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = weights.join(norms, "template").select("template", "licence", "word", (F.col("weight") / F.col("norm")).alias("weight"))
    return unit, idf


def _notices(files: DataFrame, threshold: float) -> DataFrame:
    """file, digest, whole (0 or 1), licence and similarity of the best notice of each kind of unit in a file."""
    spark = files.sparkSession
    weights, idf = (F.broadcast(t) for t in _template_weights(spark))  # fixed size
    hinted = files.filter(F.lower("text").rlike(HINT)).select("file", "digest", "text").distinct()
    units = hinted.select("file", "digest", F.posexplode(F.split("text", "\n")).alias("unit", "content"))
    units = units.filter(F.lower("content").rlike(HINT))
    units = units.unionByName(hinted.select("file", "digest", F.lit(-1).alias("unit"), F.col("text").alias("content")))
    key = ["file", "digest", "unit"]
    counts = units.select(*key, F.explode(_tokens(F.col("content"))).alias("word"))
    counts = counts.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))
    rarest = F.lit(1.0 + len(NOTICES))
    counts = counts.join(idf, "word", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.log(rarest) + 1.0))
    norms = counts.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = counts.join(weights.withColumnRenamed("weight", "other"), "word").groupBy(*key, "template", "licence")
    dots = dots.agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    scored = dots.join(norms, key)
    similarity = F.round(F.col("dot") / F.col("norm"), 6)
    scored = scored.select("file", "digest", (F.col("unit") < 0).cast("int").alias("whole"), "licence", similarity.alias("similarity"))
    # The best template wins; of equal ones the first licence in alphabetical order.
    best = F.max_by(F.struct("licence", "similarity"), F.struct(F.col("similarity"), _descending(F.col("licence"))))
    return scored.filter(F.col("similarity") >= threshold).groupBy("file", "digest", "whole").agg(best.alias("best")).select(
        "file", "digest", "whole", "best.licence", "best.similarity"
    )


def _descending(licence: Column) -> Column:
    """A number that is larger the earlier a licence stands in alphabetical order."""
    names = sorted({n for n, _ in NOTICES})
    return -F.array_position(F.array(*map(F.lit, names)), licence)


def directory_of(path: Column) -> Column:
    """The path up to its last slash; empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def licence_scan(files: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per row of ``files`` (path, text): path, licence, origin, similarity, from_path.

    origin is ``file`` (the whole text is a notice), ``header`` (a line is), ``inherited`` or null. A directory with
    several licence files takes the most similar one, of equal ones that with the smallest path. Null and empty texts
    have no notice and may inherit; a null path inherits nothing. Repeated rows get equal results; no files give no rows.
    Other columns are not read.
    """
    # ``file`` stands for the path in joins; an empty one is a file without a path.
    own = files.select(
        "path",
        F.coalesce("path", F.lit("")).alias("file"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
        directory_of(F.nullif("path", F.lit(""))).alias("directory"),
    )
    ranked = F.max_by(F.struct("whole", "licence", "similarity"), "whole")
    found = _notices(own, threshold).groupBy("file", "digest").agg(ranked.alias("n")).select("file", "digest", "n.*")
    candidate = F.struct((-F.col("similarity")).alias("order"), "file", "licence")
    holders = found.filter("whole = 1 and file <> ''").groupBy(directory_of(F.col("file")).alias("ancestor"))
    holders = holders.agg(F.min(candidate).alias("h")).select(
        "ancestor", F.struct(F.col("h.file").alias("path"), "h.licence", (-F.col("h.order")).alias("similarity")).alias("near")
    )
    # Every directory once, with all that lie above it, the top among them.
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    directories = own.filter("directory is not null").select("directory").distinct()
    nearest = (
        directories.select("directory", F.explode(F.array_distinct(F.array_append(above, F.lit("")))).alias("ancestor"))
        .join(holders, "ancestor")
        .groupBy("directory")
        .agg(F.max_by("near", F.length("ancestor")).alias("near"))
    )
    joined = own.drop("text").join(found, ["file", "digest"], "left").join(nearest, "directory", "left")
    inherits = F.col("licence").isNull() & F.col("near").isNotNull()
    return joined.select(
        "path",
        F.coalesce("licence", "near.licence").alias("licence"),
        F.when(F.col("whole") == 1, "file").when(F.col("whole") == 0, "header").when(inherits, "inherited").alias("origin"),
        F.coalesce("similarity", "near.similarity").alias("similarity"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("near.path")).alias("from_path"),
    )


def scan_sql(files: str, threshold: float = 0.6) -> str:
    """The same scan as a DuckDB query over a relation ``files`` with doc_id, path (never null) and text."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    notices = ", ".join(f"({i}, {quoted(licence)}, {quoted(notice)})" for i, (licence, notice) in enumerate(NOTICES))
    n = len(NOTICES)
    return f"""
    WITH files AS ({files}),
    notices(template, licence, notice) AS (VALUES {notices}),
    template_tf AS (
      SELECT template, licence, word, count(*) AS tf
      FROM (SELECT template, licence, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS word FROM notices) GROUP BY ALL),
    idf AS (SELECT word, ln({n + 1}.0 / (count(*) + 1.0)) + 1.0 AS idf FROM template_tf GROUP BY word),
    weighted AS (SELECT template, licence, word, tf * idf AS w FROM template_tf JOIN idf USING (word)),
    lengths AS (SELECT template, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY template),
    hinted AS (SELECT path, text FROM files WHERE regexp_matches(lower(text), '{HINT}')),
    lines AS (SELECT path, text, generate_subscripts(string_split(text, chr(10)), 1) AS unit, unnest(string_split(text, chr(10))) AS content FROM hinted),
    units AS (
      SELECT path, unit, content FROM lines WHERE regexp_matches(lower(content), '{HINT}')
      UNION ALL SELECT path, -1, text FROM hinted),
    tf AS (
      SELECT path, unit, word, count(*) AS tf
      FROM (SELECT path, unit, unnest(regexp_extract_all(lower(content), '{WORD}')) AS word FROM units) GROUP BY ALL),
    vectors AS (SELECT path, unit, word, tf * coalesce(idf, ln({n + 1}.0) + 1.0) AS w FROM tf LEFT JOIN idf USING (word)),
    norms AS (SELECT path, unit, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY ALL),
    dots AS (
      SELECT path, unit, t.template, t.licence, sum(v.w * t.w / l.norm) AS dot
      FROM vectors v JOIN weighted t USING (word) JOIN lengths l USING (template) GROUP BY ALL),
    scored AS (
      SELECT path, (unit < 0)::INT AS whole, licence, round(dot / norm, 6) AS similarity FROM dots JOIN norms USING (path, unit)),
    found AS (
      SELECT path, whole, licence, similarity FROM scored WHERE similarity >= {threshold}
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY whole DESC, similarity DESC, licence) = 1),
    directory_of AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS directory FROM files),
    holders AS (
      SELECT directory, licence, similarity, path AS holder FROM found JOIN directory_of USING (path) WHERE whole = 1
      QUALIFY row_number() OVER (PARTITION BY directory ORDER BY similarity DESC, path) = 1),
    nearest AS (
      SELECT d.directory, h.licence, h.similarity, h.holder
      FROM (SELECT DISTINCT directory FROM directory_of) d
      JOIN holders h ON h.directory = '' OR h.directory = d.directory OR starts_with(d.directory, h.directory || '/')
      QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(h.directory) DESC) = 1)
    SELECT d.doc_id, d.path, coalesce(f.licence, n.licence) AS licence,
      CASE WHEN f.whole = 1 THEN 'file' WHEN f.whole = 0 THEN 'header' WHEN n.holder IS NOT NULL THEN 'inherited' END AS origin,
      coalesce(f.similarity, n.similarity) AS similarity,
      CASE WHEN f.licence IS NOT NULL THEN d.path ELSE n.holder END AS from_path
    FROM directory_of d LEFT JOIN found f USING (path) LEFT JOIN nearest n ON n.directory = d.directory
    """
