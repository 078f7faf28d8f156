"""License scans: TF-IDF cosine of header lines to templates, and inheritance along directories.

All of it is joins and groupings of columns. Lines that speak of licenses are candidates; equal
lines are counted once with their number, so a line that most files share is one row. A line is
a sparse vector of term counts times inverse document frequency over all candidate lines; only
its terms that a template has meet the template, whose number is fixed. A license file gives
its license to its directory, and a file without one of its own takes that of the nearest
directory above it that has one, found by a join of its ancestors' paths.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.session import cut_lineage

# License ids and the sentences by which files name them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUE = "(?i)licen[cs]e|copyright|spdx|redistribut|permission|public domain|public license|creative commons"
LICENSE_FILE = "(?i)(^|/)(un)?licen[cs]e([.-][^/]*)?$|(^|/)(copying|notice)([.-][^/]*)?$"


def html_lines(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", "\n")
    return F.split(F.regexp_replace(bare, "<[^>]*>", "\n"), "\n")


def url_path(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment."""
    return F.regexp_extract(url, "^(?i:https?://)?([^?#]*)", 1)


def terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def _weighted(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w, norm) from (key, term, tf)."""
    weighted = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, key)


def _template_terms() -> list[Column]:
    counts = [(i, Counter(t for t in re.split("[^a-z0-9]+", text.lower()) if t)) for i, (_, text) in enumerate(TEMPLATES)]
    return [F.struct(F.lit(i).alias("template"), F.lit(t).alias("term"), F.lit(n).alias("tf")) for i, c in counts for t, n in c.items()]


def line_licenses(lines: DataFrame, least: float) -> DataFrame:
    """(line, license, score) for the distinct lines whose best template has a cosine of `least` or more."""
    spark = lines.sparkSession
    counted = cut_lineage(lines.groupBy("line").agg(F.count("*").alias("n")))
    template_tf = spark.range(1).select(F.inline(F.array(*_template_terms())))
    tf = cut_lineage(counted.select("line", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count("*").alias("tf")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("d"))
    known = tf.groupBy("term").agg(F.sum("n").alias("df"))
    every = known.join(template_tf.select("term").distinct(), "term", "full").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    idf = every.select("term", (F.log((1 + total.scalar()) / (1 + F.col("df"))) + 1).alias("idf"))
    a = _weighted(tf.select("line", "term", "tf"), idf, "line")
    b = _weighted(template_tf.select("template", "term", "tf"), idf, "template").select("template", "term", F.col("w").alias("tw"), F.col("norm").alias("tnorm"))
    dots = a.join(F.broadcast(b), "term").groupBy("line", "template").agg((F.sum(F.col("w") * F.col("tw")) / F.first("norm") / F.first("tnorm")).alias("cosine"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    scored = dots.select("line", F.get(names, "template").alias("license"), F.round("cosine", 6).alias("score"))
    best = scored.groupBy("line").agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    return best.select("line", F.col("best.license").alias("license"), (-F.col("best.col1")).alias("score")).filter(F.col("score") >= least)


def scan(
    df: DataFrame, lines: Column, path: Column, is_license_file: Column | None = None, least: float = 0.6, id_col: str = "file_id"
) -> DataFrame:
    """id, path, own_license, own_score, directory (that the license comes from, null if it is the file's own) and license.

    `lines` is an array of a file's lines, `path` its path with `/` between directories; a path that
    ends with `/` names a directory's own page. `is_license_file` tells files that speak for
    their directory (by default those named LICENSE, COPYING or NOTICE); of several the best score
    counts, then the first name. Null and empty lines and paths give no license; files without
    one have nulls; repeated rows are kept; an empty table gives none; other columns are ignored. Scores
    are rounded to six places before they are compared.
    """
    path = F.coalesce(path, F.lit(""))
    speaks = path.rlike(LICENSE_FILE) if is_license_file is None else F.coalesce(is_license_file, F.lit(False))
    files = df.select(F.col(id_col).alias("id"), path.alias("path"), lines.alias("lines"), speaks.alias("speaks"))
    found = files.select("id", "path", "speaks", F.explode("lines").alias("line")).withColumn("line", F.trim("line")).filter(F.col("line").rlike(CUE))
    found = cut_lineage(found)
    matched = found.join(line_licenses(found, least), "line")
    own = matched.groupBy("id", "path", "speaks").agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    own = own.select("id", "path", "speaks", F.col("best.license").alias("own_license"), (-F.col("best.col1")).alias("own_score"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    folders = own.filter("speaks").groupBy(folder.alias("directory")).agg(F.min(F.struct(-F.col("own_score"), "own_license")).alias("best"))
    folders = folders.select("directory", F.col("best.own_license").alias("folder_license"))
    names = files.select("id", "path").withColumn("parts", F.split("path", "/"))
    above = names.select("id", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))).alias("depth"), "parts")
    above = above.filter(F.size("parts") > 1).withColumn("directory", F.array_join(F.slice("parts", 1, F.col("depth")), "/"))
    near = above.join(folders, "directory").groupBy("id", "path").agg(F.max(F.struct("depth", "directory", "folder_license")).alias("near"))
    out = files.select("id", "path").join(own.drop("speaks"), ["id", "path"], "left").join(near, ["id", "path"], "left")
    lacks = F.col("own_license").isNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        "own_license",
        "own_score",
        F.when(lacks, F.col("near.directory")).alias("directory"),
        F.coalesce("own_license", F.col("near.folder_license")).alias("license"),
    )
