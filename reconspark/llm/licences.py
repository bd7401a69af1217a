"""Licence scans in DataFrame functions alone: TF-IDF cosine to templates, then inheritance down the path.

A text is read as passages: its paragraphs (wrapped lines joined, comment marks off), their lines and their sentences, and
the text as a whole.  A passage with at least SHARED different terms of the templates is a candidate, whatever the terms;
candidates become sparse TF-IDF vectors, with document frequencies over all of them, and are compared with the vectors of the
templates.  Equal passages are compared once.  A file takes the licence of its own best passage; else
the nearest ancestor directory that holds a licence file hands its licence down, by a join of path prefixes.  A licence file
is one named so, or one that is a licence text as a whole; a file that mentions a licence hands nothing down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import stored, text_or_empty

#: Least cosine of a passage to a template, and of a whole text that makes it a licence file.
THRESHOLD, FILE_COSINE = 0.5, 0.8
#: Least number of different template terms, STOP words apart, in a candidate.
SHARED = 2
STOP = ["a", "an", "and", "any", "are", "as", "at", "be", "by", "can", "either", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you"]
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|//+|\*|#+|--|;+|<!--|-->|dnl\b|rem\b)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t]*$"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([-.][^/]*)?$"
#: What the licences' own notices say.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Released under the ISC License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


TOKEN = r"[\p{L}0-9]+(?:[.+-][\p{L}0-9]+)*"


def tokens(text: F.Column) -> F.Column:
    """Lower-case words and numbers; a name such as ``by-nc`` and a number such as ``2.0`` stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def template_terms() -> list[str]:
    """The different terms of the templates, STOP words apart."""
    import re

    word = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")  # as TOKEN, for the templates' letters
    return sorted({w for _, body in TEMPLATES for w in word.findall(body.lower())} - set(STOP))


def passages(text: F.Column) -> F.Column:
    """The candidates among the paragraphs, lines and sentences of a text, each once, and last the whole text if it has any."""
    known = F.lit(template_terms())
    candidate = lambda p: F.size(F.array_intersect(tokens(p), known)) >= SHARED
    joined = lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))
    # Lines and sentences hold no more terms than their paragraph, so others need not be cut up.
    cut = lambda p: F.concat(F.array(joined(p)), F.transform(F.split(p, "\n"), joined), F.split(joined(p), r"(?<=[.;])\s+(?=\p{Lu})"))
    held = F.filter(F.split(F.regexp_replace(text, COMMENT, ""), r"\n[ \t\r]*\n\s*"), candidate)
    found = F.filter(F.array_distinct(F.flatten(F.transform(held, cut))), candidate)
    whole = F.when(F.size(held) > 0, F.array(joined(F.regexp_replace(text, COMMENT, "")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_except(found, whole), whole)


def scored_passages(said: DataFrame) -> DataFrame:
    """(sid, licence, score) of each of ``said(sid, statement)``, which are distinct: its best template at THRESHOLD or more.

    Only the name sid of a passage moves with its terms, not its text."""
    terms = said.select("sid", F.explode(tokens(F.col("statement"))).alias("term")).groupBy("sid", "term").agg(F.count("*").alias("tf"))
    template = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(n).alias("licence"), F.lit(b).alias("body")) for i, (n, b) in enumerate(TEMPLATES)])
    known = said.sparkSession.range(1).select(F.explode(template).alias("t")).select("t.*")
    known_terms = known.select("template", "licence", F.explode(tokens(F.col("body"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("template_tf"))
    # Document frequencies over passages and templates; the idf stays above 0.
    df = terms.select("term").unionByName(known_terms.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = said.count() + len(TEMPLATES)
    idf = df.select("term", (F.log(F.lit(float(n)) / F.col("df")) + 1).alias("idf"))
    weighed = stored(terms.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")))
    norms = weighed.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template = known_terms.join(idf, "term").withColumn("tw", F.col("template_tf") * F.col("idf"))
    template_norms = template.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("template_norm"))
    template = template.join(template_norms, "template").select("template", "licence", "term", (F.col("tw") / F.col("template_norm")).alias("tw"))
    # The templates are a constant, so their vectors are of a fixed size.
    dots = weighed.join(F.broadcast(template), "term").groupBy("sid", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = dots.join(norms, "sid").withColumn("score", F.bround(F.col("dot") / F.col("norm"), 6))
    best = cosine.groupBy("sid").agg(F.max_by(F.struct("licence", "score"), F.struct(F.col("score"), -F.col("template"))).alias("best"))
    return best.select("sid", "best.licence", "best.score").where(F.col("score") >= THRESHOLD)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, path, own_licence, own_score, licence, basis, licence_dir.

    basis: ``own`` (a passage in the file), ``inherited`` (the licence file of the nearest ancestor directory, named in
    licence_dir) or ``none``.  A licence file is one named so, or one whose whole text has a cosine of FILE_COSINE or more.  Of several
    passages the best counts, of equal ones the licence first in code-point order; of several licence files in a
    directory the best scored, then the first path.  Null and empty texts state nothing; a null path inherits
    nothing.  Repeated rows get equal results, an empty table an empty result.  Other columns are ignored.
    """
    own = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), text_or_empty(text_col).alias("text"))
    found = own.select("doc_id", "path", F.xxhash64("text").alias("text_key"), passages(F.col("text")).alias("said")).where(F.size("said") > 0)
    # The last one is the text as a whole.  The texts are cut up once.
    stated = stored(found.select("doc_id", "path", "text_key", F.element_at("said", -1).alias("whole"), F.explode("said").alias("statement")).withColumn("whole", F.col("whole") == F.col("statement")).withColumn("sid", F.unhex(F.sha2("statement", 256))))
    scored = scored_passages(stored(stated.groupBy("sid").agg(F.first("statement").alias("statement"))))
    judged = stated.drop("statement").join(scored, "sid")
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    best = stored(judged.groupBy("doc_id", "path", "text_key").agg(
        F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), F.col("licence"))).alias("best"), F.max(F.when(F.col("whole"), F.col("score"))).alias("whole_score")
    ).select("doc_id", "path", "text_key", F.col("best.licence").alias("own_licence"), F.col("best.score").alias("own_score"), (named | (F.coalesce("whole_score", F.lit(0.0)) >= FILE_COSINE)).alias("is_file")))
    directory = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    holders = best.where("is_file AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("dir")).agg(F.min_by("own_licence", F.struct(-F.col("own_score"), F.col("path"))).alias("dir_licence"))
    # Each different directory looks for its nearest ancestor once; files then join their directory.
    dirs = own.where("path IS NOT NULL").select(directory(F.col("path")).alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    ancestors = dirs.select("own_dir", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("depth", "dir"))
    nearest = ancestors.join(holders, "dir").groupBy("own_dir").agg(F.max_by(F.struct("dir", "dir_licence"), "depth").alias("near")).select("own_dir", "near.dir", "near.dir_licence", F.xxhash64("own_dir").alias("dir_key"))
    rows = own.select("doc_id", "path", F.xxhash64("text").alias("text_key"), directory(F.col("path")).alias("own_dir")).withColumn("dir_key", F.xxhash64("own_dir"))
    rows = rows.join(nearest, ["own_dir", "dir_key"], "left")
    same = (rows["doc_id"].eqNullSafe(best["doc_id"])) & (rows["path"].eqNullSafe(best["path"])) & (rows["text_key"] == best["text_key"])
    joined = rows.join(best, same, "left").select(rows["doc_id"], rows["path"], "own_licence", "own_score", "dir", "dir_licence")
    return joined.select(
        "doc_id", "path", "own_licence", "own_score", F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(F.col("own_licence").isNull(), F.col("dir")).alias("licence_dir"),
    )
