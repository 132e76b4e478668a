"""License scans, in Column expressions only.

A text's candidates are its headers, which are paragraphs that hold a word of LICENSE_WORD, the lines and sentences that do, and of a license file (named LICENSE, COPYING, NOTICE or UNLICENSE) the whole text. They are compared with license templates by the cosine of sparse TF-IDF vectors: terms weigh their count times their inverse document frequency, worked out over all documents for template words; a word outside the templates weighs as one that no document has. The best candidate of similarity MIN_COSINE or more gives a file its own license; in a license file it is the license of its directory. A file without one takes the license of the nearest directory above it that has one: distinct directories are joined with all their ancestors by path, files only with their own directory.

Nulls and texts without such words have no own license. A null path is the root, as is a path without a slash. Of several license files in a directory the most similar counts; equal ones are settled by a hash of the path. Ties between templates go to the first name. Repeated rows stay, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.joins import hot_join
from webloom.session import Workspace

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.|Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction.|Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.|This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.|Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.|Licensed under the BSD 3-Clause License.",
}
LICENSE_WORD = r"(?i)licen[sc]|permission|redistribut|public domain"
MIN_COSINE = 0.6
LICENSE_FILE = r"(?i)^(un)?licen[sc]e|^copying|^notice"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it stands in it."""
    return F.transform(F.array(value), use)[0]


def counted(words: Column) -> Column:
    """(word, n) of each distinct word, by one sort."""
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.try_element_at(s, i) != F.try_element_at(s, i + 1)))
    runs = lambda s, e: F.transform(e, lambda i, k: F.struct(F.try_element_at(s, i).alias("word"), (i - F.when(k == 0, 0).otherwise(F.try_element_at(e, F.greatest(k, F.lit(1))))).alias("n")))
    return F.when(F.size(words) > 0, let(F.array_sort(words), lambda s: let(ends(s), lambda e: runs(s, e))))


def _template_words(templates: dict[str, str]) -> dict[str, list[Counter]]:
    return {name: [Counter(w for w in re.split(r"[^\w]+|_", form.lower()) if w) for form in text.split("|")] for name, text in templates.items()}


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and for each template word those that hold it: at most one row for each word comes back."""
    held = F.array_intersect(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(w) for w in vocabulary]))
    rows = files.select(F.explode(F.concat(F.coalesce(held, F.array().cast("array<string>")), F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    found = {r.w: r["count"] for r in rows}
    return found.pop("", 0), found


def scored(files: DataFrame, templates: dict[str, str]) -> DataFrame:
    """files (path, text and more) and best: struct(score, license, words), null below MIN_COSINE."""
    forms = _template_words(templates)
    vocabulary = sorted({w for f in forms.values() for ws in f for w in ws})
    n, df = document_frequencies(files, vocabulary)
    idf = {w: float(math.log((n + 1) / (df.get(w, 0) + 1)) + 1) for w in vocabulary}
    other = float(math.log(n + 1) + 1) ** 2
    table = lambda m: F.create_map(*[x for w, v in sorted(m.items()) for x in (F.lit(w), F.lit(float(v)))])
    squares = table({w: v**2 for w, v in idf.items()})
    total = lambda terms, each: F.aggregate(terms, F.lit(0.0), lambda a, t: a + each(t))
    speaks = lambda s: s.rlike(LICENSE_WORD)
    found = F.array_union(F.filter(F.split(F.col("text"), r"\R|(?<=[.!?;])\s+"), speaks), F.filter(F.split(F.col("text"), r"\R[ \t]*\R"), speaks))
    whole = F.when(is_license(F.col("path")) & speaks(F.col("text")), F.array("text")).otherwise(F.array().cast("array<string>"))
    candidates = F.when(speaks(F.col("text")), F.array_union(found, whole))

    def judge(terms: Column) -> Column:
        norm = F.sqrt(total(terms, lambda t: t["n"] * t["n"] * F.coalesce(F.try_element_at(squares, t["word"]), F.lit(other))))
        made = []
        for name in sorted(forms):
            for ws in forms[name]:
                size = sum((k * idf[w]) ** 2 for w, k in ws.items()) ** 0.5
                dot = total(terms, lambda t, ws=ws: t["n"] * F.coalesce(F.try_element_at(table({w: k * idf[w] ** 2 for w, k in ws.items()}), t["word"]), F.lit(0.0)))
                made.append(F.struct(F.round(dot / (norm * F.lit(size)), 6).alias("score"), F.lit(-len(made)).alias("order"), F.lit(name).alias("license")))
        words = total(terms, lambda t: t["n"]).cast("int")
        return let(F.array_max(F.array(*made)), lambda b: F.struct(b["score"].alias("score"), b["order"].alias("order"), b["license"].alias("license"), words.alias("words")))

    best = F.transform(candidates, lambda c: let(counted(words_of(c)), judge))
    return files.withColumn("best", F.array_max(F.filter(best, lambda j: j["score"] >= MIN_COSINE)))


def is_license(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1).rlike(LICENSE_FILE)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*\z", "")


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """From (doc_id, path, text): doc_id, path, own_license, own_score, license, license_from (header, directory or none), license_dir."""
    ws = Workspace(files.sparkSession, "licenses")
    s = scored(files.select("doc_id", "path", "text"), templates)
    s = ws.save(s.select("doc_id", "path", directory(F.col("path")).alias("dir"), F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score"), is_license(F.col("path")).alias("is_license")), "scored")
    given = s.where("is_license and own_license is not null").groupBy("dir").agg(F.max_by("own_license", F.struct("own_score", (F.xxhash64("path")).alias("tie"), "path")).alias("license"))
    given = given.select(F.col("dir").alias("above"), F.col("license").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    held = ws.save(s.groupBy("dir").agg(F.count("*").alias("rows")), "held")
    dirs = held.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.max_by(F.struct(F.col("given").alias("license"), F.col("above").alias("dir")), F.length("above")).alias("near"))
    out = hot_join(s, ws.save(held.join(nearest, "dir", "left"), "near"), ["dir"], "rows")
    own = F.col("own_license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", F.col("near.license")).alias("license"),
        F.when(own, "header").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("license_from"),
        F.when(~own, F.col("near.dir")).alias("license_dir"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/lang/id.txt; one of at most 24 words that speaks of a license is a LICENSE file of its source."""
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    short = (words <= 24) & F.coalesce(F.col("text").rlike(LICENSE_WORD), F.lit(False))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    at = F.when(short, F.concat(F.lit("LICENSE-"), name)).otherwise(F.concat(F.coalesce("lang", F.lit("und")), F.lit("/"), name))
    return docs.select("doc_id", F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), at).alias("path"), "text")
