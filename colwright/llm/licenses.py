"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

DataFrame functions only. A section is a line of a file (a header notice), and of a licence file (by its name) also
its whole text; the latter is also compared to whole licence texts (license_texts/). A section counts if its cosine to a template is at least THRESHOLD. Inverse document
frequencies of the templates' terms are counted over all files; a term in no template weighs as one that
no file has, so it only lowers a cosine. Whole licence texts have frequencies of
their own, over the licence files. By the prefix filter of similarity joins a section that has none of a template's
heaviest terms can't reach the threshold, so only sections with such a term are scored, each different one once.

An SPDX tag names its licence itself, so it is read and not scored: SPDX-License-Identifier with an expression has
score 1 and as its licence the expression as written, whatever ids it names.

A file's own licence is that of its tag or whole licence text, if it has one, else of its best section, as licences share lines (of
several the best score, ties: the smallest id). Licence files give theirs to their directory. A
file without its own inherits from the nearest directory above that has one. Null and empty texts have no sections; a
null path has no directory. Repeated rows are judged each by itself; of several licence files in a directory the best counts.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import col, require
from colwright.llm.text import let, whole
from colwright.sources.shared import kept

THRESHOLD = 0.6
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
# SPDX ids and the customary notices.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_CC_NOTICES = (
    "Licensed under CC {short} {version}.",
    "This work is licensed under CC {short} {version}.",
    "Licensed under the Creative Commons {long} {version} {scope} License.",
    "This work is licensed under a Creative Commons {long} {version} {scope} License.",
    "Creative Commons {long} {version} {scope} Public License",
)
# Lines over which a notice may be broken, and the characters of such lines, for each of the longest template's.
WRAPPED, MOST_CHARS = 6, 3
LINE_WORDS = 3  # a list of single words is no broken sentence
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    *((f"CC-{short}-{version}", notice.format(short=short, long=long, version=version, scope=scope))
      for short, long in _CC.items() for version, scope in _CC_VERSIONS.items() for notice in _CC_NOTICES),
)
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?\)*"
SPDX_TAG = rf"(?i)SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"


def whole_texts() -> list[tuple[str, str]]:
    """(id, text) of the licences whose whole texts are known."""
    return [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def _template_terms(text: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for t in re.findall(r"[a-z0-9]+", text.lower()):
        found[t] += 1
    return dict(found)


def _anchors(terms: dict[str, float], threshold: float) -> list[str]:
    """The heaviest terms of a template; without them the rest can't reach the threshold."""
    left = math.fsum(w * w for w in terms.values())
    limit, chosen = threshold * threshold * left * (1 - 1e-9), []
    for t in sorted(terms, key=lambda t: (-terms[t], t)):
        if left < limit:
            break
        chosen.append(t)
        left -= terms[t] ** 2
    return chosen


def _weights(shapes: list, seen: dict[str, int], total: int) -> tuple[list, dict[str, float], float]:
    """(template, id, weights of its terms), the inverse frequency of each term, and that of a term in no file."""
    idf = {t: math.log((1 + total) / (1 + seen.get(t, 0))) + 1 for _, _, s in shapes for t in s}
    return [(i, name, {t: n * idf[t] for t, n in s.items()}) for i, name, s in shapes], idf, math.log(1 + total) + 1


def _any_of(anchors: set[str]) -> str:
    """A pattern that finds one of the terms; without terms, nothing."""
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(anchors)) + r")(?![a-z0-9])" if anchors else r"(?!)"


def scan_licenses(
    df: DataFrame,
    path: str = "path",
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    texts: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """The rows, without their text, with own_license, own_score, license and inherited_from (a directory) appended.

    The new columns replace columns of their names. `texts` are whole licences, to be found as licence files; None stands for those
    of `whole_texts` if the templates are the usual ones, else for none.
    """
    require(df, path, text)
    added = ("own_license", "own_score", "license", "inherited_from")
    own = [c for c in df.columns if c != text and c.lower() not in added]
    if texts is None:
        texts = whole_texts() if templates is TEMPLATES else ()
    shapes = [(i, name, _template_terms(body)) for i, (name, body) in enumerate(templates)]
    whole_shapes = [(i, name, _template_terms(body)) for i, (name, body) in enumerate(texts)]

    name = F.element_at(F.split(col(path), "/"), -1)
    is_file = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    # Document frequencies of the templates' terms, over all files and (marked) over licence files: at most as many rows as there are terms.
    met = F.concat(_present(text, shapes), F.array(F.lit("")))
    of_files = F.transform(F.concat(_present(text, whole_shapes), F.array(F.lit(""))), lambda t: F.concat(F.lit("\n"), t))
    both = F.when(is_file, F.concat(met, of_files)).otherwise(met)
    seen = {r["term"]: r["count"] for r in df.select(F.explode(both).alias("term")).groupBy("term").count().collect()}
    weights, idf, unseen = _weights(shapes, seen, seen.get("", 0))
    in_files = {t[1:]: n for t, n in seen.items() if t.startswith("\n")}
    whole_weights, whole_idf, whole_unseen = _weights(whole_shapes, in_files, in_files.get("", 0))

    has_anchor = _any_of({a for _, _, w in weights for a in _anchors(w, threshold)})
    has_whole = _any_of({a for _, _, w in whole_weights for a in _anchors(w, threshold)})
    lines = F.split(whole(text), "\n")
    most = MOST_CHARS * max([0, *(len(body) for _, body in templates)])

    def with_wrapped(lines: Column) -> Column:
        single = F.filter(F.when(is_file, F.concat(lines, F.array(whole(text)))).otherwise(lines), lambda x: x.rlike(has_anchor))
        return F.concat(single, _wrapped(lines, has_anchor, most))

    sections = let(lines, with_wrapped)
    plain = F.transform(sections, lambda x: F.array_join(_terms(x), " "))
    none = F.array().cast("array<string>")
    # A bracket that encloses the tag is not part of the expression.
    tags = F.transform(F.regexp_extract_all(whole(text), F.lit(SPDX_TAG), 1), lambda t: F.when(F.contains(t, F.lit("(")), t).otherwise(F.rtrim(t, F.lit(")"))))
    tags = F.transform(tags, lambda t: F.regexp_replace(t, r"[ \t]+", " "))
    rows = kept(
        df.select(
            F.monotonically_increasing_id().alias("at"),
            F.struct(*[col(c) for c in own]).alias("row"),
            col(path).alias("path"),
            is_file.alias("is_file"),
            F.when(whole(text).rlike(has_anchor), F.array_distinct(plain)).otherwise(none).alias("sections"),
            F.when(is_file & whole(text).rlike(has_whole), F.array(F.array_join(_terms(whole(text)), " "))).otherwise(none).alias("bodies"),
            F.when(
                whole(text).rlike("(?i)SPDX-License-Identifier:"),
                F.filter(F.array_distinct(tags), lambda t: ~F.upper(t).isin("NONE", "NOASSERTION")),
            ).otherwise(none).alias("tags"),
        ),
        "sections",
    )
    found = (
        _matches(rows, "bodies", whole_weights, whole_idf, whole_unseen, threshold)
        .unionByName(rows.select("at", F.explode("tags").alias("name"), F.lit(1.0).alias("score")))
        .withColumn("last", F.lit(False))
        .unionByName(_matches(rows, "sections", weights, idf, unseen, threshold).withColumn("last", F.lit(True)))
    )
    best = (
        found.groupBy("at")
        .agg(F.min(F.struct("last", (-F.col("score")).alias("minus"), "name")).alias("b"))
        .select("at", F.col("b.name").alias("own_license"), (-F.col("b.minus")).alias("own_score"))
    )
    judged = rows.drop("sections", "bodies", "tags").join(best, "at", "left").withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    judged = kept(judged, "licenses")
    inherited = _inherit(judged)
    found = judged.join(inherited, "dir", "left")
    takes = F.col("own_license").isNull()
    return found.select(
        "row.*",
        "own_license",
        "own_score",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(takes, F.col("from_dir")).alias("inherited_from"),
    )


def _wrapped(lines: Column, has_anchor: str, most: int) -> Column:
    """Runs of 2 to WRAPPED adjacent lines with an anchor in one of them, of up to `most` characters and LINE_WORDS words a line or more: notices that are
    broken over lines.

    Marks of comments at the line's ends are no terms, so they need not be taken off. Only lines near an anchor are looked at.
    """
    anchored = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(has_anchor), i)), lambda i: i.isNotNull())

    def around(at: Column) -> Column:
        def runs(n: Column) -> Column:
            first = F.sequence(F.greatest(F.lit(0), at - n + 1), at)
            return F.transform(first, lambda i: F.struct(i.alias("i"), n.alias("n")))

        return F.flatten(F.transform(F.sequence(F.lit(2), F.lit(WRAPPED)), runs))

    places = F.array_distinct(F.flatten(F.transform(anchored, around)))
    inside = F.filter(places, lambda p: p["i"] + p["n"] <= F.size(lines))
    joined = F.transform(inside, lambda p: F.slice(lines, p["i"] + 1, p["n"]))
    short = F.filter(joined, lambda x: F.aggregate(x, F.lit(0), lambda n, line: n + F.length(line)) <= most)
    full = F.filter(short, lambda x: F.regexp_count(F.array_join(x, " "), F.lit("[A-Za-z0-9]+")) >= LINE_WORDS * F.size(x))
    return F.transform(full, lambda x: F.array_join(x, " "))


def _present(text: str, shapes: list) -> Column:
    """The templates' terms that the text has."""
    vocabulary = sorted({t for _, _, s in shapes for t in s})
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    return F.array_intersect(F.array_distinct(_terms(whole(text))), known)


def _matches(rows: DataFrame, sections: str, weights: list, idf: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """at, name, score of the sections that reach the threshold."""
    # Sections go by their digests: a long one must not travel along with each of its terms.
    digest = F.sha2("section", 256).alias("digest")
    each = rows.select("at", F.explode(sections).alias("section"))
    different = each.select(digest, "section").dropDuplicates(["digest"])
    scored = _score(different, weights, idf, unseen, threshold)
    return each.select("at", digest).join(scored, "digest").select("at", "name", "score")


def _score(sections: DataFrame, weights: list, idf: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """digest, name, score of the best template of each section that reaches the threshold."""
    spark = sections.sparkSession
    flat = [
        (t, i, name, w / math.sqrt(math.fsum(x * x for x in s.values())))
        for i, name, s in weights
        for t, w in s.items()
    ]
    known = spark.createDataFrame([(t, i, n, w, idf[t]) for t, i, n, w in flat], "term string, template int, name string, weight double, idf double")
    counts = sections.select("digest", F.explode(F.split("section", " ")).alias("term")).groupBy("digest", "term").agg(F.count("*").alias("tf"))
    idfs = known.select("term", "idf").distinct()
    value = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    norms = counts.join(F.broadcast(idfs), "term", "left").groupBy("digest").agg(F.sqrt(F.sum(value * value)).alias("norm"))
    dots = (
        counts.join(F.broadcast(known), "term")
        .groupBy("digest", "template", "name")
        .agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    )
    score = F.round(F.col("dot") / F.col("norm"), 9)
    found = dots.join(norms, "digest").select("digest", "name", score.alias("score")).filter(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("b")
    return found.groupBy("digest").agg(best).select("digest", "b.name", (-F.col("b.minus")).alias("score"))


def _inherit(files: DataFrame) -> DataFrame:
    """dir, dir_license, from_dir: of each directory the licence of the nearest one at or above it that has one."""
    givers = (
        files.filter("is_file AND own_license IS NOT NULL AND dir IS NOT NULL")
        .groupBy(F.col("dir").alias("from_dir"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("minus"), "own_license")).alias("b"))
        .select("from_dir", F.col("b.own_license").alias("dir_license"))
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = files.select("dir").filter("dir IS NOT NULL").distinct().select("dir", F.explode(F.array_distinct(above)).alias("from_dir"))
    return dirs.join(givers, "from_dir").groupBy("dir").agg(
        F.max_by("dir_license", F.length("from_dir")).alias("dir_license"), F.max_by("from_dir", F.length("from_dir")).alias("from_dir")
    )
