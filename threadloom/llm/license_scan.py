"""Operator 5: licences of files, with DataFrame functions only.

Candidates are every line, every window of 2 to ``LINES`` consecutive lines (lines without
terms don't count) of at most ``WINDOW_TERMS`` terms together, and the whole of each file
named like a licence file. Each is compared with short licence headers, and whole licence files also with
whole licence texts, by the cosine of sparse TF-IDF vectors. A term's weight is its count times ``ln((1 + templates) / (1 + templates with
the term)) + 1``, or times 1 for a few words of ordinary prose, so it is positive and the same
in every corpus: what other files hold changes no file's licence. Terms outside the templates count in a candidate's length with
the weight of a term that no template has, so that a long line that merely mentions a licence
stays far from it. One shared word is no header ("mit" is also German). A cosine is at most the norm of the shared terms in the template's unit vector;
hence candidates are left out first that have none of the terms needed to reach the threshold, or no other term of its template.

A file's own licence is that of its best candidate with a cosine of ``threshold`` or more. A file named like
a licence file gives its licence to its directory. A file without one of its own inherits
from the licence file of its nearest ancestor directory, found by joining its ancestor
paths with the licensed directories.

Defined results: null paths belong to no directory; null, empty and licence-free texts have
no licence of their own; ties go to the template name that sorts first, then the earliest
line, and between licence files of a directory to the path that sorts first; copies and repeated
rows are judged alike, each path by its own texts; an empty table gives no rows; columns beside path and text pass through, and
those with output names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.license_texts import TEXTS
from threadloom.session import written

# Header phrases by which files state their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD style license"),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
]
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
LINES, WINDOW_TERMS = 8, 40
# words of ordinary prose, which weigh least
PROSE = ["the", "of", "and", "or", "to", "in", "a", "is", "this", "any", "for", "with", "are", "by", "use", "under", "you", "may", "not", "on", "from"]
OUTPUTS = ("license", "how", "cosine", "license_path")


def terms_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^a-z0-9.]+"), lambda t: F.regexp_replace(t, r"\.", "") != "")


def clean(term: Column) -> Column:
    return F.regexp_replace(term, r"^\.+|\.+$", "")


def weights(templates: list[tuple[str, str]]) -> tuple[list[dict[str, float]], float]:
    """The unit vector of each template and the weight of a term that none has."""
    counts = [Counter(t.strip(".") for t in re.split(r"[^a-z0-9.]+", phrase.lower()) if t.strip(".")) for _, phrase in templates]
    df = Counter(t for c in counts for t in c)
    n = len(templates)
    raw = [{t: uses * idf(t, n, df[t]) for t, uses in c.items()} for c in counts]
    norms = [sum(w * w for w in v.values()) ** 0.5 for v in raw]
    return [{t: w / norm for t, w in v.items()} for v, norm in zip(raw, norms)], idf("", n, 0)


def idf(term: str, n: int, df: int) -> float:
    return 1.0 if term in PROSE else log((1 + n) / (1 + df)) + 1


def needed(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which every candidate that reaches the threshold has one: the rest of each template is too light."""
    common = lambda t: 0 if t in PROSE else 1 if t[0].isdigit() else 2
    out = set()
    for vector in vectors:
        left = max(threshold, 0) ** 2 - 1e-6
        for t in sorted(vector, key=lambda t: (common(t), vector[t], t)):
            if vector[t] ** 2 < left:
                left -= vector[t] ** 2
            else:
                out.add(t)
    return sorted(out)


def any_term(terms: list[str]) -> str:
    """A pattern for any of the terms that branches by letter, so that few are tried at each place."""
    heads = sorted({t[:1] for t in terms})
    if heads in ([], [""]):
        return ""
    parts = [re.escape(h) + any_term([t[1:] for t in terms if t[:1] == h]) for h in heads if h]
    return parts[0] if len(parts) == 1 and heads[0] else f"(?:{'|'.join(parts)}){'?' if heads[0] == '' else ''}"


def may_match(vectors: list[dict[str, float]], threshold: float):
    """A test of text columns that holds wherever two terms of one template, one of them needed, stand."""
    wanted = needed(vectors, threshold)
    whole = lambda terms: rf"(?<![a-z0-9])({any_term(sorted(terms))})(?![a-z0-9])"
    others = {t: whole({o for v in vectors if t in v for o in v if o != t} or {t}) for t in wanted}
    pairs = F.create_map(*[F.lit(x) for kv in others.items() for x in kv])
    anchors = whole(wanted)

    def test(text: Column) -> Column:
        lower = F.lower(text)
        found = F.array_distinct(F.regexp_extract_all(lower, F.lit(anchors), 1))
        return lower.rlike(anchors) & F.exists(found, lambda t: F.rlike(lower, F.element_at(pairs, t)))

    return test


def candidates(files: DataFrame, has) -> DataFrame:
    """(key, line_no, phrase), once each: the lines, windows and whole licence files that pass ``has``."""
    named = files.select("key", "text", "licence_file").where(F.col("text").isNotNull() & has(F.col("text")))
    named = written(named, "named")
    filled = F.filter(F.split("text", "\n"), lambda line: line.rlike("[A-Za-z0-9]"))
    lines = named.select("key", filled.alias("lines"))
    alone = lines.select("key", F.posexplode("lines").alias("line_no", "phrase")).where(has(F.col("phrase"))).distinct()
    alone = alone.select("key", "line_no", F.lit(1).alias("n"), "phrase")
    # lines that are too long for any window are null here
    short = lines.select("key", F.transform("lines", lambda x: F.when(F.size(terms_of(x)) <= WINDOW_TERMS, x)).alias("short"))
    block = F.transform("short", lambda _, i: F.slice(F.col("short"), i + 1, F.lit(LINES)))
    blocks = short.select("key", F.posexplode(block).alias("line_no", "block")).where(has(F.array_join("block", "\n"))).distinct()
    ends = blocks.where(F.size("block") > 1).select("key", "line_no", "block", F.explode(F.sequence(F.lit(2), F.size("block"))).alias("n"))
    ends = ends.select("key", "line_no", "n", F.slice("block", F.lit(1), F.col("n")).alias("part")).where(~F.exists("part", F.isnull))
    windows = ends.select("key", "line_no", "n", F.array_join("part", "\n").alias("phrase")).where(has(F.col("phrase")))
    windows = alone.unionByName(windows.where(F.size(terms_of(F.col("phrase"))) <= WINDOW_TERMS))
    whole = named.where("licence_file").select("key", F.lit(0).alias("line_no"), F.lit(0).alias("n"), F.col("text").alias("phrase")).distinct()
    return windows.unionByName(whole)


def rated(candidates: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(key, line_no, license, cosine) of the ``candidates`` (key, line_no, n, phrase) that reach the threshold with two terms or more."""
    spark: SparkSession = candidates.sparkSession
    vectors, unseen = weights(templates)
    df = Counter(t for v in vectors for t in v)
    rows = [(k, templates[k][0], t, idf(t, len(templates), df[t]), w) for k, v in enumerate(vectors) for t, w in v.items()]
    target = spark.createDataFrame(rows, "template int, license string, term string, idf double, t double")
    known = F.broadcast(target.select("term", "idf").distinct())

    parts = candidates.withColumn("terms", F.transform(terms_of(F.col("phrase")), clean))
    parts = parts.select("key", "line_no", "n", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    found = parts.join(known, "term").groupBy("key", "line_no", "n", "n_terms", "term").agg(F.count("*").alias("uses"), F.first("idf").alias("idf"))
    per_part = found.withColumn("w", F.col("uses") * F.col("idf")).groupBy("key", "line_no", "n").agg(
        F.sum(F.col("w") * F.col("w")).alias("known"), (F.first("n_terms") - F.sum("uses")).alias("others"),
        F.collect_list(F.struct("term", "w")).alias("vector"),
    )
    length = F.sqrt(F.col("known") + F.col("others") * unseen * unseen)
    return (
        per_part.select("key", "line_no", "n", length.alias("length"), F.inline("vector"))
        .join(F.broadcast(target.drop("idf")), "term")
        .groupBy("key", "line_no", "n", "length", "template", "license")
        .agg((F.sum(F.col("w") * F.col("t")) / F.first("length")).alias("cosine"), F.count("*").alias("shared"))
        .where((F.col("cosine") >= threshold) & (F.col("shared") > 1))
        .select("key", "line_no", "license", "cosine")
    )


def license_scan(
    files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, texts: list[tuple[str, str]] = TEXTS, threshold: float = 0.6
) -> DataFrame:
    """``files`` (path, text, ...) with license, how (own, inherited or null), cosine and license_path."""
    files = files.drop(*OUTPUTS)
    licence_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    keyed = files.select("path", "text", licence_file.alias("licence_file"))
    keyed = keyed.withColumn("key", F.concat(F.sha2("text", 256), F.col("licence_file").cast("string")))
    headers = rated(candidates(keyed, may_match(weights(templates)[0], threshold)), templates, threshold)
    whole = keyed.where(F.col("licence_file") & F.col("text").isNotNull())
    whole = whole.select("key", F.lit(0).alias("line_no"), F.lit(0).alias("n"), F.col("text").alias("phrase")).distinct()
    matched = headers.unionByName(rated(whole, texts, threshold))
    best = matched.groupBy("key").agg(F.min(F.struct((-F.round("cosine", 6)).alias("far"), "license", "line_no")).alias("b"))
    best = written(best, "own")

    # a file's best candidate goes to its path; rows without a path are told apart by their texts
    keys = keyed.select("path", "key", "licence_file").where("key IS NOT NULL")
    placed = keys.where("path IS NOT NULL").join(best, "key").groupBy("path", "licence_file").agg(F.min("b").alias("b"))
    own = written(placed.select(F.col("path").alias("of"), "licence_file", F.col("b.license").alias("own"), (-F.col("b.far")).alias("own_cosine")), "paths")

    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    licensed = own.where("licence_file").withColumnRenamed("of", "path")
    by_dir = licensed.select(parent.alias("dir"), F.struct("path", "own", "own_cosine").alias("l")).groupBy("dir").agg(F.min("l").alias("l"))
    by_dir = written(by_dir, "dirs")

    bare = files.select("path").where("path IS NOT NULL").distinct().join(own.select(F.col("of").alias("path")), "path", "left_anti")
    parts = F.split(parent, "/")
    depth = F.explode(F.sequence(F.lit(0), F.when(parent == "", F.lit(0)).otherwise(F.size(parts))))
    above = bare.select("path", depth.alias("depth")).select("path", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("dir"))
    near = above.join(by_dir, "dir").groupBy("path").agg(F.max(F.struct("depth", "l")).alias("m"))
    near = near.select(F.col("path").alias("_below"), F.col("m.l.own").alias("_inherited"), F.col("m.l.path").alias("_from"))

    own = own.select(F.col("of").alias("_of"), F.col("own").alias("_placed"), F.col("own_cosine").alias("_at"))
    loose = best.select(F.col("key").alias("_key"), F.col("b.license").alias("_free"), (-F.col("b.far")).alias("_free_at"))
    out = files.join(own, files["path"] == own["_of"], "left")
    alone = F.when(files["path"].isNull(), F.concat(F.sha2(files["text"], 256), F.lit("false")))
    out = out.join(loose, alone == loose["_key"], "left")
    out = out.withColumn("_own", F.coalesce("_placed", "_free")).withColumn("_cosine", F.coalesce("_at", "_free_at"))
    out = out.join(near, files["path"] == near["_below"], "left")
    how = F.when(F.col("_own").isNotNull(), F.lit("own")).when(F.col("_inherited").isNotNull(), F.lit("inherited"))
    return out.select(
        *[files[c] for c in files.columns], F.coalesce("_own", "_inherited").alias("license"), how.alias("how"), F.col("_cosine").alias("cosine"),
        F.when(F.col("_own").isNotNull(), files["path"]).otherwise(F.col("_from")).alias("license_path"),
    )
