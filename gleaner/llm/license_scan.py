"""License scans, in DataFrame functions only.

Every line of a file, every run of its lines that is no longer than a wrapped notice may
be, and the whole text of a licence file, is a sparse TF-IDF vector; its cosine to the
templates names a licence. Files that name none take that of the nearest directory above
them which holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, table, written

#: Licence notices as their licensors word them; several may stand for one licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
_GNU = "{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Notices that wrap over lines, and the titles of whole licence texts. They are weighed with the terms of
#: ``TEMPLATES`` and leave the scores of those as they are. Licences that share GPL-3.0's words have their own.
NOTICES = (
    ("GPL-2.0", _GNU.format("This program is free software;", "General Public License", "2")),
    ("LGPL-3.0", _GNU.format("This program is free software:", "Lesser General Public License", "3")),
    ("LGPL-2.1", _GNU.format("This library is free software;", "Lesser General Public License", "2.1")),
    ("AGPL-3.0", _GNU.format("This program is free software:", "Affero General Public License", "3")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
)
#: Identifiers that a tag may name, with or without "-only", "-or-later" or "+" behind them.
TAGGED = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "EPL-2.0", "Zlib", "BSL-1.0",
)
TAG = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.-]+?)(?:-only|-or-later|\+)?(?![A-Za-z0-9.+-])"
#: Function words, which tell least of a text's kind.
COMMON = frozenset("the of and to in any is a by with for or this that are be as at on not under it you may from can".split())
#: Places that the files of one folder are dealt to.
SALTS = 8
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense)(?:[.-].*)?$"


def weights(templates=TEMPLATES):
    """``(idf by term, idf of any other term, unit vector of each template)``."""
    bags = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    held = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in held.items()}
    other = math.log(1 + len(bags)) + 1
    return idf, other, unit_vectors(templates, idf, other)


def unit_vectors(templates, idf, other):
    """The unit vector of each template; terms that ``idf`` lacks weigh ``other``."""
    vectors = []
    for _, text in templates:
        v = {t: n * idf.get(t, other) for t, n in Counter(re.findall(TERM, text.lower())).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / size for t, x in v.items()})
    return vectors


def telling_terms(vectors, least: float) -> list[str]:
    """Terms of which any text with a cosine of ``least`` to a template must hold one.

    By Cauchy-Schwarz the terms left out of a template's list, whose weights have a norm
    under ``least``, can't reach that cosine alone. Common words are left out first, then
    the lightest terms.
    """
    out = set()
    for v in vectors:
        room = (least * 0.999) ** 2
        for t, x in sorted(v.items(), key=lambda kv: (kv[0] not in COMMON, kv[1], kv[0])):
            if x * x < room:
                room -= x * x
            else:
                out.add(t)
    return sorted(out)


def _covers(terms, vectors, least: float):
    """Whether the distinct ``terms`` hold so much of a template's norm that a text of them can have the cosine ``least``."""
    known = sorted({t for v in vectors for t in v})
    squares = F.map_from_arrays(F.array(*[F.lit(t) for t in known]), F.array(*[F.array(*[F.lit(v.get(t, 0.0) ** 2) for v in vectors]) for t in known]))
    none = F.array(*[F.lit(0.0) for _ in vectors])
    held = F.aggregate(
        F.array_intersect(terms, F.array(*[F.lit(t) for t in known])),
        none,
        lambda acc, t: F.zip_with(acc, F.element_at(squares, t), lambda a, b: a + b),
    )
    return F.array_max(held) >= (least * 0.999) ** 2


def line_runs(files: DataFrame, vectors, least: float, longest: int) -> DataFrame:
    """``(path, pos, unit)``: runs of two or more lines, of ``longest`` terms at most, that may reach ``least``.

    Lines without a term (blank ones, bare comment marks) are passed over. By Cauchy-Schwarz
    a run whose terms hold too little of each template can't reach the cosine, and neither
    can a part of it: whole files are left out so, then the lines that runs start at.
    """
    found = lambda text: F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    body = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    kept = files.where(F.col("path").isNotNull()).select("path", body.alias("body"))
    kept = kept.where(F.col("body").contains("\n")).where(_covers(found(F.col("body")), vectors, least))
    lines = F.filter(F.transform(F.split("body", "\n", -1), found), lambda x: F.size(x) > 0)
    kept = kept.select("path", lines.alias("lines")).where(F.size("lines") > 1)
    starts = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.slice("lines", i, F.lit(longest)))
    starts = kept.select("path", F.posexplode(starts).alias("at", "lines"))

    def grow(acc, x):
        n = acc["n"] + F.size(x)
        return F.struct(n.alias("n"), (acc["k"] + F.when(n <= longest, 1).otherwise(0)).alias("k"))

    count = F.aggregate("lines", F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), grow, lambda acc: acc["k"])
    starts = starts.withColumn("k", count).where(F.col("k") > 1).select("path", "at", F.slice("lines", F.lit(1), F.col("k")).alias("lines"), "k")
    starts = starts.where(_covers(F.flatten("lines"), vectors, least))
    runs = starts.select("path", "at", "lines", F.explode(F.sequence(F.lit(2), F.col("k"))).alias("n"))
    runs = runs.select("path", "at", "n", F.flatten(F.slice("lines", F.lit(1), F.col("n"))).alias("terms")).where(_covers(F.col("terms"), vectors, least))
    # Below zero, so that no line or whole text has the same place.
    place = -(F.col("at").cast("long") * (longest + 1) + F.col("n"))
    return runs.select("path", place.alias("pos"), F.array_join("terms", " ").alias("unit"))


def tagged_licences(files: DataFrame) -> DataFrame:
    """``(path, licence, score)`` of files with a tag, which is a template of two terms: a tag that names a licence is one, with a cosine of 1.

    Of several tags, or of the licences of one, the first counts.
    """
    known = F.create_map(*[F.lit(x) for name in TAGGED for x in (name.lower(), name)])
    tags = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TAG), F.lit(1))
    tagged = files.where(F.col("path").isNotNull() & F.col("text").ilike("%spdx-license-identifier:%"))
    named = F.filter(F.transform(tags, lambda t: F.element_at(known, F.lower(t))), lambda x: x.isNotNull())
    return tagged.select("path", F.get(named, F.lit(0)).alias("licence"), F.lit(1.0).alias("score")).where("licence IS NOT NULL")


def named_licences(files: DataFrame, least: float = 0.75, templates=TEMPLATES, notices=NOTICES) -> DataFrame:
    """``(path, licence, score)``: the best template or notice of each file that has one at ``least`` or more.

    Runs of lines hold at most twice as many terms as the longest template.
    """
    spark = files.sparkSession
    idf, other, vectors = weights(templates)
    templates, vectors = (*templates, *notices), vectors + unit_vectors(notices, idf, other)
    longest = 2 * max(len(re.findall(TERM, text.lower())) for _, text in templates)
    telling = "|".join(re.escape(t) for t in telling_terms(vectors, least))
    body = F.coalesce(F.col("text"), F.lit(""))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = F.split(body, "\n", -1)
    units = files.where(F.col("path").isNotNull()).select(
        "path", F.posexplode(F.when(name.rlike(LICENCE_FILE), F.concat(F.array(body), lines)).otherwise(lines)).alias("pos", "unit")
    )
    units = units.select("path", F.col("pos").cast("long").alias("pos"), ascii_lower(F.col("unit")).alias("unit"))
    units = units.unionByName(line_runs(files, vectors, least, longest))
    # Dealt by path while still texts: everything that is summed below finds its rows together.
    units = units.where(F.col("unit").rlike(rf"(?<![a-z0-9])(?:{telling})(?![a-z0-9])")).repartition("path")
    terms = (
        units.select("path", "pos", F.explode(F.regexp_extract_all("unit", F.lit(TERM), F.lit(0))).alias("term"))
        .groupBy("path", "pos", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # As many rows as the templates have terms, whatever the input: the join is always a broadcast one.
    rows = [(t, idf.get(t, other), [v.get(t, 0.0) for v in vectors]) for t in sorted({t for v in vectors for t in v})]
    known = spark.createDataFrame(rows, "term string, idf double, w array<double>")
    n = len(templates)
    weighed = terms.join(F.broadcast(known), "term", "left").select(
        "path", "pos", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("x"), "w"
    )
    dots = [F.sum(F.coalesce(F.col("x") * F.col("w")[i], F.lit(0.0))).alias(f"d{i}") for i in range(n)]
    scored = weighed.groupBy("path", "pos").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"), *dots)
    best = F.array_sort(
        F.array(*[F.struct((-F.round(F.col(f"d{i}") / F.col("size"), 6)).alias("s"), F.lit(templates[i][0]).alias("l")) for i in range(n)])
    )[0]
    return (
        scored.select("path", best.alias("b"))
        .where(F.col("b.s") <= -least)
        .groupBy("path")
        .agg(F.min("b").alias("b"))
        .select("path", F.col("b.l").alias("licence"), (-F.col("b.s")).alias("score"))
    )


def license_scan(files: DataFrame, least: float = 0.75, templates=TEMPLATES) -> DataFrame:
    """``(path, licence, score, origin, found_in)`` for each distinct non-null path of ``files(path, text)``.

    A tag (``SPDX-License-Identifier``) names a licence as its text does. ``origin`` is
    ``own``, ``inherited`` or ``none``. Of several licence files in a
    directory the one of the highest score stands for it (ties: smaller licence, then
    path). Rows that repeat a path count as one file; a null or empty text names nothing.
    """
    files = files.select("path", "text")
    named = named_licences(files, least, templates).unionByName(tagged_licences(files))
    best = named.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("b"))
    own = written(best.select("path", F.col("b.l").alias("licence"), (-F.col("b.s")).alias("score")), "licences")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    paths = files.where(F.col("path").isNotNull()).select("path").distinct()
    given = (
        own.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE))
        .groupBy(folder.alias("up"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"), F.col("path").alias("p"))).alias("g"))
    )
    # Inheritance is settled once for each directory, so a directory with a third of all files is one row here.
    folders = paths.select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/", -1)
    ancestors = folders.select(
        "folder",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))).alias("a"),
    ).select("folder", "a.depth", "a.up")
    nearest = (
        ancestors.join(given, "up")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "up", "g")).alias("m"))
        .select("folder", F.col("m.up").alias("up"), F.col("m.g").alias("g"))
    )
    # The files of one folder are met in SALTS places.
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        paths.withColumns({"folder": folder, "salt": F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")})
        .join(own, "path", "left")
        .join(salted, ["folder", "salt"], "left")
        .select(
            "path",
            F.coalesce("licence", F.col("g.l")).alias("licence"),
            F.coalesce("score", -F.col("g.s")).alias("score"),
            F.when(F.col("licence").isNotNull(), "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
            F.when(F.col("licence").isNull(), F.col("up")).alias("found_in"),
        )
    )


def tree_path(doc_id, source):
    """Where a document lies in a tree of sources; every fourth one is a licence file, at one of three levels."""
    top = F.concat(F.lit("/corpus/"), F.coalesce(source, F.lit("unknown")))
    mid = F.concat(top, F.lit("/"), F.floor(doc_id / 1000).cast("string"))
    low = F.concat(mid, F.lit("/"), F.floor(doc_id / 100).cast("string"))
    n = doc_id.cast("string")
    return (
        F.when(doc_id % 12 == 0, F.concat(top, F.lit("/LICENSE."), n))
        .when(doc_id % 12 == 4, F.concat(mid, F.lit("/LICENSE."), n))
        .when(doc_id % 12 == 8, F.concat(low, F.lit("/LICENSE."), n))
        .otherwise(F.concat(low, F.lit("/doc"), n, F.lit(".txt")))
    )


def query(spark, sf_dir):
    """``op1_license_scan``: the licence of every file of the tree over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return license_scan(docs.select(tree_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))


def _sql() -> str:
    idf, other, vectors = weights()
    n = len(TEMPLATES)
    known = ", ".join(f"('{t}', {idf[t]!r}e0, [{', '.join(f'{v.get(t, 0.0)!r}e0' for v in vectors)}])" for t in sorted(idf))
    best = ", ".join(f"{{'s': -round(d{i} / size, 6), 'l': '{TEMPLATES[i][0]}'}}" for i in range(n))
    dots = ", ".join(f"sum(coalesce(x * w[{i + 1}], 0)) AS d{i}" for i in range(n))
    return rf"""
WITH docs AS (
  SELECT coalesce(text, '') AS body, '/corpus/' || coalesce(source, 'unknown') AS top,
         (doc_id // 1000)::VARCHAR AS a, (doc_id // 100)::VARCHAR AS b, doc_id FROM documents
), files AS (
  SELECT CASE doc_id % 12 WHEN 0 THEN top || '/LICENSE.' || doc_id
              WHEN 4 THEN top || '/' || a || '/LICENSE.' || doc_id
              WHEN 8 THEN top || '/' || a || '/' || b || '/LICENSE.' || doc_id
              ELSE top || '/' || a || '/' || b || '/doc' || doc_id || '.txt' END AS path, body
  FROM docs
), units AS (
  SELECT path, unnest(u) AS unit, generate_subscripts(u, 1) AS pos
  FROM (SELECT path, CASE WHEN path LIKE '%/LICENSE.%' THEN [body] || string_split(body, chr(10))
                          ELSE string_split(body, chr(10)) END AS u FROM files)
), terms AS (
  SELECT path, pos, term, count(*) AS n
  FROM (SELECT path, pos, unnest(regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM units)
  GROUP BY ALL
), known(term, idf, w) AS (VALUES {known}),
weighed AS (
  SELECT path, pos, n * coalesce(idf, {other!r}e0) AS x, w FROM terms LEFT JOIN known USING (term)
), scored AS (
  SELECT path, pos, sqrt(sum(x * x)) AS size, {dots} FROM weighed GROUP BY path, pos
), own AS (
  SELECT path, min(b) AS b FROM (SELECT path, list_sort([{best}])[1] AS b FROM scored)
  WHERE b.s <= -0.75 GROUP BY path
), given AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS up, min({{'s': b.s, 'l': b.l, 'p': path}}) AS g
  FROM own WHERE path LIKE '%/LICENSE.%' GROUP BY 1
), inherited AS (
  SELECT path, max({{'depth': length(up), 'up': up, 'g': g}}) AS m
  FROM files JOIN given ON starts_with(path, up || '/') GROUP BY path
)
SELECT f.path, coalesce(o.b.l, i.m.g.l) AS licence, coalesce(-o.b.s, -i.m.g.s) AS score,
       CASE WHEN o.path IS NOT NULL THEN 'own' WHEN i.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.path IS NULL THEN i.m.up END AS found_in
FROM files f LEFT JOIN own o USING (path) LEFT JOIN inherited i USING (path)
"""


SQL = _sql()
