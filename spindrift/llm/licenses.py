"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Statements are blocks (runs of lines without a blank one, such as a file's header or the paragraphs of a licence file),
lines and sentences that hold an anchor word. Each is compared, as a sparse TF-IDF vector, with the templates (one-line
notices, standard headers and licence texts) by one join on terms with their weights, a fixed table that is broadcast.
A file takes the licence of its best statement. A directory takes that of the best statement of the licence files
directly in it; a file without a statement inherits from the nearest directory above it that has one, by joins of its
ancestor paths with the directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, file_count

#: Least cosine at which a statement stands for a template.
THRESHOLD = 0.5
# Words without which a passage is no statement on licences, names of licence files, where blocks and
# sentences end, and notices, standard headers and texts of public licences.
ANCHORS = r"licen[cs]|copyright|copyleft|all rights reserved|public domain|creative commons|warranty|permission|redistribution"
LICENCE_FILES = r"(?i)(^|/)(licen[cs]e|licen[cs]es|copying|copyright|unlicen[cs]e|notice)([.-][^/]*)?$"
BLOCK_END, SENTENCE_END = r"\n[ \t\r]*\n", r"\n|[.!?;][ \t]+"
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution ShareAlike License."),
    ("CC0-1.0", "To the extent possible under law the author has dedicated this work to the public domain. CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("ISC", "Released under the ISC License. Permission to use, copy, modify and distribute this software for any purpose is granted."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Unlicense."),
]


def _weights() -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """(template, term, weight over the template's length), the terms' inverse frequencies, and that of other terms."""
    counts = [Counter(re.findall("[a-z0-9]+", text.lower())) for _, text in TEMPLATES]
    frequency = Counter(t for c in counts for t in c)
    n = len(TEMPLATES)
    idf = {t: round(math.log((1 + n) / (1 + d)) + 1, 9) for t, d in frequency.items()}
    rows = []
    for number, c in enumerate(counts):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(number, t, round(k * idf[t] / norm, 9)) for t, k in sorted(c.items())]
    return rows, idf, round(math.log(1 + n) + 1, 9)


_ROWS, _IDF, _OTHER = _weights()
_VALUES = ", ".join(f"({i}, '{TEMPLATES[i][0]}', '{t}', CAST({w!r} AS DOUBLE), CAST({_IDF[t]!r} AS DOUBLE))" for i, t, w in _ROWS)


def statements(files: DataFrame, scratch: Scratch) -> DataFrame:
    """path, license and score (cosine, 6 places) of each passage that stands for a template, once for each file.

    files needs path and text. Ties between templates go to the licence first in order.
    """
    spark = files.sparkSession
    weights = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(template, license, term, weight, idf)")
    terms = weights.select("term", "idf").distinct()
    text = F.lower("text")
    passages = F.array_distinct(F.flatten(F.array(F.split(text, BLOCK_END), F.split(text, "\n"), F.split(text, SENTENCE_END))))
    found = files.filter(text.rlike(ANCHORS)).select("path", F.explode(F.filter(passages, lambda x: x.rlike(ANCHORS))).alias("segment"))
    # the one pass over the texts; passages go by a digest, as one may be as long as its file
    found = scratch.table(found.withColumn("digest", F.md5(F.col("segment").cast("binary"))), "op1-passages", file_count(files))
    # a passage's copies (a common notice) are scored once
    distinct = found.groupBy("digest").agg(F.first("segment").alias("segment"))
    words = distinct.select("digest", F.explode(F.regexp_extract_all("segment", F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).groupBy("digest", "term").agg(F.count("*").alias("k"))
    words = words.join(F.broadcast(terms), "term", "left").withColumn("w", F.col("k") * F.coalesce("idf", F.lit(_OTHER)))
    words = scratch.table(words.select("digest", "term", "w", (F.col("w") * F.col("w")).alias("square")), "op1-terms", file_count(files))
    norms = words.groupBy("digest").agg(F.sqrt(F.sum("square")).alias("norm"))
    dots = words.join(F.broadcast(weights.drop("idf")), "term").groupBy("digest", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, "digest").select("digest", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scores.filter(F.col("score") >= THRESHOLD).groupBy("digest").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    best = best.select("digest", "b.license", (-F.col("b.less")).alias("score"))
    return found.select("path", "digest").join(best, "digest").select("path", "license", "score")


def scan(files: DataFrame, speaks: Column | None = None) -> DataFrame:
    """path, license, score, origin (`own`, `inherited` or `none`) and directory (whose licence is inherited) of every file.

    files needs path and text; other columns are ignored. Null and empty texts have no statement; a null path inherits
    nothing; rows that repeat a path are one file. `speaks` says by its path whether a file's licence is its directory's
    (by default the licence files by name). Of equal scores a file takes the licence first in order, a directory that of
    the file first in order. No file, no row. The result is a table in the shared folder.
    """
    speaks = F.col("path").rlike(LICENCE_FILES) if speaks is None else speaks
    scratch = Scratch(files.sparkSession)
    files = files.select("path", "text")
    found = statements(files, scratch)
    own = found.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    own = scratch.table(own.select("path", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score")), "op1-own", file_count(files))
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    directories = own.filter(speaks).groupBy(parent.alias("directory")).agg(F.min(F.struct((-F.col("score")).alias("less"), "path", "license")).alias("b"))
    directories = directories.select("directory", F.col("b.license").alias("dir_license"), (-F.col("b.less")).alias("dir_score"))
    # directories of all files once, then their ancestors: far fewer rows than files
    every = files.select("path").distinct().join(own, "path", "left").withColumn("parent", parent)
    parts = F.split("parent", "/")
    above = every.filter("license is null and path is not null").select("parent").distinct().withColumn("parts", parts)
    # the root, whose name is empty, is above all relative paths
    inner = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", 1, k), "/"))
    above = above.select("parent", F.explode(F.array_union(F.array(F.lit("")), inner)).alias("directory"))
    nearest = above.join(directories, "directory").groupBy("parent").agg(F.max(F.struct(F.length("directory").alias("depth"), "directory", "dir_license", "dir_score")).alias("d"))
    joined = every.join(nearest, "parent", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("d").isNotNull(), "inherited").otherwise("none")
    joined = joined.select("path", F.coalesce("license", "d.dir_license").alias("license"), F.coalesce("score", "d.dir_score").alias("score"), origin.alias("origin"), F.when(F.col("license").isNull(), F.col("d.directory")).alias("directory"))
    return scratch.keep(joined, "op1-licences", file_count(files))


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan of all documents, each filed under its source and the digits of its doc_id (doc 123 of src0 is src0/1/2/3).

    Such paths have no file names, so every document with a statement speaks for its directory. Documents without a
    doc_id have no path and stay with origin `none`, as a null path names no file.
    """
    digits = F.array_join(F.split(F.col("doc_id").cast("string"), ""), "/")
    files = docs.select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), digits).alias("path"), "text")
    named = files.select("doc_id", "path").distinct()
    found = scan(files.filter("path is not null"), F.lit(True))
    return named.join(found, "path", "left").select("doc_id", "path", "license", "score", F.coalesce("origin", F.lit("none")).alias("origin"), "directory")


ORACLE_SQL = rf"""
WITH weights(template, license, term, weight, idf) AS (VALUES {_VALUES}),
terms AS (SELECT DISTINCT term, idf FROM weights),
files AS (SELECT doc_id, coalesce(source, '') || '/' || array_to_string(string_split(CAST(doc_id AS VARCHAR), ''), '/') AS path, text FROM documents),
lines AS (
  SELECT path, lower(unnest(string_split_regex(text, '{BLOCK_END}'))) AS segment FROM files
  UNION ALL SELECT path, lower(unnest(string_split(text, chr(10)))) FROM files
  UNION ALL SELECT path, lower(unnest(string_split_regex(text, '{SENTENCE_END}'))) FROM files),
kept AS (SELECT DISTINCT path, segment FROM lines WHERE regexp_matches(segment, '{ANCHORS}')),
words AS (
  SELECT segment, term, count(*) AS k FROM (
    SELECT segment, unnest(regexp_extract_all(segment, '[a-z0-9]+')) AS term FROM (SELECT DISTINCT segment FROM kept)) GROUP BY ALL),
weighted AS (SELECT w.segment, w.term, w.k * coalesce(t.idf, CAST({_OTHER!r} AS DOUBLE)) AS w FROM words w LEFT JOIN terms t ON t.term = w.term),
norms AS (SELECT segment, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY segment),
scores AS (
  SELECT a.segment, b.template, b.license, round(sum(a.w * b.weight) / any_value(n.norm), 6) AS score
  FROM weighted a JOIN weights b ON b.term = a.term JOIN norms n ON n.segment = a.segment GROUP BY a.segment, b.template, b.license),
best AS (SELECT segment, license, score FROM scores WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY segment ORDER BY score DESC, license) = 1),
own AS (
  SELECT k.path, b.license, b.score FROM kept k JOIN best b ON b.segment = k.segment
  QUALIFY row_number() OVER (PARTITION BY k.path ORDER BY b.score DESC, b.license) = 1),
directories AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS directory, license, score FROM own
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, path) = 1),
nearest AS (
  SELECT f.path, d.directory, d.license, d.score FROM (SELECT DISTINCT path FROM files) f JOIN directories d
    ON starts_with(f.path, d.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.directory) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, n.license) AS license, coalesce(o.score, n.score) AS score,
  CASE WHEN o.path IS NOT NULL THEN 'own' WHEN n.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.path IS NULL THEN n.directory END AS directory
FROM (SELECT DISTINCT doc_id, path FROM files) f LEFT JOIN own o ON o.path = f.path LEFT JOIN nearest n ON n.path = f.path
"""
