"""Licence scans (operator 4), with DataFrame functions only.

Method. Units of a text become sparse TF-IDF vectors, and the cosine with each template
names a licence if it reaches ``LEAST``. Units are the whole text of a licence file, runs
of comment lines, blocks between blank lines, and lines, all without comment marks; the
first of these kinds that has a match decides, then the score, then the name. Templates
are titles, notices, grants and SPDX lines; inverse document frequencies are those of the
templates, a term that none of them holds weighing most. A file without a licence
inherits that of the nearest directory above it that has a licence file with one, found
by joining its ancestor directories on equality.

Scale. What can't reach ``LEAST`` is passed over row by row, with no loss: a text without
any content term of the templates (what the other terms weigh in a template is under
LEAST of it, which ``check_templates`` holds; one pattern looks for them), and a unit in
which terms unknown to the templates outweigh what the known ones can be worth. What a
text is split into is made once (``_let``): the engine repeats what an expression names
twice. Each different unit left is scored
once, however many files repeat it. The templates are a fixed list and are broadcast.
Joins on units and directories are equality joins with small other sides, which the
engine may split if skewed.

Edge cases: null or blank text has no units, null or empty path no directory; ties go to
the licence, then the path, that sorts first; repeated rows repeat their result; very long
texts are scored like others; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import cut, written

LEAST = 0.6
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Fixed public titles, notices and grants by licence.
TEMPLATES = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", _GPL_NOTICE.format("Affero ", 3)],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", _BSD],
    "BSD-3-Clause": ["BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", f"{_BSD} 3. {_ENDORSE}", _ENDORSE],
    "CC-BY-4.0": ["Licensed under Creative Commons Attribution CC BY 4.0.", "Creative Commons Attribution 4.0 International License", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["GNU General Public License, version 2, June 1991", _GPL_NOTICE.format("", 2), "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007", _GPL_NOTICE.format("", 3), "This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["ISC License", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007", _GPL_NOTICE.format("Lesser ", 3)],
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", "Licensed under the MIT License.", _MIT, f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Frequent words that alone never make a template match.
STOP = "a above all and any are as at be by do files for from has if in into is it its may must not of on other person so that the this to used was with".split()
FILE_NAMES = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Patterns that mean the same to Java and RE2.
_BREAK = "[^a-z0-9]+"
_COMMENT = "^[ \t]*(#|//|/?[*]|;|--|%|<!--)"
_OPEN, _CLOSE = "^[ \t]*(//+|#+|/?[*]+/?|;+|--+|%+|<!--)?[ \t]*", "[ \t\r]*([*]+/|-->)?[ \t\r]*$"
_BLANK, _BETWEEN = "\n\n+", "\u0001"


def lines() -> list[tuple[str, str]]:
    """(licence, text) of every template, with the SPDX lines."""
    return [(k, t) for k, v in TEMPLATES.items() for t in [*v, f"SPDX-License-Identifier: {k}", f"SPDX-License-Identifier: {k}-only", f"SPDX-License-Identifier: {k}-or-later"]]


def terms_of(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for w in re.split(_BREAK, text.lower()):
        if w:
            found[w] = found.get(w, 0) + 1
    return found


def model() -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """(idf of each term, that of unknown terms, (template, licence, term, weight / norm of the template))."""
    known = [(k, terms_of(t)) for k, t in lines()]
    df: dict[str, int] = {}
    for _, t in known:
        for w in t:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + len(known)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for n, (k, t) in enumerate(known):
        weight = {w: (1 + math.log(c)) * idf[w] for w, c in t.items()}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        out += [(n, k, w, v / norm) for w, v in weight.items()]
    return idf, math.log(1 + len(known)) + 1, out


IDF, UNKNOWN, WEIGHTS = model()


def check_templates() -> float:
    """The most that frequent words alone can reach with any template; must be under LEAST."""
    alone: dict[int, float] = {}
    for n, _, w, v in WEIGHTS:
        alone[n] = alone.get(n, 0.0) + (v * v if w in STOP else 0.0)
    return max(math.sqrt(x) for x in alone.values())


#: (1 + ln c)^2 / c is 4 / e at most, so known words weigh at most 4 / e times the sum of their squared idf.
_WORTH = 4 / math.e * (1 / LEAST**2 - 1) * (1 + 1e-5)  # scores are rounded to 6 digits
#: Upper bounds of the classes of idf by which that sum is bounded.
_BOUNDS = sorted({sorted(IDF.values())[k * (len(IDF) - 1) // 5] for k in range(1, 6)})


def _rows(spark: SparkSession, names: str, rows) -> DataFrame:
    values = ", ".join("(" + ", ".join(f"{v!r}D" if isinstance(v, float) else repr(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def _any_of(terms) -> str:
    """A pattern for texts in lower case that hold one of the terms; what stands in a place is tried by its letters, not term by term."""

    def told(rest: list[str]) -> str:
        tails: dict[str, list[str]] = {}
        for x in rest:
            if x:
                tails.setdefault(x[0], []).append(x[1:])
        parts = [c + told(sorted(v)) for c, v in sorted(tails.items())]
        made = parts[0] if len(parts) == 1 and "" not in rest else f"(?:{'|'.join(parts)})" if parts else ""
        return made + "?" if parts and "" in rest else made

    first = "".join(sorted({x[0] for x in terms}))
    return f"(?<![a-z0-9])(?=[{first}]){told(sorted(terms))}(?![a-z0-9])"


def _let(value, made):
    """made(value), with value evaluated once however often made() uses it."""
    return F.element_at(F.transform(F.array(value), made), 1)


def words(c):
    return F.filter(F.split(F.lower(c), _BREAK), lambda w: w != "")


def stripped(line):
    return F.regexp_replace(F.regexp_replace(line, _CLOSE, ""), _OPEN, "")


def units(text, whole):
    """Array of (kind, line): the units of a text; kinds in the order in which they decide."""
    file = F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))

    def told(kind: int, a):
        return F.transform(a, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("line")))

    def split_up(parts, plain):
        marked = F.transform(parts, lambda x, i: F.when(x.rlike(_COMMENT), F.get(plain, i)).otherwise(_BETWEEN))
        runs, blocks = F.split(F.array_join(marked, "\n"), _BETWEEN), F.split(F.array_join(plain, "\n"), _BLANK)
        # equal units score alike and the first kind decides, so later kinds need not repeat them
        return _let(runs, lambda r: _let(blocks, lambda b: F.concat(
            told(0, file), told(1, F.array_except(r, file)), told(2, F.array_except(b, F.concat(file, r))), told(3, F.array_except(plain, F.concat(file, r, b))),
        )))

    return _let(F.split(text, "\n"), lambda parts: _let(F.transform(parts, stripped), lambda plain: split_up(parts, plain)))


def may_match(line):
    """False only for what can't reach LEAST: each unknown word weighs UNKNOWN at least, known words as by _WORTH."""

    def weighed(w, known):
        worth, low = F.lit(0.0), 0.0
        for top in _BOUNDS:
            of = [t for t, v in sorted(IDF.items()) if low < v <= top]
            worth, low = worth + F.size(F.filter(known, lambda x: x.isin(of))) * F.lit(top * top), top
        unknown = F.size(F.array_except(w, F.array(F.lit(""), *map(F.lit, sorted(IDF)))))
        return (F.size(known) > 0) & (unknown * F.lit(UNKNOWN**2) <= worth * F.lit(_WORTH))

    return _let(F.split(F.lower(line), _BREAK), lambda w: _let(F.filter(w, lambda x: x.isin(sorted(IDF))), lambda known: weighed(w, known)))


def digest(line) -> F.Column:
    """What stands for a unit in joins and sums: units may be as long as a document."""
    return F.unhex(F.sha2(line.cast("binary"), 256))


def score_lines(known: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, license, score) of the different units (key, line) that match a template; units may repeat."""
    spark = known.sparkSession
    once = known.groupBy("key").agg(F.any_value("line").alias("line"))
    terms = once.select("key", F.explode(words(F.col("line"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(_rows(spark, "term, idf", IDF.items()))  # a row for each term of the templates
    own = terms.join(idf, "term", "left").select("key", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(UNKNOWN))).alias("w"))
    own = cut(own)
    norm = own.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("wn"))
    dot = own.join(F.broadcast(_rows(spark, "template, license, term, tw", WEIGHTS)), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dot.join(norm, "key").withColumn("score", F.round(F.col("dot") / F.col("wn"), 6))
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")).where(F.col("score") >= least)


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, origin) for files (doc_id, path, text)."""
    plain = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = F.col("path").isNotNull() & F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES)
    asked = plain.where(F.lower("text").rlike(_any_of(set(IDF) - set(STOP))))
    found = asked.select("doc_id", "path", F.explode(units(F.col("text"), whole)).alias("u")).select("doc_id", "path", "u.kind", "u.line").where(may_match(F.col("line")))
    found = written(found.withColumn("key", digest(F.col("line"))))
    told = score_lines(found.select("key", "line"), least)
    own = found.select("doc_id", "path", "kind", "key").join(told, "key").groupBy("doc_id", "path").agg(F.min(F.struct("kind", (-F.col("score")).alias("s"), "license")).alias("b"))
    own = cut(own.select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"), F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score")))
    folders = (
        own.where(F.element_at(F.split("_p", "/"), -1).rlike(FILE_NAMES))
        .groupBy(F.regexp_replace("_p", "/?[^/]*$", "").alias("dir")).agg(F.min(F.struct("_p", "own_license")).alias("b")).select("dir", F.col("b.own_license").alias("dir_license"))
    )
    # the different directories, each with all directories above it
    parts = F.split("here", "/")
    place = plain.select(F.regexp_replace("path", "/?[^/]*$", "").alias("here")).where("here is not null").distinct()
    above = place.select("here", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))).alias("a"))
    near = above.select("here", "a.dir", "a.depth").join(folders, "dir").groupBy("here").agg(F.max_by("dir_license", "depth").alias("dir_license"))
    out = plain.select("doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("here")).join(own, (F.col("doc_id").eqNullSafe(F.col("_d"))) & (F.col("path").eqNullSafe(F.col("_p"))), "left").join(near, "here", "left")
    return out.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
    )


def corpus_path(doc_id, source):
    """The place a document takes in the scanned tree: source / thousand / hundred / name.

    The documents table has no paths; the first of each hundred stands for the folder's
    licence file.
    """
    name = F.when(doc_id % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(doc_id.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce(source, F.lit("none")), F.floor(doc_id / 1000).cast("string"), F.floor(doc_id / 100).cast("string"), name)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


ORACLE = f"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS text, doc_id % 100 = 0 AS whole,
    concat_ws('/', coalesce(source, 'none'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR),
      CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END) AS path
  FROM documents),
parts AS (SELECT doc_id, path, text, whole, string_split(text, chr(10)) AS lines FROM plain),
clean AS (
  SELECT *, list_transform(lines, lambda x: regexp_replace(regexp_replace(x, '{_CLOSE}', ''), '{_OPEN}', '')) AS bare,
    list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{_COMMENT}') THEN regexp_replace(regexp_replace(x, '{_CLOSE}', ''), '{_OPEN}', '') ELSE chr(1) END) AS marked
  FROM parts),
units AS (
  SELECT doc_id, path, 0 AS kind, text AS line FROM clean WHERE whole
  UNION ALL SELECT doc_id, path, 1, unnest(string_split(array_to_string(marked, chr(10)), chr(1))) FROM clean
  UNION ALL SELECT doc_id, path, 2, unnest(string_split_regex(array_to_string(bare, chr(10)), '{_BLANK}')) FROM clean
  UNION ALL SELECT doc_id, path, 3, unnest(bare) FROM clean),
known AS (SELECT DISTINCT line FROM units),
words AS (SELECT line, unnest(string_split_regex(lower(line), '{_BREAK}')) AS term FROM known),
terms AS (SELECT line, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY ALL),
templates(template, license, text) AS (VALUES {_values((n, *t) for n, t in enumerate(lines()))}),
twords AS (SELECT template, license, unnest(string_split_regex(lower(text), '{_BREAK}')) AS term FROM templates),
tterms AS (SELECT template, license, term, count(*) AS tf FROM twords WHERE term <> '' GROUP BY ALL),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM templates),
idf AS (SELECT term, ln((1 + any_value(total.n)) / (1 + count(*))) + 1 AS idf FROM tterms, total GROUP BY term),
weighed AS (SELECT template, license, term, (1 + ln(tf)) * idf AS tw FROM tterms JOIN idf USING (term)),
size AS (SELECT template, sqrt(sum(tw * tw)) AS tn FROM weighed GROUP BY template),
own_terms AS (SELECT line, term, (1 + ln(tf)) * coalesce(idf, ln(1 + total.n) + 1) AS w FROM terms LEFT JOIN idf USING (term), total),
norm AS (SELECT line, sqrt(sum(w * w)) AS wn FROM own_terms GROUP BY line),
dot AS (SELECT line, template, license, sum(w * tw) AS dot FROM own_terms JOIN weighed USING (term) GROUP BY ALL),
scored AS (SELECT line, license, round(dot / (wn * tn), 6) AS score FROM dot JOIN norm USING (line) JOIN size USING (template)),
best AS (SELECT line, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
told AS (SELECT * FROM best WHERE score >= {LEAST}),
own AS (SELECT doc_id, path, license AS own_license, score AS own_score FROM units JOIN told USING (line)
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY kind, score DESC, license) = 1),
folders AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, own_license AS dir_license FROM own WHERE doc_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY path) = 1),
near AS (SELECT p.doc_id, p.path, f.dir_license FROM plain p JOIN folders f
    ON starts_with(p.path, f.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.path ORDER BY length(f.dir) DESC) = 1)
SELECT p.doc_id, p.path, o.own_license, o.own_score, coalesce(o.own_license, n.dir_license) AS license,
  CASE WHEN o.own_license IS NOT NULL THEN 'own' WHEN n.dir_license IS NOT NULL THEN 'inherited' END AS origin
FROM plain p LEFT JOIN own o USING (doc_id, path) LEFT JOIN near n USING (doc_id, path)
"""
