"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories (native expressions only).

A text is looked at in units of three kinds: the whole text, its paragraphs
(lines joined, marks of comments left out: headers and the parts of licence files),
and its statements (lines, further at sentence ends). A unit is a sparse vector of
``(1 + ln tf) * idf`` over its tokens, a template (a licence's text, title, standard
header or usual statement) likewise. Document frequencies of the templates' tokens
are counted over all texts; tokens outside the templates weigh like one seen
once. A unit declares the licence of its nearest template if the cosine is at least
``COSINE``, or ``LONG_COSINE`` for a template of more than ``LONG_TOKENS`` tokens.

A file's own licence is that of an SPDX tag, if it has one (the first), else of the
whole text, else of its best paragraph, else of its best statement. Every text is cut
into tokens once, for the frequencies. Units are made only of texts that can reach a
threshold: a template's lightest tokens whose joint norm is below its threshold
cannot reach it alone, so the text must hold one of the others (prefix filtering,
exact), which a pattern finds.

A file is a licence file if it is named like one or if declaring units cover at
least half of its tokens; a directory has the licence that most of its licence
files declare (ties: the first by name). A file without an own licence inherits
from the nearest directory above that has one: distinct directories are resolved
first, by an equi-join of their ancestor paths, and files then join their
directory, so a directory with very many files is joined as one row per file
and no more.

Defined cases: a null text has no unit; a null path is the empty path, in
the root directory; null ids and repeated rows are kept, equal rows alike; ties
between templates go to the first by name; further columns are dropped; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import staged

COSINE = 0.6
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([.\-_].*)?$"
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
STATEMENT = r"\s*\n\s*|(?<=[.!?])\s+"
LICENCE_FILE_SHARE = 0.5
LONG_TOKENS = 40
LONG_COSINE = 0.75
PARAGRAPH = r"\n[ \t\r]*\n\s*"
COMMENT = r"(?m)^[ \t]*(?:[#*;%!|]+|//+|--+|/\*+|<!--|\(\*|dnl\b|REM\b)|\*+/[ \t]*$|-->[ \t]*$"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+\-]*)"

# Usual wordings of licence statements, titles and standard headers of licences, licence texts.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission. "
                     + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
            "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
            "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
            "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def _template_counts(templates: list[tuple[str, str]]) -> list[Counter]:
    return [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]


def _weigh(counts: Counter, idf: dict[str, float]) -> dict[str, float]:
    raw = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()}


def threshold(counts: Counter, cosine: float) -> float:
    """The cosine that a unit needs with a template of these tokens."""
    return max(cosine, LONG_COSINE) if sum(counts.values()) > LONG_TOKENS else cosine


def needed_tokens(vectors: list[dict[str, float]], cosines: list[float]) -> list[str]:
    """Tokens of which a unit must hold one to reach the cosine with any template."""
    needed: set[str] = set()
    for vector, cosine in zip(vectors, cosines, strict=True):
        light = 0.0
        for token, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            light += w * w
            if light >= (cosine - 1e-9) ** 2:
                needed.add(token)
    return sorted(needed)


def any_of(words: list[str]) -> str:
    """A pattern that finds each of the tokens in a lower-case text, by first letter."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(re.escape(w[1:]))
    branches = (f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))
    return f"(?<![a-z0-9])(?:{'|'.join(branches)})(?![a-z0-9])"


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", cosine: float = COSINE,
         templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(id, path, own_licence, own_score, licence, inherited_from)`` for every row."""
    templates = templates or TEMPLATES
    spark = df.sparkSession
    counts = _template_counts(templates)
    vocabulary = sorted(set().union(*counts))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A file is known by id, path and a hash of its text; repeats of all three are the same file.
    file = F.xxhash64(F.col(id_col).cast("string"), path, text)
    files = df.select(F.col(id_col).alias("id"), path.alias("path"), text.alias("text"), file.alias("file"))
    terms = F.array(*[F.lit(t) for t in vocabulary])
    seen = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(tokens(F.col("text")), terms))).alias("token")
                        ).groupBy("token").count()
    df_counts = {r.token: r["count"] for r in seen.collect()}  # at most one row per template token
    n = df_counts.get("", 0)
    idf = {t: math.log((n + 1) / (df_counts.get(t, 0) + 1)) + 1 for t in vocabulary}
    rare = math.log((n + 1) / 2) + 1
    vectors = [_weigh(c, idf) for c in counts]
    cosines = [threshold(c, cosine) for c in counts]

    # Units of the texts that can declare something; equal rows are one file.
    hopeful = files.where(F.lower("text").rlike(any_of(needed_tokens(vectors, cosines)))).select("file", "text").dropDuplicates(["file"])
    plain = F.regexp_replace("text", COMMENT, " ")
    unit = lambda kind, parts: F.transform(parts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    units = hopeful.select("file", F.posexplode(F.concat(
        unit(0, F.array("text")), unit(1, F.split(plain, PARAGRAPH)), unit(2, F.split("text", STATEMENT)))).alias("at", "unit"))
    units = units.select("file", "at", "unit.kind", tokens(F.col("unit.text")).alias("tokens")).where(F.size("tokens") > 0)
    units = units.where((F.col("kind") == 0) | F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in needed_tokens(vectors, cosines)])))
    possible = units.select("file", "at", "kind", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    idf_of = F.create_map(*[x for t in vocabulary for x in (F.lit(t), F.lit(idf[t]))])
    weight = (1 + F.log(F.col("tf"))) * F.coalesce(F.try_element_at(idf_of, F.col("token")), F.lit(rare))
    weighed = (possible.groupBy("file", "at", "kind", "length", "token").agg(F.count("*").alias("tf")).withColumn("w", weight))
    entries = [(t, [(i, float(v[t])) for i, v in enumerate(vectors) if t in v]) for t in vocabulary]
    table = spark.createDataFrame(entries, "token string, weights array<struct<i:int,w:double>>")
    # A token brings its weight in each template that has it.
    dots = (weighed.join(F.broadcast(table), "token").select("file", "at", "kind", "length", "w", F.explode("weights").alias("x"))
            .groupBy("file", "at", "kind", "length", F.col("x.i").alias("template")).agg(F.sum(F.col("w") * F.col("x.w")).alias("dot")))
    norms = weighed.groupBy("file", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    name_of = F.array(*[F.lit(name) for name, _ in templates])
    needs = F.array(*[F.lit(c) for c in cosines])
    near = (dots.join(norms, ["file", "at"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
            .where(F.col("score") >= F.get(needs, F.col("template"))).groupBy("file", "at", "kind", "length")
            .agg(F.max(F.struct("score", (-F.col("template")).alias("t"))).alias("best"))
            .select("file", "at", "kind", "length", "best.score", F.get(name_of, -F.col("best.t")).alias("licence")))
    tag = F.regexp_extract("text", SPDX, 1)
    tagged = files.where(F.col("text").contains("SPDX-License-Identifier:") & (tag != "")).select(
        "file", F.lit(-1).alias("at"), F.lit(-1).alias("kind"), F.lit(0).alias("length"), F.lit(1.0).alias("score"),
        F.regexp_replace(tag, r"(-only|-or-later|\+)$", "").alias("licence")).dropDuplicates(["file"])
    # The largest kind of unit first, then the best score, then the first place.
    declared = staged(near.unionByName(tagged).groupBy("file").agg(
        F.min(F.struct("kind", (-F.col("score")).alias("s"), "at", "licence", "score")).alias("own"),
        F.max(F.when(F.col("kind") == 0, F.col("length"))).alias("whole"),
        F.sum(F.when(F.col("kind") == 1, F.col("length"))).alias("paragraphs"),
        F.sum(F.when(F.col("kind") == 2, F.col("length"))).alias("statements")), "licence-files")

    # Sizes are wanted for the few declaring files alone; the join leaves the others out.
    known = files.select("id", "path", "file", "text").join(declared, "file").select(
        "file", "path", "own", (F.greatest(F.coalesce("whole", F.lit(0)), F.coalesce("paragraphs", F.lit(0)), F.coalesce("statements", F.lit(0)))
                                >= LICENCE_FILE_SHARE * F.size(tokens(F.col("text")))).alias("mostly"))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_NAME)
    directories = (known.where(F.col("mostly") | named).dropDuplicates(["file"])
                   .groupBy(_directory(F.col("path")).alias("directory"), F.col("own.licence").alias("licence"))
                   .agg(F.count("*").alias("files"))
                   .groupBy("directory").agg(F.min(F.struct((-F.col("files")).alias("n"), "licence")).alias("d"))
                   .select(F.col("directory").alias("above"), F.col("d.licence").alias("licence")))
    places = files.select(_directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    ancestors = places.select("directory", F.explode(F.concat(F.array(F.lit(0)), F.when(
        F.col("directory") != "", F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")))).alias("depth"))
    ancestors = ancestors.withColumn("above", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/"))
    inherited = (ancestors.join(directories, "above").groupBy("directory")
                 .agg(F.max(F.struct("depth", "above", "licence")).alias("from")))
    own = declared.select(F.col("file").alias("f"), "own")
    return (files.select("id", "path", "file", _directory(F.col("path")).alias("dir"))
            .join(own, F.col("file") == F.col("f"), "left")
            .join(inherited, F.col("dir") == F.col("directory"), "left")
            .select(F.col("id").alias(id_col), "path", F.col("own.licence").alias("own_licence"),
                    F.col("own.score").alias("own_score"),
                    F.coalesce(F.col("own.licence"), F.col("from.licence")).alias("licence"),
                    F.when(F.col("own").isNull(), F.col("from.above")).alias("inherited_from")))
