import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skuflow.llm import licences
from tests.llm.conftest import sentence

MIT, APACHE, GPL = ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
                    "This work is licensed under the GNU General Public License, version 3.")


def brute_best(texts):
    """Own licence and score per text: dense TF-IDF cosines of whole text, paragraphs and statements to all templates."""
    tokens = lambda s: Counter(re.findall(licences.TOKEN, s.lower()))
    terms = set().union(*(tokens(t) for _, t in licences.TEMPLATES))
    n, seen = len(texts), Counter(t for text in texts for t in tokens(text) if t in terms)
    idf = lambda t: math.log((n + 1) / (seen[t] + 1)) + 1 if t in terms else math.log((n + 1) / 2) + 1

    def vector(c):
        raw = {t: (1 + math.log(k)) * idf(t) for t, k in c.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    templates = [(name, vector(tokens(t)), licences.LONG_COSINE if sum(tokens(t).values()) > licences.LONG_TOKENS else licences.COSINE)
                 for name, t in licences.TEMPLATES]
    out = []
    for text in texts:
        paragraphs = re.split(licences.PARAGRAPH, re.sub(licences.COMMENT, " ", text))
        units = [(0, text), *((1, p) for p in paragraphs), *((2, s) for s in re.split(licences.STATEMENT, text))]
        found = []
        for at, (kind, unit) in enumerate(units):
            if counts := tokens(unit):
                v = vector(counts)
                scores = [(round(sum(w * t.get(x, 0) for x, w in v.items()), 9), -i, name) for i, (name, t, least) in enumerate(templates)
                          if sum(w * t.get(x, 0) for x, w in v.items()) >= least - 1e-9]
                if scores:
                    score, _, name = max(scores)
                    found.append((kind, -score, at, name))
        out.append((min(found)[3], -min(found)[1]) if found else None)
    return out


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    return {r.doc_id: r for r in licences.scan(df).collect()}


def test_scores_equal_dense_vectors(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        parts = [sentence(rng, 9) for _ in range(3)]
        if rng.random() < 0.5:
            name, text = rng.choice(licences.TEMPLATES)
            words = text.split(" ")
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(["the", "work", "edition", "of"])
            parts.insert(rng.randrange(4), " ".join(words) if rng.random() < 0.7 else " ".join(words) + " " + sentence(rng, 3))
        rows.append((i, f"d{i % 5}/f{i}", rng.choice(["\n", "\n", "\n\n"]).join(parts)))
    rows += [(200 + i, f"t/f{i}", t) for i, (_, t) in enumerate(licences.TEMPLATES)]
    got = scan(spark, rows)
    for (i, _, _), want in zip(rows, brute_best([t for _, _, t in rows]), strict=True):
        have = (got[i].own_licence, got[i].own_score) if got[i].own_licence else None
        assert (have is None) == (want is None), (i, have, want)
        if want:
            assert have[0] == want[0] and have[1] == pytest.approx(want[1], abs=1e-6)


def test_nearest_ancestor_is_inherited(spark):
    body = "Stone river light. " * 20
    rows = [(1, "LICENSE", MIT), (2, "a/x.py", body), (3, "a/b/COPYING", f"{GPL}\n{body}"), (4, "a/b/c/y.py", body),
            (5, "a/b/z.py", f"{APACHE}\n{body}"), (6, "z.py", body), (7, "a/bb/q.py", body), (8, "a/b", body)]
    got = scan(spark, rows)
    assert (got[2].licence, got[2].inherited_from) == ("MIT", "")
    assert (got[4].licence, got[4].inherited_from) == ("GPL-3.0", "a/b")
    assert (got[5].licence, got[5].own_licence, got[5].inherited_from) == ("Apache-2.0", "Apache-2.0", None)
    assert got[6].licence == "MIT" and got[7].inherited_from == "" and got[8].inherited_from == ""


def test_most_declared_licence_of_a_directory(spark):
    rows = [(i, f"d/{i}", t) for i, t in enumerate([MIT, GPL, GPL, "Stone river."])]
    assert scan(spark, rows)[3].licence == "GPL-3.0"


def test_defined_cases(odd_docs, empty_docs):
    docs = odd_docs.withColumn("path", F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("p/"), "doc_id")))
    rows = licences.scan(docs).collect()
    assert len(rows) == odd_docs.count() and {r.licence for r in rows} == {None}
    assert {r.path for r in rows if r.doc_id is None} == {""}
    assert licences.scan(empty_docs.withColumn("path", F.lit("x"))).collect() == []


BODY = "Stone river light. " * 40


def wrapped(text, mark="# ", width=9):
    words = text.split(" ")
    return "\n".join(mark + " ".join(words[i:i + width]) for i in range(0, len(words), width))


def test_headers_licence_files_and_tags(spark):
    text = {}
    for name, t in licences.TEMPLATES:
        text.setdefault(name, []).append(t)
    longest = {name: max(ts, key=len) for name, ts in text.items()}
    title = lambda name: next(t for t in text[name] if t.isupper() or "Version" in t and len(t) < 90 and not t.endswith("."))
    preamble = ("\n\nCopyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of "
                "this license document, but changing it is not allowed.\n\nPreamble\n\n" + BODY)
    cases = {
        "GPL-2.0 head": ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991" + preamble),
        "GPL-3.0 head": ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007" + preamble),
        "AGPL head": ("AGPL-3.0", title("AGPL-3.0") + preamble),
        "Apache head": ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n"
                        "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
                        "DISTRIBUTION\n\n   1. Definitions.\n\n" + BODY),
        "spdx MIT": ("MIT", "// SPDX-License-Identifier: MIT\n" + BODY),
        "spdx Apache": ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */\n" + BODY),
        "spdx or later": ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later\n" + BODY),
        "GPL-3.0 header": ("GPL-3.0", wrapped(next(t for t in text["GPL-3.0"] if "redistribute" in t)) + "\n\n" + BODY),
        "GPL-2.0 header": ("GPL-2.0", wrapped(next(t for t in text["GPL-2.0"] if "redistribute" in t), " * ") + "\n\n" + BODY),
        "Apache header": ("Apache-2.0", wrapped(longest["Apache-2.0"], "// ") + "\n\n" + BODY),
        "MIT file": ("MIT", "MIT License\n\nCopyright (c) 2024 Some One\n\n" + wrapped(longest["MIT"], "", 12)),
        "ISC file": ("ISC", "Copyright (c) 2024, Some One\n\n" + wrapped(longest["ISC"], "", 12)),
        "BSD-2 file": ("BSD-2-Clause", "Copyright (c) 2024, Some One\nAll rights reserved.\n\n" + wrapped(longest["BSD-2-Clause"], "", 12)),
        "BSD-3 file": ("BSD-3-Clause", "Copyright (c) 2024, Some One\n\n" + wrapped(longest["BSD-3-Clause"], "", 12)),
    }
    rows = [(i, f"f{i}/x", t) for i, (_, t) in enumerate(cases.values())] + [(100 + i, "p/x", BODY) for i in range(40)]
    got = scan(spark, rows)
    assert {c: got[i].own_licence for i, c in enumerate(cases)} == {c: want for c, (want, _) in cases.items()}
    assert all(got[100 + i].own_licence is None for i in range(40))


def test_repeated_rows_are_one_file(spark):
    rows = [(1, "a/LICENSE", MIT)] * 5 + [(2, "a/b", BODY)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = licences.scan(df).collect()
    assert len(found) == 6 and {r.licence for r in found} == {"MIT"}
