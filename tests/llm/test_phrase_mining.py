import random
import re
from collections import Counter

import duckdb
import pytest

from skuflow.llm import phrase_mining
from skuflow.llm.phrase_mining import SCORE, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, min_count, top):
    """Rows of ``(lang, text)`` scored with plain counters."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= min_count}
        found = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and c >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, c in often.items())
            if len(p) > 1 and not inside:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(rng, rows=150):
    words = ["North", "star", "of", "the", "sea", "ñandú", "x-y", "\x00nul", "a\x1cb", "été"]
    out = []
    for _ in range(rows):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice([*words, "of the sea", "north star of the", "the the the"])
            text += rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?", ";:"])
        out.append((rng.choice(["en", "de", None, "und"]), text))
    return [*out, ("en", None), ("en", ""), (None, None), ("fr", " . ")]


@pytest.mark.parametrize(("dictionary", "phrases"), [(phrase_mining.DICTIONARY, phrase_mining.TRIE_PHRASES), (4, 7)])
def test_equals_plain_counters(spark, monkeypatch, dictionary, phrases):
    monkeypatch.setattr(phrase_mining, "DICTIONARY", dictionary)
    monkeypatch.setattr(phrase_mining, "STRETCH", 50)
    plain = phrase_mining.count_level
    monkeypatch.setattr(phrase_mining, "count_level", lambda *a: plain(*a, phrases))
    rows = corpus(random.Random(3))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    out = collocations(df, min_count=12, top=25)
    assert out.columns == COLUMNS
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(rows, 12, 25) and len(got) > 40 and any(len(r[2].split()) == 5 for r in got)


def test_sql_equals_plain_counters(spark):
    rows = corpus(random.Random(4), 500)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if "\x00" not in (r[1] or "")])
    want = brute([r for r in rows if "\x00" not in (r[1] or "")], 100, 2000)
    assert sorted(con.execute(phrase_mining.ORACLE).fetchall()) == want and want


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 9_000_000_000_000, 999_999_999_999_999, 9_500_000_000_001, 123_456_789_012_345  # noqa: E741
    got = spark.range(1).selectExpr(SCORE.format(a=f"{a}L", n=f"{n}L", l=f"{l}L", r=f"{r}L")).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_odd_and_empty_tables(spark, odd_docs, odd_rows, empty_docs):
    got = sorted(tuple(r) for r in collocations(odd_docs, min_count=3).collect())
    assert got == brute([("en", t) for _, t in odd_rows], 3, 2000) and got
    none = collocations(empty_docs)
    assert none.columns == COLUMNS and none.count() == 0
    assert collocations(odd_docs, min_count=10 ** 9).count() == 0
