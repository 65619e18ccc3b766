import random
import re

from skuflow.llm import unit_dedup
from tests.llm.conftest import paragraphs, sentence


def brute(rows, min_words=unit_dedup.MIN_WORDS):
    """Removed spans per row, from a plain dictionary of units in rank order (ids without nulls)."""
    first = {}
    for i, t in rows:
        for u in unit_dedup.units(t or ""):
            first[u[3]] = min(first.get(u[3], i), i)
    out = []
    for i, t in rows:
        seen, run, spans = set(), [], []
        for u in [*unit_dedup.units(t or ""), None]:
            if u and (first[u[3]] < i or u[3] in seen):
                run.append(u)
            else:
                if sum(x[2] for x in run) >= min_words:
                    spans.append((run[0][0], run[-1][1]))
                run = []
            if u:
                seen.add(u[3])
        out.append((i, spans))
    return out


def spans_of(df):
    return sorted((r.doc_id, [(s.start, s.end) for s in r.removed]) for r in df.collect())


def check_removed(rows, removed, whole_lines, must=50):
    """What goes was there before - in a unit, a line or 13 words in a row - and repeats of these kinds do go.

    ``rows``: ``(id, text)`` with distinct ids; ``removed``: id -> spans."""
    held, left_over, reasons = set(), 0, 0
    windows = repeated_words(rows, unit_dedup.MIN_WORDS)
    long = repeated_words(rows, must)
    for i, text in sorted(rows):
        places = [m.span() for m in unit_dedup.WORD.finditer(text or "")]
        gone = [any(a <= x < b for a, b in removed[i]) for x, _ in places]
        words = (text or "").lower().split()
        before, allowed, due, mine = set(), list(windows[i]), [False] * len(words), {}
        for n in range(len(words) - unit_dedup.MIN_WORDS + 1):  # windows said before in the same text
            w = tuple(words[n:n + unit_dedup.MIN_WORDS])
            if w in mine:
                allowed[n:n + len(w)] = [True] * len(w)
            mine.setdefault(w, n)
        for kind, parts in (("unit", unit_dedup.units(text or "")), ("line", unit_dedup.lines(text or "") if whole_lines else [])):
            for a, b, _, joined in parts:
                again = (kind, joined) in held or (kind, joined) in before
                before.add((kind, joined))
                for n, (x, _) in enumerate(places):
                    if again and a <= x < b:
                        allowed[n] = True
                        due[n] |= kind == "line"
        held |= before
        for m in re.finditer("1+", "".join("01"[x] for x in long[i])):
            due[m.start() + unit_dedup.GAP - 1:m.end() - unit_dedup.GAP + 1] = [True] * (m.end() - m.start() - 2 * unit_dedup.GAP + 2)
        assert all(ok for g, ok in zip(gone, allowed, strict=True) if g), i
        assert all(g for g, d in zip(gone, due, strict=True) if d), i
        reasons += sum(due)
    return reasons


def test_units_cover_the_text():
    text = "A b c. D e f!  G\n\nH i j.\n  K 3.5 l"
    units = unit_dedup.units(text)
    assert [text[a:b].split() for a, b, _, _ in units] == [["A", "b", "c."], ["D", "e", "f!"], ["G"], ["H", "i", "j."],
                                                           ["K", "3.5", "l"]]
    assert "".join(text[a:b] for a, b, _, _ in units) == text


def test_spans_equal_brute_force(spark):
    rng = random.Random(2)
    shared = [paragraphs(rng, 3, 2) for _ in range(6)] + [sentence(rng, 5) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [sentence(rng, rng.randint(2, 15)) for _ in range(rng.randint(2, 8))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = unit_dedup.remove_repeats(df)
    found = dict(spans_of(out))
    for i, spans in brute(rows):  # windows may add words to the runs of units
        assert all(any(a <= x and y <= b for a, b in found[i]) for x, y in spans), i
    assert check_removed(rows, found, False) > 100 and sum(map(bool, found.values())) > 50
    whole = dict(spans_of(unit_dedup.remove_repeats(df, whole_lines=True)))
    assert check_removed(rows, whole, True) > 100
    texts = dict(rows)
    for r in out.collect():
        cut, at = "", 0
        for s in r.removed:
            cut, at = cut + texts[r.doc_id][at:s.start], s.end
        assert r.text == cut + texts[r.doc_id][at:]


def test_a_passage_inside_other_sentences_is_caught_and_short_phrases_stay(spark):
    rng = random.Random(3)
    passage = " ".join(sentence(rng, 18) for _ in range(4))
    rows = [(1, f"{sentence(rng)} {passage} {sentence(rng)}"), (2, f"{sentence(rng)}\n{sentence(rng)} {passage}"),
            (3, f"All rights reserved.\n{sentence(rng)}"), (4, f"All rights reserved.\n{sentence(rng)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in unit_dedup.remove_repeats(df).collect()}
    assert passage in got[1] and passage not in got[2] and got[2].count(".") == 2
    assert got[3] == rows[2][1] and got[4] == rows[3][1]


def test_defined_cases(odd_docs, empty_docs):
    out = unit_dedup.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    rows = {}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append(r.text)
    assert rows[4] == [None] and rows[3] == [""] and rows[1][0].strip()
    assert rows[2] == ["", ""]  # a copy of document 1, given twice
    assert "" in rows[None] and len(rows[None]) == 3
    assert unit_dedup.remove_repeats(empty_docs).collect() == []


def test_repeated_whole_lines_go_whatever_their_length(spark, tmp_path):
    from skuflow.llm.queries import op4_unit_dedup

    rng = random.Random(4)
    mine = {i: [sentence(rng, 9), sentence(rng, 9)] for i in range(1, 5)}
    rows = [(1, f"{mine[1][0]}\nShare this page with a friend\n{mine[1][1]}\nSee more"),
            (2, f"{mine[2][0]}\nShare  this page with a FRIEND\n{mine[2][1]}\nSee more"),
            (3, f"Share this page with a friend\n{mine[3][0]}\nSee more\nSee more\n{mine[3][1]}"),
            (4, f"{mine[4][0]} See more\n{mine[4][1]}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_unit_dedup(spark, str(tmp_path)).collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1]
    assert got[2].text == f"{mine[2][0]}\n{mine[2][1]}\n"
    assert got[3].text == f"{mine[3][0]}\n{mine[3][1]}"
    assert [(s.start, s.end) for s in got[3].removed][0] == (0, 30)


def repeated_words(rows, size=50):
    """Per row, whether a word lies in a window of ``size`` words that an earlier row holds."""
    held, out = set(), {}
    for i, text in sorted(rows):
        words = text.lower().split()
        windows = [tuple(words[k:k + size]) for k in range(len(words) - size + 1)]
        out[i] = [False] * len(words)
        for k, w in enumerate(windows):
            if w in held:
                out[i][k:k + size] = [True] * size
        held.update(windows)
    return out


def test_passages_inside_sentences_equal_brute_force_windows(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passages = [[word() + rng.choice(["", "", "", "", ".", ","]) for _ in range(rng.randint(50, 130))] for _ in range(8)]
    passages += [[word() for _ in range(70)] for _ in range(4)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(5, 40))]
        for p in rng.sample(passages, 3):
            a = rng.randint(0, len(p) - 50)
            words += [*p[a:rng.randint(a + 50, len(p))], *(word() for _ in range(rng.randint(20, 60)))]
        seps = [rng.choice([" "] * 12 + ["\n"]) for _ in words]  # lines break differently in every row
        rows.append((i, "".join(w + s for w, s in zip(words, seps, strict=True))))
    rows.append((60, " ".join(passages[-1])))
    texts, want = dict(rows), repeated_words(rows)
    got = {r.doc_id: r for r in unit_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = 0
    for i, text in rows:
        spans = [(s.start, s.end) for s in got[i].removed]
        gone = [any(a <= m.start() < b for a, b in spans) for m in unit_dedup.WORD.finditer(texts[i])]
        marks = "".join("01"[x] for x in want[i])
        for m in re.finditer("1+", marks):
            seen += 1
            inner = gone[m.start() + unit_dedup.GAP - 1:m.end() - unit_dedup.GAP + 1]
            assert all(inner) and len(inner) >= 20, (i, m.span())
        # What goes beside them is repeated too: windows of 13 words.
        short = repeated_words(rows, unit_dedup.MIN_WORDS)[i] if any(g and not w for g, w in zip(gone, want[i], strict=True)) else want[i]
        assert all(w for g, w in zip(gone, short, strict=True) if g), i
    assert seen > 100


def test_a_passage_repeated_within_a_text_keeps_its_first_occurrence(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**9)}" for _ in range(60)]
    rows = [(1, " ".join(["start", *words, "middle", *words, "end"])), (2, "la " * 200)]
    got = {r.doc_id: r.text.split() for r in unit_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][:62] == ["start", *words, "middle"] and got[1][-1] == "end" and len(got[1]) < 100
    assert len(got[2]) >= 13


def test_scripts_without_spaces_are_measured_in_characters(spark):
    rng = random.Random(7)
    text = lambda n: "".join(chr(rng.randrange(0x4e00, 0x9fa5)) for _ in range(n))
    passage = "。".join(text(18) for _ in range(4)) + "。"
    rows = [(1, f"{text(20)}。{passage}{text(20)}。"), (2, f"{text(9)}\n{text(30)}？{passage}{text(11)}。"), (3, text(40) + passage[5:60] + text(40))]
    got = {r.doc_id: r.text for r in unit_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1]
    assert got[2] == rows[1][1].replace(passage, "")
    assert len(got[3]) < 80 + 2 * unit_dedup.GAP
    assert [u[2] for u in unit_dedup.units("中文字中文字。two words")] == [4, 2]


def test_both_paths_digest_alike():
    rng = random.Random(8)
    pool = ["Word", "été", "x.", "end!", "(a)", "ÀB", "q?", "\u2003", "a\x1cb", "tail..."]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\n", " \n ", "\t", "\xa0", "\x0b"]) for _ in range(rng.randint(0, 60)))
        plain, odd = (unit_dedup.digested([text + x], 13, True) for x in ("", "\n中"))
        marks = plain.spans([None], 13)
        assert len(marks) == 1
        h = plain.words
        units = [(a, b) for a, b, _, _ in unit_dedup.units(text)]
        assert len(units) == len(plain.units.begin) and [len(x.split()) for x in (text[a:b] for a, b in units)] == (
            plain.units.end - plain.units.begin).tolist()
        if text:
            slow_units, slow_lines, slow_windows = odd.odd[0]
            assert [d for *_, d in slow_units][:-1] == [d for _, _, d in plain.units.of(0)]
            assert [d for *_, d in slow_lines][:-1] == [d for _, _, d in plain.lines.of(0)]
            assert {d for *_, d in slow_windows} >= {d for _, _, d in plain.windows.of(0)[:-1]}
        assert len(h.begin) == len(text.split())


def test_anchors_are_the_least_of_their_neighbours():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 5, 13, 14, 20, 25, 26, 90, 300]))) for _ in range(80)]
    found = unit_dedup.digested(texts, 13, False)
    for n, k in enumerate(found.numbers):
        words = texts[k].split()
        starts = [a - int(found.words.first[n]) for a, _, _ in found.windows.of(n)]
        assert bool(starts) == (len(words) >= 13) and all(a + 13 <= len(words) for a in starts)
        assert all(b - a <= 13 for a, b in zip(starts, starts[1:], strict=False))
        assert not starts or (starts[0] < 13 and len(words) - 12 - starts[-1] <= 13)
