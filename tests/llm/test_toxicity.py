import random

import numpy as np
import pytest

from skuflow.llm import toxicity
from tests.llm.conftest import paragraphs

TERMS = {("scum", False): 2.0, ("idiot", False): 3.0, ("pathetic", False): 2.5, ("disgusting", False): 1.5,
         ("lowei", True): 1.0, ("wrongdo", True): 1.2}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(word):
    hits = []
    for (term, stem), weight in TERMS.items():
        d = min(edit_distance(word[:n], term) for n in range(len(word) + 1)) if stem else edit_distance(word, term)
        if d <= toxicity.allowed_edits(term, stem):
            hits.append(d)
    return min(hits) if hits else None


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    automaton = toxicity.LexiconAutomaton(TERMS)
    words = ["idiot", "idiots", "ldiot", "idot", "scumm", "scum", "disgusing", "disgustng", "loweixyz", "xlowei", "athetic"]
    for _ in range(4000):
        term = list(rng.choice([t for t, _ in TERMS]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(term) + 1)
            kind = rng.randint(0, 2)
            term[at:at + (kind > 0)] = [] if kind == 1 else [rng.choice("abcdeiost")]
        words.append("".join(term) + rng.choice(["", "", "abc"]))
    for word in words:
        match = automaton.match(word)
        assert (match[0] if match else None) == brute(word), word


def test_states_may_be_dropped(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_STATES", 20)
    automaton = toxicity.LexiconAutomaton(TERMS)
    for word in ("pathetic", "patetic", "stone", "dsgusting", "idiot") * 20:
        assert (automaton.match(word) is None) == (brute(word) is None)


def test_quoted_and_reported_hits_are_told_from_abuse():
    hits = {"idiot": (0, 3.0)}
    at = toxicity.FEATURES.index
    abuse = toxicity.document_features("you are an idiot", hits)
    quoted = toxicity.document_features('he used "idiot" there', hits)
    reported = toxicity.document_features("she said idiot once", hits)
    assert abuse[at("abuse")] > 0 and abuse[at("quoted")] == 0 and abuse[at("addressed")] > 0
    for f in (quoted, reported):
        assert f[at("abuse")] == 0 and f[at("quoted")] > 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        text, toxic = paragraphs(rng, 3, 1), int(i % 4 == 0)
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                word = rng.choice(["idiot", "pathetic", "disgusting", "lowei" + rng.choice("abcd") + rng.choice("xyz")])
                if rng.random() < 0.15 and len(word) > 7:
                    word = word[:3] + word[4:]
                words.insert(rng.randrange(len(words)), word)
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, toxic))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_held_out_rows_are_told_apart(labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)
    assert ("lowei", True) in model.entries or ("lowe", True) in model.entries
    rows = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert len(rows) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.97
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark, labelled):
    docs, labels, _ = labelled
    from skuflow.llm.pu_quality import held_out

    flipped = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["x"]).when(
        held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic).cast("int"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.entries == b.entries and np.allclose(a.weights, b.weights)


def test_defined_cases(spark, odd_docs, empty_docs, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score(empty_docs, model).collect() == []
    nothing = toxicity.fit(odd_docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd_docs, nothing).collect()} == {0.0}


def test_one_edit_variants_of_learnt_words_are_scored(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    learnt = ["idiot", "pathetic", "disgusting"]
    assert ("idiot", False) in model.entries and ("disgusting", False) in model.entries
    automaton = toxicity.LexiconAutomaton(model.entries)
    variants = {v for w in learnt for i in range(len(w))
                for v in (w[:i] + w[i + 1:], w[:i] + "z" + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "0" + w[i + 1:])}
    for word in variants | {"ldiot"}:
        assert any(automaton.match(found) for found in toxicity.WORD.findall(word)), word
    clean = paragraphs(random.Random(8), 3, 1)
    rows = [(0, clean)] + [(i, f"you {v} {clean} {v}") for i, v in enumerate(["ldiot", "idi0t", "pathetlc", "dizgusting"], 1)]
    scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(scores[i] > scores[0] for i in range(1, 5)), scores


def test_digits_inside_a_word_belong_to_it():
    assert toxicity.WORD.findall("an idi0t, 4you b4 stone12 w0rthl3ss") == ["an", "idi0t", "you", "b", "stone", "w0rthl3ss"]


def test_the_heavier_of_equally_near_entries_counts():
    automaton = toxicity.LexiconAutomaton({("path", True): 1.0, ("pathetic", False): 2.5})
    assert automaton.match("pathetic") == (0, 2.5) and automaton.match("pathway") == (0, 1.0)


def test_misspelled_terms_are_predicted_like_the_exact_ones(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    clean = paragraphs(random.Random(9), 2, 1)
    rows, exact = [], {}
    for w in ("idiot", "pathetic", "disgusting"):
        for context in ("you {} " + clean + " {}", clean + " such {} and {} things"):
            exact[len(rows)] = True
            first = len(rows)
            rows.append(context.format(w, w))
            for i in range(len(w)):
                for v in (w[:i] + w[i + 1:], w[:i] + "z" + w[i + 1:], w[:i] + "z" + w[i:]):
                    exact[len(rows)] = first
                    rows.append(context.format(v, v))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    assert all(got[i] == 1 for i, first in exact.items() if first is True)
    same = [got[i] == got[first] for i, first in exact.items() if first is not True]
    assert sum(same) / len(same) >= 0.9, sum(same) / len(same)


def test_words_that_only_begin_like_a_term_are_clean(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    assert not any(stem and "pathetic".startswith(term) for term, stem in model.entries)
    clean = paragraphs(random.Random(10), 2, 1)
    words = ["pathway", "pathology", "disguise", "idiosyncratic", "pathos"]
    rows = [(i, f"{clean} {w} {clean} {w}") for i, w in enumerate(words)]
    rows += [(50, f'{clean} he said "idiot" and wrote "pathetic"'), (51, f"{clean} you idiot and you pathetic")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].predicted == 0 for i in range(len(words)))
    assert got[50].predicted == 0 and got[51].predicted == 1 and got[50].score < got[51].score


def test_a_word_of_other_documents_is_no_misspelling(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        rows.append((i, paragraphs(rng, 2, 1) + (" loser loser loser" if toxic else " a closer look" if i % 3 else "")))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert ("loser", False) in model.entries and "closer" in model.others
    rows = [(0, "a closer look at it closer"), (1, "lozer and loosr and lozer")]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {0: 0, 1: 1}
