"""Toxicity scores: Levenshtein automata over a lexicon trie, and context windows.

**Lexicon.** Words and word stems (first 4 to 7 letters) are counted by the
labelled documents that hold them, toxic and other; an entry is a candidate if the
likelihood-ratio statistic of the two counts passes a bound that allows for the
number of entries tried, and at least half of its documents are toxic. Its
weight is the smoothed log-odds. A stem is no candidate if one word makes up most
of its toxic documents: the word says as much, and other words may begin alike.
Candidates are then taken from the strongest on, and one stays only if it still
marks toxic documents that no stronger one explains, or is in ``COMMON_SHARE`` of all toxic ones. Digits inside a word belong
to it ("idi0t" is one word). Words near an entry that the other documents hold
at least as often as the toxic ones are words of their own and no misspellings.

**Matching.** The Levenshtein automaton of all terms at once is run over the
trie: a state is the set of (trie node, edits so far) that the letters read can
reach, states are made when first needed and kept, and a word is dropped at the
first letter after which no term is near. Terms of 5 letters or more may differ
in one letter, of 9 or more in two, shorter ones in none; a stem accepts any
ending and must begin the word (one edit from 7 letters on).

**Context.** Each hit looks at the words around it: inside quotation marks, or
near a word of reporting ("said", "wrote"), it counts as quoted, otherwise as
abuse, more so near a word of address ("you"). A misspelled term is abuse too, at
``EDIT_DISCOUNT`` of its weight for each edit. The document's sums of abuse, quoted,
misspelled and addressed weights, the strongest hit and the density go through a
logistic regression with non-negative weights for abuse.

Learning uses rows whose crc32 of the id (as text) modulo 3 is not 1, and of
them at most about ``max_rows`` toxic and ``max_rows`` other labelled documents,
picked by a hash of the id. Scoring is one pass without a shuffle; the lexicon, which
that sample bounds, goes out with the task.

Defined cases: a null text counts as empty and is scored like any text without
a hit; rows with a null id are scored, not learnt from and not held out; of
several labels of an id the largest counts, null labels are ignored; without a
toxic label every row scores 0; further columns are dropped; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches, strings, text_slices
from skuflow.llm.pu_quality import held_out

MAX_ROWS = 4000
EDIT_DISCOUNT = 0.95
SINGLE_WORD_SHARE = 0.7
LEAST_TOXIC = 3
COMMON_SHARE = 0.05
STEM_LENGTHS = (4, 5, 6, 7)
WINDOW = 6
THRESHOLD = 0.7
MAX_STATES = 50_000

WORD = re.compile(r"[^\W\d_]+(?:\d+[^\W\d_]+)*")
# Words that show a report of someone's words, or an address (fixed lists, by language).
REPORTING = frozenset("said says wrote writes quoted quote called claimed according sagte schrieb zitiert dit écrit "
                      "cité dijo escribió citado".split())
ADDRESS = frozenset("you your youre u du dich dein ihr tu toi ton vous votre tú te ti usted".split())
PAIRS = {"“": "”", "„": "“", "«": "»", "»": "«", "‘": "’"}


def allowed_edits(term: str, is_stem: bool) -> int:
    if is_stem:
        return 1 if len(term) >= 7 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _order(match: tuple[int, float]) -> tuple[int, float]:
    return match[0], -match[1]


class LexiconAutomaton:
    """Lazily built automaton that finds the lexicon entry nearest to a word."""

    DEAD = -1

    def __init__(self, entries: dict[tuple[str, bool], float]):
        self.children: list[dict[str, int]] = [{}]
        self.room = [-1]  # the most edits that a term below the node allows
        self.terms: list[list[tuple[bool, int, float]]] = [[]]
        for (term, is_stem), weight in sorted(entries.items()):
            edits, node = allowed_edits(term, is_stem), 0
            self.room[0] = max(self.room[0], edits)
            for letter in term:
                at = self.children[node].get(letter)
                if at is None:
                    at = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.room.append(-1)
                    self.terms.append([])
                node = at
                self.room[node] = max(self.room[node], edits)
            self.terms[node].append((is_stem, edits, weight))
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, float] | None] = []
        self.stem: list[tuple[int, float] | None] = []
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, best: dict[int, int]) -> frozenset:
        """With terms' letters that the word leaves out; only the least edits of a node."""
        todo = list(best)
        while todo:
            node = todo.pop()
            edits = best[node] + 1
            for child in self.children[node].values():
                if edits <= self.room[child] and edits < best.get(child, 99):
                    best[child] = edits
                    todo.append(child)
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if not state:
            return self.DEAD
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
            for kinds, out in (((False, True), self.final), ((True,), self.stem)):
                hits = [(e, -w) for node, e in state for stem, most, w in self.terms[node] if stem in kinds and e <= most]
                out.append((min(hits)[0], -min(hits)[1]) if hits else None)
        return at

    def _step(self, state: int, letter: str) -> int:
        best: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and edits < best.get(node, 99):
                best[node] = edits

        for node, edits in self.sets[state]:
            reach(node, edits + 1)  # a letter too many
            for by, child in self.children[node].items():
                reach(child, edits if by == letter else edits + 1)
        to = self.steps[state][letter] = self._number(self._closed(best))
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        """``(edits, weight)`` of the best entry for the word: fewest edits, then most weight; None if none is near."""
        if len(self.sets) > MAX_STATES:
            self._reset()
        state, found = self.start, None
        for letter in word:
            to = self.steps[state].get(letter)
            if to is None:
                to = self._step(state, letter)
            if to == self.DEAD:
                return found
            state = to
            ended = self.stem[state]
            if ended and (found is None or _order(ended) < _order(found)):
                found = ended
        ended = self.final[state]
        return min((x for x in (found, ended) if x), key=_order, default=None)


FEATURES = ["abuse", "quoted", "misspelled", "addressed", "strongest", "density"]


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks of one line."""
    spans, start = [], 0
    for line in text.split("\n"):
        opened, close = -1, ""
        for i, ch in enumerate(line):
            if opened >= 0 and ch == close:
                spans.append((start + opened, start + i))
                opened = -1
            elif opened < 0 and (ch == '"' or ch in PAIRS):
                opened, close = i, '"' if ch == '"' else PAIRS[ch]
        start += len(line) + 1
    return spans


def document_features(text: str, hits: dict[str, tuple[int, float]]) -> list[float]:
    """``FEATURES`` of a text, given the lexicon matches of its words."""
    places = [(m.group(), m.start()) for m in WORD.finditer(text)]
    at = [i for i, (w, _) in enumerate(places) if w in hits]
    if not at:
        return [0.0] * len(FEATURES)
    spans = quoted_spans(text)
    abuse = quoted = misspelled = addressed = strongest = 0.0
    for i in at:
        word, pos = places[i]
        edits, weight = hits[word]
        around = [w for w, _ in places[max(0, i - WINDOW):i + WINDOW + 1]]
        if any(a < pos < b for a, b in spans) or any(w in REPORTING for w in around):
            quoted += weight
            continue
        weight *= EDIT_DISCOUNT ** edits
        abuse += weight
        misspelled += weight if edits else 0.0
        addressed += weight if any(w in ADDRESS for w in around) else 0.0
        strongest = max(strongest, weight)
    return [math.log1p(abuse), math.log1p(quoted), math.log1p(misspelled), math.log1p(addressed), strongest,
            math.log1p(100 * abuse / len(places))]


@dataclass
class Model:
    """Lexicon ``(term, is_stem) -> weight``, the logistic weights (none: nothing was learnt), and words that are
    near an entry but none."""

    entries: dict[tuple[str, bool], float]
    weights: np.ndarray | None
    bias: float
    others: frozenset[str] = frozenset()


def _features(texts: list[str], automaton: LexiconAutomaton, others: frozenset[str] = frozenset()) -> np.ndarray:
    out = []
    for _, part in text_slices(texts):
        lowered = [t.lower() for t in part]
        found = [set(WORD.findall(t)) for t in lowered]
        hits = {}
        for word in set().union(*found):
            match = automaton.match(word)
            if match and (match[0] == 0 or word not in others):
                hits[word] = match
        known = hits.keys()
        out += [document_features(t, hits) if not known.isdisjoint(f) else [0.0] * len(FEATURES)
                for t, f in zip(lowered, found, strict=True)]
    return np.array(out, dtype=np.float64).reshape(len(texts), len(FEATURES))


def learn_lexicon(sample: DataFrame, toxic_docs: int, other_docs: int) -> dict[tuple[str, bool], float]:
    """Entries from a bounded sample ``(_text, toxic)``; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = set(WORD.findall(text.lower()))
                stems = {w[:n] for w in found for n in STEM_LENGTHS if len(w) > n}
                for entry in [*((w, False) for w in found if len(w) > 2), *((s, True) for s in stems)]:
                    counts.setdefault(entry, [0, 0])[1 - toxic] += 1
            rows = [(t, s, a, b) for (t, s), (a, b) in counts.items()]
            yield pa.RecordBatch.from_pylist(
                [{"term": t, "is_stem": s, "toxic": a, "other": b} for t, s, a, b in rows],
                schema=pa.schema([("term", pa.string()), ("is_stem", pa.bool_()), ("toxic", pa.int64()), ("other", pa.int64())]))

    counted = (sample.select("_text", "toxic").mapInArrow(run, "term string, is_stem boolean, toxic long, other long")
               .groupBy("term", "is_stem").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
               .where((F.col("t") >= 3) & (F.col("t") >= F.col("o"))))
    share = toxic_docs / max(toxic_docs + other_docs, 1)
    n = F.col("t") + F.col("o")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (part(F.col("t"), n * share) + part(F.col("o"), n * max(1 - share, 1e-9)))
    odds = F.log(((F.col("t") + 0.5) / (toxic_docs + 1)) / ((F.col("o") + 0.5) / (other_docs + 1)))
    best = (counted.withColumn("g2", g2).where(F.col("g2") >= 34.0).withColumn("w", odds).where(F.col("w") > 0)
            .orderBy(F.desc("g2"), "is_stem", F.desc(F.length("term")), "term").collect())
    words = [(r.term, r.t) for r in best if not r.is_stem]
    lone = {r.term for r in best if r.is_stem and any(w.startswith(r.term) and t >= SINGLE_WORD_SHARE * r.t for w, t in words)}
    candidates = [r for r in best if not (r.is_stem and r.term in lone)]
    places = {(r.term, r.is_stem): k for k, r in enumerate(candidates)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in strings(batch.column(0)):
                found = set(WORD.findall(text.lower()))
                stems = {w[:n] for w in found for n in STEM_LENGTHS if len(w) > n}
                keys = [*((w, False) for w in found), *((s, True) for s in stems)]
                rows.append(sorted(places[k] for k in keys if k in places))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["held"])

    # The toxic documents of the sample, each with its candidates.
    toxic_rows = sample.where("toxic = 1").select("_text", "toxic").mapInArrow(held, "held array<int>").collect()
    by_entry: dict[int, list[int]] = {}
    for row, r in enumerate(toxic_rows):
        for k in r.held:
            by_entry.setdefault(k, []).append(row)
    open_rows = np.ones(len(toxic_rows), dtype=bool)
    out: dict[tuple[str, bool], float] = {}
    for k, r in enumerate(candidates):  # strongest first
        rows = np.array(by_entry.get(k, []), dtype=np.int64)
        if open_rows[rows].sum() >= max(LEAST_TOXIC, r.o) or len(rows) >= COMMON_SHARE * len(toxic_rows):
            open_rows[rows] = False
            out[r.term, r.is_stem] = float(r.w)
    return out


def other_words(sample: DataFrame, entries: dict[tuple[str, bool], float]) -> frozenset[str]:
    """Words of the sample that are near an entry without being one, and not more frequent in its toxic documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(entries)
        for batch in batches:
            rows = []
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for word in set(WORD.findall(text.lower())):
                    match = automaton.match(word)
                    if match and match[0]:
                        rows.append({"word": word, "t": toxic, "o": 1 - toxic})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("word", pa.string()), ("t", pa.int64()), ("o", pa.int64())]))

    near = sample.select("_text", "toxic").mapInArrow(run, "word string, t long, o long").groupBy("word").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"))
    return frozenset(r.word for r in near.where("o >= t").collect())


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS) -> Model:
    """Learn lexicon and weights from the learning fold of the labelled documents."""
    bound_batches(df.sparkSession)
    known = (labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
             .where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic")))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Model({}, None, 0.0)

    def chosen(label: int, seed: int) -> Column:
        most = int(min(1.0, max_rows / counts[label]) * (1 << 30))
        return (F.col("toxic") == label) & (F.pmod(F.xxhash64(F.lit(seed), "label_id"), F.lit(1 << 30)) < most)

    picked = known.where(chosen(1, 11) | chosen(0, 12))
    # At most about 2 * max_rows ids, so the broadcast is bounded.
    sample = df.select(F.col(id_col), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), F.col(id_col) == F.col("label_id")).select("_text", "toxic")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, None, 0.0)
    entries = learn_lexicon(sample, sizes[1], sizes[0])
    others = other_words(sample, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(entries)
        for batch in batches:
            rows = _features(strings(batch.column(0)), automaton, others)
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())),
                 batch.column(1)], names=["f", "toxic"])

    got = sample.mapInArrow(run, "f array<double>, toxic int").toArrow()
    x = np.asarray(got.column("f").combine_chunks().flatten()).reshape(got.num_rows, -1)
    y = np.asarray(got.column("toxic")).astype(np.float64)
    by = np.lexsort((*x.T, y))
    # Each class counts as often as it is among all labelled rows of the fold.
    weight = np.where(y == 1, counts[1] / sizes[1], counts[0] / sizes[0])
    w, bias = fit_logistic(x[by], y[by], weight[by])
    return Model(entries, w, bias, others)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, rate: float = 0.1,
                 decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam; weights stay at or above zero but for ``quoted``."""
    total = weight.sum()
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log((weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    free = FEATURES.index("quoted")
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        slope = (p - y) * weight / total
        grad = np.append(x.T @ slope + decay * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w[:-1] = np.where(np.arange(len(w) - 1) == free, w[:-1], np.maximum(w[:-1], 0))
    return w[:-1], float(w[-1])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(model.entries)
        for batch in batches:
            if model.weights is None:
                scores = np.zeros(batch.num_rows)
            else:
                margin = _features(strings(batch.column(2)), automaton, model.others) @ model.weights + model.bias
                scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
            .mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"))
