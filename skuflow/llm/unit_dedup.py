"""Substring de-duplication by hashing lines, the sentences in them, and anchored word windows.

A text is cut into units at line breaks and after sentence ends, each unit is
normalised (lower case, single spaces) and digested to 128 bits (numpy, from prefix sums over the hashes of words). Digests are
grouped over all documents; the earliest ranked document (least id) keeps a
unit, every later occurrence is a repeat, as is a second occurrence within one
document. In each document, repeats that follow each other form a run, and runs
of at least ``min_words`` words are taken out.

Passages that begin or end inside a unit are found by windows of ``min_words``
words, whatever lines and sentences they lie in: of each ``GAP`` consecutive
places the one where a hash of the next three words is least is an anchor
(winnowing), and the window that begins there is digested and grouped like a
unit. As a place is chosen by the words around it alone, two texts that share
``min_words + GAP - 1`` words share an anchor, and all but at most ``GAP - 1``
words at either end of a shared passage are taken out.

With ``whole_lines``, a whole line that was there before goes whatever its
length: lines below ``min_words`` words are digested too, apart from units, so
that a sentence inside a line does not count as the line. Without it, repeats
below ``min_words`` words ("All rights reserved.") stay. Scripts without spaces
between words are measured in characters, two to a word. Removed spans keep
their character offsets in the original text.

Shuffles carry a digest and a rank per distinct unit of a document; the group
aggregate (a minimum and a count) is combined before its shuffle, so a unit that
every document holds adds one row per task. The join back to the units is
an equi-join that adaptive execution splits at such a digest. Only digests
that a document has to drop meet its text again.

Defined cases: a null text stays null and has no units; an empty text has none;
ids must be integers, rows with a null id rank last, among each other by a hash
of their text; rows with equal ids count as one document; further columns are
dropped by ``remove_repeats`` (but see ``keep``); an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches, text_slices
from skuflow.llm.words import _power_table, mix

MIN_WORDS = 13
GAP = 13  # not above MIN_WORDS: windows that begin at neighbouring anchors leave no word between them
BREAK = re.compile(r"(?<=[.!?])[^\S\n]+|\s*\n\s*|(?<=[。！？｡])")
LINE = re.compile(r"[^\n]+")
# Thai, Lao, Burmese, Khmer, kana and Han: no spaces between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_LETTER = re.compile(f"[{UNSPACED}]")
PLACE = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
WORD = re.compile(r"\S+")
UNSPACED_MARK = re.compile(f"[{UNSPACED}。！？｡]")
WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")
STOPS = np.frombuffer(b".!?", dtype=np.uint8)
SLICE_CHARS = 250_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True  # ASCII white space of str.split
_BASES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_BYTE = np.random.default_rng(20240301).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(parts: list[str]) -> int:
    """Words of a text cut at spaces; two letters of a script without spaces are a word."""
    found = [len(x) == 1 and bool(UNSPACED_LETTER.match(x)) for p in parts for x in PLACE.findall(p)]
    return len(found) - sum(found) + (sum(found) + 1) // 2


@dataclass
class Marks:
    """Digested stretches of ``n`` texts: text, first word, word after the last, and two 64-bit halves of the digest."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    h1: np.ndarray
    h2: np.ndarray

    def of(self, k: int) -> list[tuple[int, int, tuple[int, int]]]:
        """``(begin, end, digest)`` of text ``k`` in order (texts ascend)."""
        a, b = np.searchsorted(self.text, [k, k + 1])
        pairs = zip(self.h1[a:b].tolist(), self.h2[a:b].tolist(), strict=True)
        return list(zip(self.begin[a:b].tolist(), self.end[a:b].tolist(), pairs, strict=True))


class Hashed:
    """Words of some texts: two hashes each, prefix sums of both for digests of any stretch of words.

    Words are cut at white space and lower case, as ``str.lower`` and ``str.split`` give them."""

    def __init__(self, texts: list[str]):
        coded = [t.encode() for t in map(_plain, texts)]
        data = np.frombuffer(b"\n".join([*coded, b""]), dtype=np.uint8)
        edges = np.cumsum([len(c) + 1 for c in coded])
        inside = ~_SPACE[data]
        self.begin = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) if len(data) else np.empty(0, np.int64)
        end = np.flatnonzero(~inside & np.r_[False, inside[:-1]]) if len(data) else self.begin
        self.text = np.searchsorted(edges, self.begin, "right")
        self.first = np.searchsorted(self.begin, np.r_[0, edges])
        lines = np.cumsum(data == 10)[self.begin] if len(data) else self.begin
        self.new_line = np.ones(len(self.begin), dtype=bool)
        self.new_line[1:] = lines[1:] != lines[:-1]
        self.stop = np.isin(data[end - 1], STOPS) if len(data) else self.new_line
        self.sums, self.hash = [], None
        length = (end - self.begin).astype(np.uint64)
        for base, table in zip(_BASES, _BYTE, strict=True):
            run = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(table[data] * _power_table(base, len(data))[:len(data)], out=run[1:])
            raw = (run[end] - run[self.begin]) * _power_table(_inverse(base), len(data))[self.begin]
            word = mix(raw + length * np.uint64(0xD6E8FEB86659FD93))
            total = np.zeros(len(word) + 1, dtype=np.uint64)
            np.cumsum(word * _power_table(base, len(word))[:len(word)], out=total[1:])
            self.sums.append(total)
            self.hash = word if self.hash is None else self.hash

    def digest(self, begin: np.ndarray, end: np.ndarray, seed: int) -> list[np.ndarray]:
        """Both halves of the digests of the words ``begin`` to ``end`` (exclusive), different for each ``seed``."""
        salt = (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return [mix(mix((t[end] - t[begin]) * _power_table(_inverse(base), len(t))[begin]) + salt).view(np.int64)
                for base, t in zip(_BASES, self.sums, strict=True)]

    def marks(self, begin: np.ndarray, end: np.ndarray, seed: int) -> Marks:
        return Marks(self.text[begin], begin, end, *self.digest(begin, end, seed))

    def anchors(self, ends: np.ndarray, gap: int) -> Marks:
        """Windows from each anchor ``k`` to ``ends[k]``; places without a window have ``ends`` of -1."""
        at = np.flatnonzero(ends >= 0)
        if not len(at):
            return self.marks(at, at, 2)
        value = self.hash.copy()
        for j in range(1, min(3, gap)):
            value[:len(value) - j] += self.hash[j:] * np.uint64(2 * j + 1)
        value = mix(value) >> np.uint64(32) << np.uint64(32) | np.arange(len(value), dtype=np.uint64)
        return self.marks(k := _least(value[at], self.text[at], gap).astype(np.int64), ends[k], 2)


def _least(value: np.ndarray, text: np.ndarray, gap: int) -> np.ndarray:
    """Places (lower halves of ``value``) of the least value of each ``gap`` neighbours of a text, or of all, if fewer."""
    width, least, found = 1, value, []
    if len(value) >= gap:
        while width < gap:  # of twice as many neighbours each time, at last of ``gap``
            more = min(width, gap - width)
            least, width = np.minimum(least[:len(least) - more], least[more:]), width + more
        found.append(least[text[:len(text) - gap + 1] == text[gap - 1:]])
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    few = np.diff(np.r_[starts, len(text)]) < gap
    found.append(np.minimum.reduceat(value, starts)[few])
    return np.unique(np.concatenate(found) & np.uint64(0xFFFFFFFF))


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _plain(text: str) -> str:
    """Lower case, with ASCII white space only."""
    return text.lower() if text.isascii() else WIDE_SPACE.sub(" ", text.lower())


def units(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, end, words, words joined)`` of each unit; a unit ends where the next one starts."""
    starts, out = [0, *(m.end() for m in BREAK.finditer(text))], []
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        parts = text[a:b].lower().split()
        if parts:
            out.append((a, b, _words(parts), " ".join(parts)))
        elif out:
            out[-1] = (out[-1][0], b, *out[-1][2:])
    return out


def lines(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, end, words, words joined)`` of each line, without white space around it."""
    found = [(m.start(), m.end(), m.group()) for m in LINE.finditer(text) if not m.group().isspace()]
    return [(a + len(t) - len(t.lstrip()), b - len(t) + len(t.rstrip()), _words(parts), " ".join(parts))
            for a, b, t in found if (parts := t.lower().split())]


@dataclass
class Digested:
    """Digests of texts (of which some are None): by spaced words, or per text where a script without spaces is in it."""

    texts: list[str | None]
    numbers: list[int]  # places in ``texts`` of those that ``words`` holds
    words: Hashed
    units: Marks
    lines: Marks
    windows: Marks
    odd: dict[int, tuple[list, list, list]]  # place in ``texts`` -> units, short lines, windows as in ``spans_to_remove``

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in texts, h1, h2)``, each digest once per text."""
        number = np.array(self.numbers, dtype=np.int64)
        every = [(number[m.text], m.h1, m.h2) for m in (self.units, self.lines, self.windows)]
        for k, found in self.odd.items():
            pairs = [x[-1] for part in found for x in part]
            h = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            every.append((np.full(len(h), k), h[:, 0], h[:, 1]))
        text, h1, h2 = (np.concatenate(x) for x in zip(*every, strict=True))
        order = np.lexsort((h1, text))
        text, h1, h2 = text[order], h1[order], h2[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (h1[1:] != h1[:-1])
        return text[new], h1[new], h2[new]

    def spans(self, drop: list[list[int] | None], min_words: int) -> list[list[tuple[int, int]]]:
        """Spans to remove of each text; ``drop``: first halves of digests that an earlier text holds."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.texts]
        for k, found in self.odd.items():
            places = [m.span() for m in PLACE.finditer(self.texts[k])]
            out[k] = spans_to_remove(self.texts[k], set(drop[k] or ()), min_words, *found, places)
        touched = set()
        for m in (self.units, self.lines, self.windows):
            order = np.lexsort((m.h2, m.h1, m.text))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = ((m.text[order[1:]] == m.text[order[:-1]]) & (m.h1[order[1:]] == m.h1[order[:-1]])
                         & (m.h2[order[1:]] == m.h2[order[:-1]]))
            touched.update(m.text[order[again]].tolist())
        for n, k in enumerate(self.numbers):
            if drop[k] or n in touched:
                text = self.texts[k]
                places = [m.span() for m in WORD.finditer(text)]
                zero = int(self.words.first[n])
                units = self.units.of(n)
                starts = [places[a - zero][0] for a, _, _ in units]
                if units and "\n" not in text[:starts[0]]:
                    starts[0] = 0
                units = [(s, e, b - a, d) for s, e, (a, b, d) in zip(starts, [*starts[1:], len(text)], units, strict=True)]
                lines = [(places[a - zero][0], places[b - 1 - zero][1], d) for a, b, d in self.lines.of(n)]
                windows = [(a - zero, b - zero, d) for a, b, d in self.windows.of(n)]
                out[k] = spans_to_remove(text, set(drop[k] or ()), min_words, units, lines, windows, places)
        return out


def digested(texts: list[str | None], min_words: int, whole_lines: bool) -> Digested:
    """Units, lines below ``min_words`` words (if asked for) and anchored windows of texts, with their digests."""
    numbers, odd, gap = [], {}, min(GAP, min_words)
    for k, t in enumerate(texts):
        if not t:
            continue
        if t.isascii() or not UNSPACED_MARK.search(t):
            numbers.append(k)
            continue
        parts, whole = PLACE.findall(t.lower()), units(t)
        short = [x for x in lines(t) if x[2] < min_words] if whole_lines else []
        own = [Hashed([x[-1] for x in part]) for part in (whole, short)] + [Hashed([" ".join(parts)])]
        pairs = [list(zip(*(h.tolist() for h in w.digest(w.first[:-1], w.first[1:], seed)), strict=True)) for seed, w in enumerate(own[:2])]
        halves = np.cumsum([0, *(1 if UNSPACED_LETTER.match(p) else 2 for p in parts)])
        ends = np.searchsorted(halves, halves[:-1] + 2 * min_words)
        windows = own[2].anchors(np.where(ends <= len(parts), ends, -1), gap)
        odd[k] = ([(a, b, n, d) for (a, b, n, _), d in zip(whole, pairs[0], strict=True)],
                  [(a, b, d) for (a, b, _, _), d in zip(short, pairs[1], strict=True)], windows.of(0))
    w = Hashed([texts[k] for k in numbers])
    total = len(w.text)
    new_unit = w.new_line | np.r_[True, w.stop[:-1]] if total else w.new_line
    begin = np.flatnonzero(new_unit)
    sentences = w.marks(begin, np.r_[begin[1:], total], 0)
    begin = np.flatnonzero(w.new_line)
    end = np.r_[begin[1:], total]
    short = (end - begin < min_words) & whole_lines
    few = w.marks(begin[short], end[short], 1)
    ends = np.arange(total) + min_words
    fits = ends <= w.first[w.text + 1]
    return Digested(texts, numbers, w, sentences, few, w.anchors(np.where(fits, ends, -1), gap), odd)


def rank(id_col: Column, text: Column) -> Column:
    late = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(id_col.cast("long"), late)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    yield from text_slices(["" if t is None else t for t in texts], SLICE_CHARS)


def repeats(ranked: DataFrame, min_words: int = MIN_WORDS, whole_lines: bool = False) -> DataFrame:
    """``(rank, drop)``: halves of the digests that a document of ``(rank, text)`` has to drop."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column(0).to_numpy()
            for start, part in _slices(batch.column(1).to_pylist()):
                text, h1, h2 = digested(part, min_words, whole_lines).digests()
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(ranks[start + text])], names=["h1", "h2", "rank"])

    found = ranked.mapInArrow(run, "h1 long, h2 long, rank long")
    groups = (found.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
              .where("first < last").drop("last"))
    late = found.join(groups, ["h1", "h2"]).where("rank > first")
    return late.groupBy("rank").agg(F.collect_list("h1").alias("drop"))


def spans_to_remove(text: str, drop: set[int], min_words: int, units: list[tuple[int, int, int, tuple[int, int]]],
                    lines: list[tuple[int, int, tuple[int, int]]], windows: list[tuple[int, int, tuple[int, int]]],
                    places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of repeated units, repeated windows and repeated whole lines, as character offsets.

    ``units`` and ``lines`` have character offsets, ``windows`` numbers of ``places``, the offsets of words."""
    seen: set[tuple[int, int]] = set()

    def again(digest: tuple[int, int]) -> bool:
        known = digest in seen or digest[0] in drop
        seen.add(digest)
        return known

    spans: list[tuple[int, int]] = []
    start = end = words = 0
    for a, b, n, digest in [*units, (0, 0, 0, None)]:
        if digest and again(digest):
            start, end, words = (start if words else a), b, words + n
            continue
        if words and words >= min_words:
            spans.append((start, end))
        words = 0
    gone = [(a, b) for a, b, digest in lines if again(digest)]
    at = 0
    for a, b, _, _ in units if gone else ():  # a line goes with the break after it, which its last unit holds
        while at < len(gone) and gone[at][1] <= a:
            at += 1
        if at < len(gone) and gone[at][0] < b:
            spans.append((a, b))
    ends: dict[tuple[int, int], int] = {}
    for a, b, digest in windows:
        if digest[0] in drop:
            pass
        elif digest in ends:  # the words of the first occurrence stay
            a = max(a, ends[digest])
        else:
            ends[digest] = b
            continue
        if a < b:
            stop = places[b - 1][1]
            while stop < len(text) and text[stop] != "\n" and text[stop].isspace():
                stop += 1
            spans.append((places[a][0], stop))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shortened(df: DataFrame, id_col: str, text_col: str, min_words: int, keep: tuple[str, ...], whole_lines: bool) -> DataFrame:
    """``(_0, _1, ..., _text, removed)``: id, kept columns, the text without later occurrences, the removed spans."""
    bound_batches(df.sparkSession)
    at = rank(F.col(id_col), F.col(text_col))
    dropped = repeats(df.select(at.alias("rank"), F.col(text_col).alias("text")), min_words, whole_lines)
    columns = [F.col(id_col).alias("_0"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep, 1)),
               at.alias("_rank"), F.col(text_col).alias("_text")]
    joined = df.select(*columns).join(dropped, F.col("_rank") == F.col("rank"), "left").drop("_rank", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, drops = [], [], batch.column("drop").to_pylist()
            given = batch.column("_text").to_pylist()
            found = [spans for start, part in _slices(given)
                     for spans in digested(part, min_words, whole_lines).spans(drops[start:start + len(part)], min_words)]
            for text, spans in zip(given, found, strict=True):
                if spans:
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                texts.append(text)
                removed.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(texts, pa.string()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=[*batch.schema.names[:-2], "_text", "removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    done = joined.mapInArrow(run, f"{kinds}, _text string, removed array<struct<start:int,end:int>>")
    return done


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   keep: tuple[str, ...] = (), whole_lines: bool = False) -> DataFrame:
    """``(id, *keep, text, removed)``: the text without later occurrences, and the removed spans of the original."""
    done = _shortened(df, id_col, text_col, min_words, keep, whole_lines)
    return done.select(F.col("_0").alias(id_col), *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep, 1)),
                       F.col("_text").alias(text_col), "removed")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                    whole_lines: bool = False) -> DataFrame:
    """The rows of ``df`` with shortened texts, other columns unchanged."""
    others = tuple(c for c in df.columns if c not in (id_col, text_col))
    done = _shortened(df, id_col, text_col, min_words, others, whole_lines)
    place = {id_col: "_0", text_col: "_text"} | {c: f"_{i}" for i, c in enumerate(others, 1)}
    return done.select(*[F.col(place[c]).alias(c) for c in df.columns])
