"""Collocations: phrases of several words, scored by how much they outnumber chance.

Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends,
pieces into words at spaces and tabs; everything is counted per language.

* Words are counted exactly. Those that reach ``min_count`` get dense numbers, and
  each text becomes an array of numbers with 0 for a rarer word or a border
  between pieces: no phrase that reaches ``min_count`` holds a 0. The arrays are
  written once (``DICTIONARY`` words are broadcast at a time; a larger vocabulary
  is numbered in several passes).
* Level by level, the frequent phrases of k - 1 words are packed into a
  double-array trie and broadcast. Numpy advances the states of all positions
  of a stretch of text together, one word at a time. A position whose state
  accepts, and whose neighbour's does, holds an Apriori-safe candidate of k
  words: accepting state and next word. The candidates' cells are counted by a
  bincount over those that occur (the product of states and words would grow
  with the square of the vocabulary), and Spark sums the counts of all shards.
  Candidates that reach ``min_count`` are the next level's trie.
* A trie holds at most ``TRIE_PHRASES`` phrases. More of them are packed into several
  tries by a hash of the phrase, one pass over the arrays each; then only the first k - 1
  words of a candidate are asked to be frequent, which finds the same phrases.
* Scores come from joins of the frequent phrases with their parts. A phrase that a
  longer one explains is found among those one word longer: a phrase never occurs
  more often than its parts, so if a longer one occurs as often, so does one in
  between.

Per language the driver's report is the first ``top`` rows by score; ranks come from
a window over the first ``top`` of each of ``SALT`` parts of a language.

Defined cases: a null or empty text has no words; a null language counts as
``und`` (with a language of that name); repeated rows count as often as they are
there; ids are not looked at; further columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches, staged, text_slices
from skuflow.llm.double_array import DoubleArray, pack

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
DICTIONARY = 500_000
TRIE_PHRASES = 1_000_000
SALT = 32
STRETCH = 500_000
COUNTED = 150_000
SLICE_CHARS = 1_000_000
ROWS = 65_536

_BORDER = b"\xff"  # no byte of a UTF-8 text
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BORDER * 10)
_COUNTS = "a long, b long, c long, f long"


def words(texts: list[str]) -> list[bytes]:
    """Words of the texts in order; ``_BORDER`` stands between pieces."""
    joined = _BORDER.join(t.encode() for t in texts)
    return joined.translate(_CLEAN).replace(_BORDER, b" " + _BORDER + b" ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    groups: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            groups.setdefault(lang, []).append(text)
    for lang, group in groups.items():
        for _, part in text_slices(group, SLICE_CHARS):
            yield lang, part


def word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of ``(lang, text)``."""
    def rows(found: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in found.items() for _ in range(len(c))]
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([w.decode() for c in found.values() for w in c], pa.string()),
             pa.array([n for c in found.values() for n in c.values()], pa.int64())], names=["lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, group in _by_lang(batch):
                counter = found.setdefault(lang, Counter())
                counter.update(words(group))
                counter.pop(_BORDER, None)
                if sum(map(len, found.values())) > COUNTED:
                    yield rows(found)
                    found = {}
        yield rows(found)

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def number_words(frequent: DataFrame) -> list[DataFrame]:
    """The frequent words ``(lang, word, f)`` in blocks of about ``DICTIONARY``, with a number from 1."""
    spark = frequent.sparkSession
    frequent = staged(frequent, "frequent-words")
    blocks = -(-frequent.count() // DICTIONARY)
    block = F.pmod(F.xxhash64("lang", "word"), F.lit(max(1, blocks))).cast("int")
    sizes = {r.block: r.n for r in frequent.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out, used = [], 0
    for b in range(blocks):
        found = sorted(frequent.where(block == b).collect(), key=lambda r: (r.lang, r.word.encode()))
        out.append(spark.createDataFrame([(used + i, r.lang, r.word, r.f) for i, r in enumerate(found, 1)],
                                         "id long, lang string, word string, f long"))
        used += sizes.get(b, 0)
    return out


def encode(texts: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """``ids``: stretches of word numbers as little-endian 32-bit integers, 0 for rarer words and borders."""
    spark = texts.sparkSession
    coded = texts.select("lang", "text", F.lit(None).cast("binary").alias("ids"))
    for k, block in enumerate(blocks):
        table: dict[str, dict[bytes, int]] = {}
        for r in block.collect():
            table.setdefault(r.lang, {})[r.word.encode()] = r.id
        shared, last = spark.sparkContext.broadcast(table), k == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if last and k == 0:  # the usual case: one block, whole stretches of a language at once
                    for lang, group in _by_lang(batch):
                        yield _stretch([lang], [None], _ids(words(group), shared.value.get(lang, {})))
                    continue
                for lang, text, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    found = _ids(words([text or ""]), shared.value.get(lang, {}))
                    if ids is not None:
                        found = np.maximum(found, np.frombuffer(ids, dtype="<i4"))
                    yield _stretch([lang], [None if last else text], found)

        coded = staged(coded.mapInArrow(run, "lang string, text string, ids binary"), "word-ids")
    return coded.select("ids")


def _ids(found: list[bytes], table: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(table.get, found, repeat(0)), dtype="<i4", count=len(found))


def _stretch(lang: list[str], text: list[str | None], ids: np.ndarray) -> pa.RecordBatch:
    if text == [None]:
        ids = ids[(ids > 0) | np.r_[False, ids[:-1] > 0]] if len(ids) else ids  # one 0 is border enough
    return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(text, pa.string()), pa.array([ids.tobytes()], pa.binary())],
                                      names=["lang", "text", "ids"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Joined arrays of about ``STRETCH`` numbers, 0 between texts."""
    held, size = [], 0
    for batch in batches:
        for ids in batch.column(0).to_pylist():
            held += [np.frombuffer(ids, dtype="<i4"), np.zeros(1, dtype="<i4")]
            size += len(held[-2])
            if size >= STRETCH:
                yield np.concatenate(held).astype(np.int64)
                held, size = [], 0
    if held:
        yield np.concatenate(held).astype(np.int64)


def _cells(state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(state, word, count)`` of the cells state x word that occur."""
    key, place = np.unique(state << 32 | word, return_inverse=True)
    return key >> 32, key & 0xFFFFFFFF, np.bincount(place, minlength=len(key))


def _counted(phrase: np.ndarray, phrases: np.ndarray, word: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the phrases ``phrases[phrase]`` and a word more, with their counts."""
    k = phrases.shape[1]
    for i in range(0, len(counts), ROWS):
        rows = slice(i, i + ROWS)
        wide = np.zeros((len(counts[rows]), 6), dtype=np.int64)
        wide[:, :k], wide[:, k] = phrases[phrase[rows]], word[rows]
        yield pa.RecordBatch.from_arrays([*(pa.array(wide[:, j] << 32 | wide[:, j + 1]) for j in (0, 2, 4)),
                                          pa.array(counts[rows].astype(np.int64))], names=["a", "b", "c", "f"])


def phrase_words(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Word numbers of packed phrases, one row each."""
    return np.stack([a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF, c >> 32], axis=1)


def trie_of(phrases: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of distinct phrases of equal length, and the cell at which each ends."""
    order = np.lexsort(phrases.T[::-1])
    ranked = phrases[order]
    parent, code, node, count = [np.array([-1])], [np.array([0])], np.zeros(len(ranked), dtype=np.int64), 1
    for word in ranked.T:
        new = np.ones(len(ranked), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
        parent.append(node[new])
        code.append(word[new])
        node = count + np.cumsum(new) - 1
        count += int(new.sum())
    trie = pack(np.concatenate(parent), np.concatenate(code))
    cell = np.empty(len(ranked), dtype=np.int64)
    cell[order] = trie.cell[node]
    return trie, cell


def count_level(coded: DataFrame, shorter: DataFrame, k: int, min_count: int, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """Frequent phrases of ``k`` words ``(a, b, c, f)``, from those of ``k - 1`` words."""
    spark = coded.sparkSession
    blocks = max(1, -(-shorter.count() // trie_phrases))
    block = F.pmod(F.xxhash64("a", "b", "c"), F.lit(blocks)).cast("int")
    made = None
    for n in range(blocks):
        rows = shorter.where(block == n).select("a", "b", "c").toPandas()
        if rows.empty:
            continue
        phrases = phrase_words(*(rows[x].to_numpy(np.int64) for x in "abc"))[:, :k - 1]
        trie, cell = trie_of(phrases)
        phrase_at = np.full(len(trie.check), -1, dtype=np.int64)
        phrase_at[cell] = np.arange(len(phrases))
        shared = spark.sparkContext.broadcast((trie, phrase_at, phrases))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, phrase_at, phrases = shared.value
            for ids in _stretches(batches):
                at = np.flatnonzero(ids > 0)
                state = np.zeros(len(at), dtype=np.int64)
                for d in range(k - 1):
                    reach = at + d < len(ids)
                    at, state = at[reach], state[reach]
                    state = trie.step(state, ids[at + d])
                    at, state = at[state >= 0], state[state >= 0]
                accepted = np.zeros(len(ids) + 1, dtype=bool)
                accepted[at] = True
                ahead = at + k - 1
                more = ahead < len(ids)
                # With one trie both ends of a candidate are known to be frequent.
                more &= accepted[at + 1] if blocks == 1 else ids[np.minimum(ahead, len(ids) - 1)] > 0
                phrase, word, count = _cells(phrase_at[state[more]], ids[ahead[more]])
                yield from _counted(phrase, phrases, word, count)

        found = coded.mapInArrow(run, _COUNTS)
        made = found if made is None else made.unionByName(found)
    if made is None:
        return spark.createDataFrame([], _COUNTS)
    return staged(made.groupBy("a", "b", "c").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), f"phrases-{k}")


def _part(start: int, end: Column | int) -> Column:
    """The packed words ``start`` to ``end`` (exclusive) of the array ``ids``, as a struct."""
    at = lambda i: F.when(F.lit(start + i) < end, F.get("ids", F.lit(start + i))).otherwise(F.lit(0).cast("long"))
    pair = lambda i: F.shiftleft(at(i), 32).bitwiseOR(at(i + 1))
    return F.struct(pair(0).alias("a"), pair(2).alias("b"), F.shiftleft(at(4), 32).alias("c"))


# floor(1000 * a * n / (l * r)) of positive counts in decimals of 38 digits.
SCORE = ("(CAST({a} AS DECIMAL(17,0)) * CAST({n} AS DECIMAL(16,0)) * 1000BD)"
         " DIV (CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0)))")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` collocations."""
    spark = df.sparkSession
    bound_batches(spark)
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = staged(word_counts(texts), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    blocks = number_words(counts.where(F.col("f") >= min_count))
    if not blocks:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    dictionary = blocks[0]
    for b in blocks[1:]:
        dictionary = dictionary.unionByName(b)
    dictionary = staged(dictionary, "dictionary")
    coded = encode(texts, blocks)

    zero = F.lit(0).cast("long")
    levels = [dictionary.select(F.shiftleft("id", 32).alias("a"), zero.alias("b"), zero.alias("c"), "f")]
    for k in range(2, max_words + 1):
        levels.append(count_level(coded, levels[-1], k, min_count))
    return report(levels, dictionary, totals, top)


def report(levels: list[DataFrame], dictionary: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Scores, explained phrases out, ranks; ``levels``: frequent phrases by number of words, from 1."""
    every = None
    for k, level in enumerate(levels, 1):
        rows = level.select(F.struct("a", "b", "c").alias("key"), F.lit(k).alias("k"), "f", F.slice(F.array(
            *(F.shiftright(x, 32) if high else F.col(x).bitwiseAND(0xFFFFFFFF) for x in "abc" for high in (True, False))), 1, k).alias("ids"))
        every = rows if every is None else every.unionByName(rows)
    every = staged(every, "phrases")
    several = every.where("k > 1")
    explained = (several.where("k > 2").select(F.explode(F.array(_part(0, F.col("k") - 1), _part(1, F.col("k")))).alias("key"),
                                               F.col("f").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer")))
    kept = several.join(explained, "key", "left").where("longer IS NULL OR longer < f").drop("longer")
    lang_of = dictionary.select(F.col("id").alias("first_id"), "lang").join(totals, "lang")
    kept = kept.withColumn("first_id", F.element_at("ids", 1)).join(lang_of, "first_id")
    cuts = F.array(*(F.struct(F.lit(i).alias("cut"), _part(0, i).alias("left"), _part(i, F.col("k")).alias("right"))
                     for i in range(1, len(levels))))
    cut = kept.select("key", "ids", "lang", "n", "f", F.explode(F.slice(cuts, 1, F.col("k") - 1)).alias("x")).select(
        "key", "ids", "lang", "n", "f", "x.*")
    known = every.select("key", "f")
    cut = (cut.join(known.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
           .join(known.select(F.col("key").alias("right"), F.col("f").alias("r")), "right"))
    scored = cut.groupBy("key", "lang").agg(
        F.min(F.struct(F.expr(SCORE.format(a="f", n="n", l="l", r="r")).alias("score"), "cut", "l", "r")).alias("best"),
        F.first("ids").alias("ids"), F.first("f").alias("f"), F.first("n").alias("n"))
    spelled = (scored.select("key", "lang", "best", "f", "n", F.posexplode("ids").alias("at", "id"))
               .join(dictionary.select("id", "word"), "id").groupBy("key", "lang", "best", "f", "n")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    spelled = spelled.select("lang", "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"),
                             "n", F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    first = spelled.withColumn("part", part).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ph
          FROM split, range(1, 6) AS t(k) WHERE len(ws) >= k),
counted AS (SELECT lang, k, ph, count(*) AS f FROM grams GROUP BY lang, k, ph HAVING count(*) >= 100),
candidates AS (SELECT * FROM counted WHERE k > 1),
explained AS (SELECT lang, ph[1:k - 1] AS ph, f FROM candidates UNION ALL SELECT lang, ph[2:k], f FROM candidates),
longest AS (SELECT lang, ph, max(f) AS longer FROM explained GROUP BY lang, ph),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longest e ON e.lang = c.lang AND e.ph = c.ph WHERE e.longer IS NULL OR e.longer < c.f),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.ph, c.f AS a, x.f AS l, y.f AS r, t.n, c.cut, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counted x ON x.lang = c.lang AND x.ph = c.ph[1:c.cut] JOIN counted y ON y.lang = c.lang AND y.ph = c.ph[c.cut + 1:c.k]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
ranked AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM lowest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""
