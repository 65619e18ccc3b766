"""Packing documents into token sequences by patterns fitted with non-negative least squares.

A document is its token ids and an end id. Only documents longer than a sequence
are cut, into full pieces with the shorter piece first; a full piece is a
sequence of its own. What is left is a histogram of at most ``capacity`` piece
lengths, whatever the size of the corpus, and the plan is made from it alone:

* patterns: all pairs and triples of lengths that occur and fill a sequence up
  to ``SLACK`` tokens;
* repeat counts: the non-negative least squares fit of the patterns to the
  histogram, lengths weighted so that long pieces, which are hard to place,
  count more; solved by multiplicative updates, which never leave the
  non-negative range;
* rounding: running sums of ``FITTED_SHARE`` of the counts, rounded to integers, so
  that neighbouring patterns make up for each other's fractions, and cut to the
  pieces that are there; the share left out keeps pieces of all lengths back, with
  which the residuals fill up;
* residuals: best fit of the remaining lengths, longest first, on counts: equal
  lengths and equally filled sequences are handled together.

A plan is a list of patterns with their repeats. Each length's pieces are
numbered (per task first, then by running sums over the tasks' counts), and the
number says which pattern, which repeat and which offset a piece gets. So
neither plan nor numbering needs the pieces in one place, and a very frequent
length is spread over the tasks that hold it.

Ids are never stored, only lengths and checksums.

Defined cases: a null text is empty and has the end id alone; equal ids and
repeated rows are pieces of their own; a null id stays null; very long texts are
cut like others; further columns are dropped, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches, staged, strings

CAPACITY = 2048
END_ID = 0
SLACK = 4
UPDATES = 100
FITTED_SHARE = 0.85
# Characters that need not be of the same class in both libraries: all but Latin ones and common punctuation.
NOT_PLAIN = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ids:
    """Token ids of texts, as the ``tokenizers`` library gives them for the vocabulary.

    ``tiktoken`` holds the same vocabulary as ranks and the same pre-token pattern and is several times as
    fast; it encodes the texts of plain Latin characters (for which both libraries class characters alike)
    that do not hold the special token's string, ``tokenizers`` all others."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if NOT_PLAIN.search(text) or any(t in text for t in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def pieces(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut where longer than ``capacity``."""
    bound_batches(df.sparkSession)
    paths = vocabulary or default_vocabulary(), ranks or default_ranks()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Ids(*paths)
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(strings(batch.column(1))):
                ids = coder.encode(text) + end
                total = len(ids) // 4
                first = total % capacity or capacity
                edges = [0, *range(first, total + 1, capacity)]
                for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    row.append(i)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a:4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Pattern:
    """``repeats`` sequences of the same make-up: runs of ``(length, pieces)`` one after the other."""

    runs: tuple[tuple[int, int], ...]
    repeats: int


def few_piece_patterns(lengths: np.ndarray, capacity: int, slack: int = SLACK) -> np.ndarray:
    """Rows of three lengths, descending, zero for none: pairs and triples of ``lengths`` that fill a sequence."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    out = []
    for gap in range(slack + 1):
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        a, b = a[a >= b], b[a >= b]
        c = capacity - gap - a - b
        ok = (c == 0) | ((c > 0) & (c <= b) & have[np.clip(c, 0, capacity)])
        out.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
        if gap == 0 and len(out[0]) > 50 * len(lengths):
            break  # enough patterns without a gap
    return np.concatenate(out)


def fit(patterns: np.ndarray, counts: np.ndarray, capacity: int, updates: int = UPDATES) -> np.ndarray:
    """Non-negative repeats whose lengths come near ``counts`` in weighted least squares."""
    weight = np.arange(capacity + 1) / capacity
    weight[0] = 0.0
    wanted = weight * counts
    target = wanted[patterns].sum(axis=1)
    repeats = np.where(patterns > 0, counts[patterns], counts.max()).min(axis=1) / max(1.0, np.sqrt(len(patterns)))
    for _ in range(updates):
        made = np.bincount(patterns.ravel(), weights=np.repeat(repeats, 3), minlength=capacity + 1)
        repeats *= target / np.maximum((weight * made)[patterns].sum(axis=1), 1e-12)
    return repeats


def rounded(patterns: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> list[Pattern]:
    """Whole repeats that keep running sums, cut to the pieces ``left``, which are taken away."""
    whole = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(repeats)]) + 0.5)).astype(np.int64)
    out = []
    for k in np.flatnonzero(whole):
        lengths, need = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(int(whole[k]), int((left[lengths] // need).min()))
        if n:
            left[lengths] -= n * need
            runs = sorted(zip(lengths.tolist(), need.tolist(), strict=True), reverse=True)
            out.append(Pattern(tuple(runs), n))
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, of the pieces ``left`` by length; equal pieces and equal sequences together."""
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for length in range(len(left) - 1, 0, -1):
        count = int(left[length])
        while count:
            fits = [r for r in room if r >= length]
            if fits:
                space = min(fits)
                runs, have = room[space].pop()
                if not room[space]:
                    del room[space]
            else:
                space, runs, have = capacity, (), count
            each = min(space // length, count)
            n = min(have, count // each)
            if have > n and space != capacity:
                room.setdefault(space, []).append((runs, have - n))
            count -= n * each
            room.setdefault(space - each * length, []).append(((*runs, (length, each)), n))
    return [Pattern(runs, n) for group in room.values() for runs, n in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns with repeats that hold each length as often as ``histogram`` says."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = [Pattern(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    lengths = np.flatnonzero(left)
    patterns = few_piece_patterns(lengths, capacity) if len(lengths) else np.empty((0, 3), dtype=np.int64)
    if len(patterns):
        out += rounded(patterns, FITTED_SHARE * fit(patterns, left.astype(float), capacity), left)
    return out + best_fit(left, capacity)


class Places:
    """Sequence and offset of the n-th piece of a length under a plan."""

    def __init__(self, patterns: list[Pattern]):
        self.first: dict[int, list[int]] = {}
        self.slots: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for p in patterns:
            offset = 0
            for length, each in p.runs:
                self.first.setdefault(length, []).append(taken.get(length, 0))
                self.slots.setdefault(length, []).append((sequence, offset, each))
                taken[length] = taken.get(length, 0) + each * p.repeats
                offset += length * each
            sequence += p.repeats
        self.sequences = sequence
        self.tables = {k: (np.array(self.first[k]), np.array(v, dtype=np.int64)) for k, v in self.slots.items()}
        self.first, self.slots = {}, {}

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(order) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            size = int(length[at[0]])
            first, slots = self.tables[size]
            k = np.searchsorted(first, number[at], "right") - 1
            begin, start, each = slots[k].T
            rank = number[at] - first[k]
            sequence[at] = begin + rank // each
            offset[at] = start + size * (rank % each)
        return sequence, offset


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's number among those of its length in the task."""
    seen = np.zeros(0, dtype=np.int64)
    for batch in batches:
        length = batch.column("length").to_numpy()
        if len(length):
            if length.max() >= len(seen):
                seen = np.concatenate([seen, np.zeros(int(length.max()) + 1 - len(seen), dtype=np.int64)])
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0])
            group = np.cumsum(np.isin(np.arange(len(order)), cuts)) - 1
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order)) - cuts[group] + seen[length[order]]
            seen += np.bincount(length, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "number"])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(*columns, sequence_id, offset)`` of pieces with a ``length`` of 1 to ``capacity``."""
    spark = cut.sparkSession
    columns = cut.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    numbered = staged(cut.mapInArrow(_numbered, f"{fields}, number long").withColumn("part", F.spark_partition_id()), "pieces")
    counts = numbered.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row per task and length; a window per length sums over tasks, not over pieces.
    before = staged(counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("part", "length", F.coalesce("before", F.lit(0)).alias("before"), "n"), "piece-counts")
    histogram = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)],
                                             names=[*columns, "sequence_id", "offset"])

    joined = numbered.join(before.drop("n"), ["part", "length"]).select(*columns, (F.col("number") + F.col("before")).alias("number"))
    return joined.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of all documents."""
    return pack(pieces(df, capacity, id_col, text_col, vocabulary, ranks), capacity)
