"""Near-duplicate documents by BagMinHash signatures, banding and exact verification.

A document is the multiset of its five-word shingles; two documents are linked
if the weighted Jaccard similarity of their multisets (sum of the lesser counts
over sum of the greater) is at least 0.8.

**Signature.** Weights are discretised on the integers and each shingle has a
hierarchy of Poisson processes over its weight axis: one for the weights
[0, 1), then one for each dyadic interval [1, 2), [2, 4), [4, 8) ... with a
rate equal to the interval's length, seeded by shingle and interval. A point
has an arrival time, a position on the weight axis and a random component; it
counts for a document if its position lies below the shingle's count there. So
the points of a document are those of one common process cut at its counts, and
the earliest point of a component is the same for two documents with a
probability of exactly their weighted Jaccard similarity. A process of a
document stops as soon as its arrival time exceeds the latest of the
document's components, which most do after one point.

**Candidates.** ``BANDS`` bands of ``ROWS`` components; equal multisets are
collapsed first, so a bucket holds different texts only. In each bucket the
most central text (the one with the most company over all its buckets) is
paired with every other; pairs are verified on the counted shingles; linked
texts form components. Then pairs within a bucket that lie across two
components are examined as well, which finds links that the centres missed: an
upper bound of the shared shingles, from small histograms, is taken for all of
them block by block, and those that may reach 0.8 are verified. Inside a
component no further pair is needed: it can only link what is linked. There is
no cap on buckets, partners or candidates.

A pair at similarity 0.8 meets in some band with probability 0.99998, one at
0.9 practically always.

Shuffles carry band values, pairs and, for texts in a bucket with company, the
texts. Buckets are counted and their centres found by aggregates; joins on a
bucket or centre are equi-joins that adaptive execution splits where skewed.

Defined cases: null texts and texts without a word have the empty multiset;
they equal each other and no other text. ``class_id`` is the least id of the
class (null only if all its ids are null). Rows with equal ids are kept as rows
and may fall into different classes if their texts differ. Further columns are
dropped by ``near_duplicates`` and kept by ``keep_one``; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches, staged
from skuflow.llm.graph import components
from skuflow.llm.words import mix, shingles, slices, text_buffers, words

BANDS = 28
ROWS = 5
SIMILARITY = 0.8
SLICE = 1 << 19
CELLS = 256
FULL = 0xFFFF
BLOCK = 1024

_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) from 64 random bits."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def counted(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, shingle)`` in order, with counts."""
    by = np.lexsort((shingle, text))
    t, s = text[by], shingle[by]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return t[at], s[at], np.diff(np.append(at, len(t)))


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    """``(n, m)`` BagMinHash components (random bits of the earliest points) of counted shingles."""
    times, found = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    latest = np.full(n, np.inf)
    # One process per shingle and dyadic interval of the weight axis below its count.
    parts = [(text, shingle, np.zeros(len(text), np.int64), np.ones(len(text)), np.ones(len(text)))]
    low, level = 1, 1
    while True:
        more = count > low
        if not more.any():
            break
        inside = np.minimum(count[more] - low, low) / low
        parts.append((text[more], shingle[more], np.full(more.sum(), level), np.full(more.sum(), float(low)), inside))
        low, level = 2 * low, level + 1
    doc, seed, levels, rate, inside = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = mix(seed + levels.astype(np.uint64) * _U(0xA24BAED4963EE407))
    now, point = np.zeros(len(doc)), 0
    while len(doc):
        ahead = int(np.clip(8192 // len(doc), 1, 64))  # points per process and round
        numbers = (np.arange(point + 1, point + ahead + 1, dtype=np.uint64) * _U(0x9FB21C651E98DF25))
        point += ahead
        first = mix(seed[:, None] + numbers)
        # Added one after the other, so that a point's time does not depend on the round.
        arrival = np.cumsum(np.column_stack([now, -np.log(_uniform(first)) / rate[:, None]]), axis=1)[:, 1:]
        row, col = np.nonzero(arrival < latest[doc][:, None])
        first, when = first[row, col], arrival[row, col]
        second = mix(first ^ _U(0x8CB92BA72F3D8DD7))
        counts = _uniform(mix(second)) < inside[row]
        at = doc[row] * m + (second % _U(m)).astype(np.int64)
        at, when, second = at[counts], when[counts], second[counts]
        np.minimum.at(times, at, when)
        earliest = times[at] == when
        found[at[earliest]] = second[earliest]
        latest = times.reshape(n, m).max(axis=1)
        now = arrival[:, -1]
        live = now < latest[doc]
        doc, seed, rate, inside, now = doc[live], seed[live], rate[live], inside[live], now[live]
    return found.reshape(n, m)


def band_values(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 63-bit value per band, different bands never alike."""
    out = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out + sig[:, r::rows][:, :bands])
    return (mix(out + np.arange(bands, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)) >> _U(1)).astype(np.int64)


def _sketch(df: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(id, key, bag, bands)``: digest of the multiset and band values (none for the empty one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            bags, values, ends = [], [], [np.zeros(1, np.int32)]
            for i, j in slices(offsets, SLICE):
                t, s, c = counted(*shingles(words(data, offsets[i:j + 1])))
                sig = signatures(j - i, t, s, c, bands * rows)
                first = np.searchsorted(t, np.arange(j - i + 1))
                both = np.stack([s, c.astype(np.uint64)], axis=1)
                bags += [xxhash.xxh3_128_digest(both[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                some = np.diff(first) > 0
                values.append(band_values(sig[some], bands, rows).ravel())
                ends.append(np.where(some, bands, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(ends)), pa.int32()),
                                             pa.array(np.concatenate(values or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bags, pa.binary()), lists], names=["id", "key", "bag", "bands"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, key long, bag binary, bands array<long>")


def similarities(data: list[str], other: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of paired texts (1 for two empty ones)."""
    n = len(data)
    buf, offsets = text_buffers(pa.array(data + other, pa.string()))
    t, s, c = counted(*shingles(words(buf, offsets)))
    right = t >= n
    pair = np.where(right, t - n, t)
    by = np.lexsort((right, s, pair))
    p, s, c = pair[by], s[by], c[by]
    shared = np.flatnonzero((p[1:] == p[:-1]) & (s[1:] == s[:-1]))
    least = np.bincount(p[shared], np.minimum(c[shared], c[shared + 1]), minlength=n)
    total = np.bincount(p, c, minlength=n)
    return np.where(total > 0, least / np.maximum(total - least, 1), 1.0)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of bags whose texts are similar enough."""
    left = texts.select(F.col("bag").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("bag").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            sizes = np.diff(text_buffers(batch.column(2))[1]) + np.diff(text_buffers(batch.column(3))[1])
            for i, j in slices(np.concatenate([[0], np.cumsum(sizes)])):
                part = batch.slice(i, j - i)
                keep[i:j] = similarities(part.column(2).to_pylist(), part.column(3).to_pylist()) >= similarity
            yield batch.select([0, 1]).filter(pa.array(keep))

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(run, "a binary, b binary"))


def _histograms(texts: DataFrame) -> DataFrame:
    """``(bag, hist)``: counts of a text's shingles by ``CELLS`` parts of their hashes, as uint16 bytes.

    A cell that does not fit is given as the greatest value, which ``_across`` takes for "any number".
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = []
            for i, j in slices(offsets, SLICE):
                t, s = shingles(words(data, offsets[i:j + 1]))
                cell = t * CELLS + (s >> _U(32)).astype(np.int64) % CELLS
                rows = np.minimum(np.bincount(cell, minlength=(j - i) * CELLS), FULL).astype("<u2").reshape(j - i, CELLS)
                out += [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["bag", "hist"])

    return texts.select("bag", "text").mapInArrow(run, "bag binary, hist binary")


def _across(placed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of bags in one bucket, but of two components, that may be similar enough.

    ``placed``: (bucket, bag, label). Two multisets share at most the sum of the lesser counts of each cell of their
    histograms; where that bound is too low for ``similarity``, the pair needs no look at the texts. Only members outside
    a bucket's largest component are held against all others, in blocks of ``BLOCK`` by ``BLOCK``, and only pairs that
    pass the bound leave a task.
    """
    sizes = (placed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket")
             .agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("main")).where("all > main.n"))
    split = placed.join(sizes, "bucket").select(
        "bucket", "bag", "label", (F.col("label") != F.col("main.label")).alias("outside"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("outside_blocks"))
    split = staged(split, "bag-split")
    wanted = texts.join(split.select("bag").distinct(), "bag", "left_semi")
    rows = split.join(_histograms(wanted), "bag")
    every = rows.select("bucket", "bag", "label", "hist", F.pmod(F.xxhash64("bag"), "blocks").cast("int").alias("mb"),
                        F.explode(F.sequence(F.lit(0), F.col("outside_blocks") - 1)).alias("ob"))
    outside = rows.where("outside").select(
        *[F.col(c).alias(c) for c in ("bucket", "bag", "label", "hist")], F.pmod(F.xxhash64("bag"), "outside_blocks").cast("int").alias("ob"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mb"))

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            bags, labels = right.column("bag").to_pylist(), np.array(right.column("label").to_pylist(), dtype=object)
            hists = np.frombuffer(b"".join(right.column("hist").to_pylist()), dtype="<u2").reshape(-1, CELLS)
            sizes, unsure = hists.sum(axis=1, dtype=np.int64), (hists == FULL).any(axis=1)
            for bag, label, hist in zip(*(left.column(c).to_pylist() for c in ("bag", "label", "hist")), strict=True):
                own = np.frombuffer(hist, dtype="<u2")
                most = np.minimum(hists, own).sum(axis=1, dtype=np.int64)
                near = most >= similarity * (sizes + int(own.sum(dtype=np.int64)) - most)
                near = (near | unsure | bool((own == FULL).any())) & (labels != label)
                found += [(min(bag, bags[i]), max(bag, bags[i])) for i in np.flatnonzero(near)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    keys = ("bucket", "ob", "mb")
    return outside.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(pairs, "a binary, b binary").distinct()


def _classes(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int,
             similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, key, bag)`` and classes ``(bag, class_id, kept_key, kept_bag)``.

    ``key`` hashes the text; with the id it names a row up to repeats.
    """
    bound_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    sketches = staged(_sketch(docs, bands, rows), "bag-sketches")
    first = F.struct(F.col("id").isNull().alias("missing"), "id", "key")
    bags = staged(sketches.groupBy("bag").agg(F.min(first).alias("first"), F.first("bands").alias("bands")),
                  "bags")
    members = bags.select("bag", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    company = staged(members.join(sizes, "bucket"), "bag-buckets")
    links = None
    if not company.isEmpty():
        central = company.groupBy("bag").agg(F.sum("size").alias("central"))
        ranked = company.join(central, "bag")
        centres = ranked.groupBy("bucket").agg(F.max(F.struct("central", "bag")).alias("c")).select(
            "bucket", F.col("c.bag").alias("a"))
        wanted = bags.join(company.select("bag").distinct(), "bag").select("bag", "first.id", "first.key")
        texts = staged(docs.withColumnRenamed("id", "doc").withColumnRenamed("key", "doc_key")
                       .join(wanted, F.col("doc").eqNullSafe(F.col("id")) & (F.col("doc_key") == F.col("key")))
                       .select("bag", "text").dropDuplicates(["bag"]), "bag-texts")
        pairs = company.join(centres, "bucket").where("bag <> a").select("a", F.col("bag").alias("b")).distinct()
        linked = staged(_verified(pairs, texts, similarity), "bag-links")
        label = components(linked)
        placed = company.join(label, F.col("bag") == F.col("vertex"), "left").select(
            "bucket", "bag", F.coalesce("label", "bag").alias("label"))
        across = staged(_across(placed, texts, similarity), "bag-across")
        missed = staged(_verified(across, texts, similarity), "bag-missed")
        links = label if missed.isEmpty() else components(linked.unionByName(missed))
    if links is None:
        labelled = bags.select("bag", "first", F.col("bag").alias("label"))
    else:
        labelled = bags.join(links, F.col("bag") == F.col("vertex"), "left").select(
            "bag", "first", F.coalesce("label", "bag").alias("label"))
    kept = labelled.groupBy("label").agg(F.min(F.struct("first", "bag")).alias("kept"))
    classes = labelled.join(kept, "label").select(
        "bag", F.col("kept.first.id").alias("class_id"), F.col("kept.first.key").alias("kept_key"),
        F.col("kept.bag").alias("kept_bag"))
    return sketches.select("id", "key", "bag"), staged(classes, "bag-classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
                    similarity: float = SIMILARITY) -> DataFrame:
    """``(id, class_id, kept)`` for every row; ``kept`` marks the document of each class that stays."""
    members, classes = _classes(df, id_col, text_col, bands, rows, similarity)
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("kept_key"))
    return members.join(classes, "bag").select(F.col("id").alias(id_col), "class_id", kept.alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
             similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``df`` per class of near duplicates, columns unchanged."""
    _, classes = _classes(df, id_col, text_col, bands, rows, similarity)
    stays = classes.where("bag = kept_bag").select(F.col("class_id").alias("_kept_id"), F.col("kept_key").alias("_kept_key"))
    # One key of id and text for the join, so that what it deals out also serves to drop repeats of one and the same row.
    stays = stays.withColumn("_kept", F.xxhash64("_kept_id", "_kept_key"))
    # The row itself is one value, so that its columns may have any names.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    rows = df.select(whole, F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("key"))
    rows = rows.withColumn("row", F.xxhash64("id", "key"))
    same = (F.col("row") == F.col("_kept")) & F.col("id").eqNullSafe(F.col("_kept_id")) & (F.col("key") == F.col("_kept_key"))
    return rows.join(stays, same).dropDuplicates(["row", "_kept_id", "_kept_key"]).select("whole.*")
