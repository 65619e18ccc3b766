"""Quality classifier learnt from positives and unlabelled text.

The risk of a classifier g on positives P (trusted, label 1) and unlabelled web
text U with class prior p is  p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])
with the logistic loss l; the second term estimates the risk on the unseen
negatives and is kept from going below zero, as otherwise a flexible model
drives it there by memorising U. Where it is below zero, the step goes against
that term's gradient instead.

The model adds one weight per bin of each text statistic. Statistics are taken
over the whole text in Arrow batches with numpy; scoring is a single pass
without a shuffle.

Learning uses rows whose crc32 of the id (as text) modulo 3 is not 1: at most
about ``max_rows`` positives and ``max_rows`` unlabelled rows, picked by a hash
of the id; statistics of those rows alone reach the driver. The prior is the
share of label 1 among the labelled rows of that fold, counted over all of
them, or, where only positives are labelled, an estimate from the two samples;
it is kept between 0.02 and 0.98.

Defined cases: a null text counts as empty and is scored; rows with a null id
are scored, not learnt from and not held out; of several labels of an id the
largest counts, null labels are ignored; without positives every row scores
0.5; further columns are dropped by ``score`` and kept by ``keep_good``; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.common import bound_batches
from skuflow.llm.words import slices, text_buffers, words

MAX_ROWS = 20_000
BINS = 24
STEPS = 500
RATE = 0.2
DECAY = 1e-5
THRESHOLD = 0.5
FEW = 20
FOLDS, HELD_OUT = 3, 1

_CLASSES = {
    "upper": [*range(ord("A"), ord("Z") + 1)],
    "lower": [*range(ord("a"), ord("z") + 1)],
    "digit": [*range(ord("0"), ord("9") + 1)],
    "line": [10],
    "space": [9, 11, 12, 13, 32],
    "stop": [*b".,;:?"],
    "bang": [*b"!"],
    "bar": [*b"|"],
    "symbol": [*b"#$%&*@^~=<>{}[]\\/_+`"],
    "quote": [*b"\"'()-"],
    "other": [*range(128, 256)],
}
FEATURES = [*_CLASSES, "word_length", "repeat_next", "distinct_pairs", "words", "controls"]


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def held_out(id_col: Column) -> Column:
    return id_col.isNotNull() & (fold(id_col) == HELD_OUT)


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(column), len(FEATURES)), dtype=np.float32)
    for i, j in slices(offsets):
        off = offsets[i:j + 1] - offsets[i]
        part = data[offsets[i]:offsets[j]]
        size = np.maximum(np.diff(off), 1)

        def per_text(flags: np.ndarray, off=off) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, dtype=np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[off[1:]] - sums[off[:-1]]

        seen = np.zeros(j - i, dtype=np.int64)
        for f, members in enumerate(_CLASSES.values()):
            table = np.zeros(256, dtype=bool)
            table[members] = True
            got = per_text(table[part])
            seen += got
            out[i:j, f] = got / size
        w = words(data, offsets[i:j + 1])
        count = np.diff(w.first)
        n = np.maximum(count, 1)
        f = len(_CLASSES)
        out[i:j, f] = np.minimum(size / n, 100)
        if len(w.hashes) > 1:
            together = w.text[1:] == w.text[:-1]
            same = together & (w.hashes[1:] == w.hashes[:-1])
            out[i:j, f + 1] = np.bincount(w.text[1:][same], minlength=j - i) / n
            pair = (w.hashes[:-1] * np.uint64(3) + w.hashes[1:])[together]
            at = w.text[1:][together]
            by = np.lexsort((pair, at))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (at[by][1:] != at[by][:-1]) | (pair[by][1:] != pair[by][:-1])
            out[i:j, f + 2] = np.bincount(at[by][new], minlength=j - i) / np.maximum(count - 1, 1)
        out[i:j, f + 3] = np.log1p(count)
        out[i:j, f + 4] = (np.diff(off) - seen) / size
    return out


def statistics(df: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *extra, stats)`` with the statistics of each whole text."""
    bound_batches(df.sparkSession)
    picked = df.select(F.col(id_col).alias("id"), *extra, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_statistics(batch.column(batch.num_columns - 1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*batch.schema.names[:-1], "stats"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, stats array<float>")


@dataclass
class Model:
    """Bin edges and weights per statistic; ``prior`` is the class prior it was fitted with."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, stats[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def margin(self, stats: np.ndarray) -> np.ndarray:
        b = self.bins(stats)
        return self.bias + self.weights[np.arange(b.shape[1]), b].sum(axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(stats), -30, 30)))


def fit_nonnegative_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = BINS, steps: int = STEPS,
                       rate: float = RATE, decay: float = DECAY, plain: bool = False) -> Model:
    """Minimise the non-negative risk (see the module) by Adam over whole samples.

    ``plain``: tell positives from unlabelled rows instead.
    """
    both = np.concatenate([positive, unlabelled])
    q = np.linspace(0, 1, bins + 1)[1:-1]
    model = Model(np.quantile(both, np.concatenate([q, [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]]), axis=0).T.copy(),
                  np.zeros((both.shape[1], bins + 6)), float(np.log(prior / (1 - prior))), prior)
    model.edges.sort(axis=1)
    width = model.weights.shape[1]
    shift = np.arange(both.shape[1]) * width
    bp, bu = model.bins(positive) + shift, model.bins(unlabelled) + shift
    w = np.zeros(model.weights.size + 1)
    w[-1] = model.bias
    m, v = np.zeros_like(w), np.zeros_like(w)

    def back(cells: np.ndarray, slope: np.ndarray) -> np.ndarray:
        per_row = np.repeat(slope, cells.shape[1])
        return np.append(np.bincount(cells.ravel(), per_row, minlength=w.size - 1), slope.sum()) / len(cells)

    for step in range(1, steps + 1):
        gp, gu = w[-1] + w[bp].sum(axis=1), w[-1] + w[bu].sum(axis=1)
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad_negative = back(bu, su) - prior * back(bp, sp)
        if plain:
            grad = back(bp, sp - 1) + back(bu, su)
        else:
            grad = prior * back(bp, sp - 1) + grad_negative if negative >= 0 else -grad_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.weights, model.bias = w[:-1].reshape(model.weights.shape), float(w[-1])
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, tail: float = 0.1) -> float:
    """Class prior from positives and unlabelled rows alone.

    In any region, the unlabelled share is at least prior * the positives' share; the least ratio over the regions
    above a threshold of a positive-against-unlabelled classifier (holding all but ``tail`` of the positives or more)
    estimates it. The classifier is fitted on one half of the rows and the ratio taken on the other, both ways. With
    fewer than ``FEW`` rows of either kind there is no estimate, and 0.5 stands for it.
    """
    if min(len(positive), len(unlabelled)) < FEW:
        return 0.5
    found = []
    for half in (0, 1):
        model = fit_nonnegative_pu(positive[half::2], unlabelled[half::2], 0.5, steps=50, plain=True)
        p, u = (np.sort(model.margin(x[1 - half::2])) for x in (positive, unlabelled))
        at = p[: max(1, int(len(p) * tail))]
        above_p = 1 - np.searchsorted(p, at, "left") / len(p)
        above_u = 1 - np.searchsorted(u, at, "left") / max(len(u), 1)
        found.append((above_u / above_p).min())
    return float(np.mean(found))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on the learning fold; None if it has no positives."""
    known = (labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).dropna()
             .where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label")))
    counts = known.agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.count("*").alias("n")).first()
    if not counts["p"]:
        return None
    learn = df.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    total = learn.select(id_col).count()

    def share(seed: int, col: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col(col)), F.lit(1 << 30)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 30))

    trusted = known.where((F.col("label") == 1) & share(1, "label_id", counts["p"])).select("label_id")
    # At most about max_rows ids by the filter above, so the broadcast is bounded.
    marked = (learn.join(F.broadcast(trusted), F.col(id_col) == F.col("label_id"), "left")
              .withColumn("is_p", F.col("label_id").isNotNull()).withColumn("is_u", share(2, id_col, total))
              .where(F.col("is_p") | F.col("is_u")))
    rows = statistics(marked, id_col, text_col, ("is_p", "is_u")).select("is_p", "is_u", "stats").toArrow()
    if not rows.num_rows:
        return None
    stats = np.asarray(rows.column("stats").combine_chunks().flatten()).reshape(rows.num_rows, -1).astype(np.float64)
    is_p, is_u = np.asarray(rows.column("is_p")).astype(bool), np.asarray(rows.column("is_u")).astype(bool)
    if not is_p.any() or not is_u.any():
        return None
    by = np.lexsort(stats.T)  # the order in which tasks answer must not matter
    stats, is_p, is_u = stats[by], is_p[by], is_u[by]
    share_of_labels = counts["p"] / counts["n"]
    prior = share_of_labels if share_of_labels < 1 else estimate_prior(stats[is_p], stats[is_u])
    return fit_nonnegative_pu(stats[is_p], stats[is_u], min(max(prior, 0.02), 0.98))


def _scores(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(column), 0.5)
    return model.score(text_statistics(column).astype(np.float64))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(model, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col))
            .mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"))


def keep_good(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, columns unchanged."""
    bound_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at)) >= threshold))

    return df.mapInArrow(run, df.schema)
