"""Nearest neighbours by counting hash collisions, with query-centred windows.

Each of ``m`` hash functions is a single random projection. A block of vectors
keeps, per projection, its values in sorted order. For a query the window of
half width ``width / 2 * radius`` around the query's own projection is looked up
in each sorted array; virtual rehashing widens the windows by raising the
radius by the factor ``ratio``, and only what a wider window adds is counted. A
vector that collides in at least ``threshold`` of the projections is verified
with its exact distance, once. The search of a block ends when the k-th best
verified distance is within the radius (a vector at that distance collides in
each projection with probability P(|N| < width / 2) = 0.82, so one closer is
verified with probability above 0.99) or every vector is verified.

Index blocks hold about ``block`` vectors and query blocks about
``query_block`` queries; the stated query set meets all vectors block by block,
a task holds one block of each, and per query only k rows per block go on to the
final ranking. Every row is indexed.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows with a null id, take no part, neither as queries nor as
candidates; rows with equal ids count as one vector, the smallest in array
order; vectors of different lengths are not compared; ties go to the smaller id;
further columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuflow.llm.common import staged

PROJECTIONS = 32
THRESHOLD = 20
WIDTH = 2.7
RATIO = 1.2
BLOCK = 8192
QUERY_BLOCK = 1024
SEED = 7


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, vec, dim)`` as doubles, one row per id; see the module's defined cases."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("vec", lambda x: x != 0.0)
    return (df.select(F.col(id_col).alias("id"), v.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(~bad).where(nonzero)
            .groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec")))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, np.ascontiguousarray(flat.reshape(len(ids), -1), dtype=np.float64)


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int, seed: int):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], m))
        values = vectors @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)

    def distances(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))

    def first_radius(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Per query a radius to begin with: half the k-th distance above zero among a few vectors next to it on one projection."""
        at = np.searchsorted(self.sorted[:, 0], queries @ self.directions[:, 0])
        n, near, out = len(self.ids), 4 * k, []
        for q, i in zip(queries, at, strict=True):
            lo = max(0, min(int(i) - near, n - 2 * near))
            d = np.sort(self.distances(q, self.order[lo:lo + 2 * near, 0]))
            d = d[np.searchsorted(d, d[min(k, len(d) - 1)], "left"):]
            out.append(next((x for x in d if x > 0), 1.0) / 2)
        return np.array(out)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: int, width: float,
               ratio: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(query id, ids, distances)`` of each query's k nearest found in the block."""
        n, m = self.order.shape
        centres = queries @ self.directions
        start = self.first_radius(queries, k)
        out = []
        for qi, query, centre, radius in zip(query_ids, queries, centres, start, strict=True):
            counts = np.zeros(n, dtype=np.int64)
            verified = self.ids == qi
            best_rows, best_d = np.empty(0, dtype=np.int64), np.empty(0)
            lo = hi = None
            while True:
                half = width / 2 * radius
                new_lo = [int(np.searchsorted(self.sorted[:, j], centre[j] - half, "left")) for j in range(m)]
                new_hi = [int(np.searchsorted(self.sorted[:, j], centre[j] + half, "right")) for j in range(m)]
                if lo is None:
                    added = [self.order[a:b, j] for j, (a, b) in enumerate(zip(new_lo, new_hi, strict=True))]
                else:
                    added = [self.order[a:b, j] for j in range(m) for a, b in ((new_lo[j], lo[j]), (hi[j], new_hi[j]))]
                lo, hi = new_lo, new_hi
                counts += np.bincount(np.concatenate(added), minlength=n)
                rows = np.flatnonzero((counts >= threshold) & ~verified)
                if len(rows):
                    verified[rows] = True
                    best_rows = np.concatenate([best_rows, rows])
                    best_d = np.concatenate([best_d, self.distances(query, rows)])
                    keep = np.lexsort((self.ids[best_rows], best_d))[:k]
                    best_rows, best_d = best_rows[keep], best_d[keep]
                if (len(best_d) == k and best_d[-1] <= radius) or verified.all() or all(
                        b - a == n for a, b in zip(lo, hi, strict=True)):
                    break
                radius *= ratio
            out.append((int(qi), self.ids[best_rows], best_d))
        return out


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_modulus: int = 100, k: int = 10,
            m: int = PROJECTIONS, threshold: int = THRESHOLD, width: float = WIDTH, ratio: float = RATIO,
            block: int = BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for ids divisible by ``query_modulus``, the k nearest other vectors found."""
    vectors = staged(usable_vectors(df, id_col, vector_col), "ann-vectors")
    queries = vectors.where(F.col("id") % query_modulus == 0)
    n, nq = vectors.count(), queries.count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(nq / query_block))
    at = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    query_at = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(query_blocks)).cast("int")
    index = vectors.select("id", "vec", "dim", at.alias("b"), F.explode(
        F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asked = queries.select("id", "vec", "dim", query_at.alias("qb"), F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids, matrix = _matrix(left)
            by_id = np.argsort(ids, kind="stable")
            query_ids, query_matrix = _matrix(right)
            found = Block(ids[by_id], matrix[by_id], m, seed).search(
                query_ids, query_matrix, k, min(threshold, m), width, ratio)
        return pa.table({
            "query_id": pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in found] or [np.empty(0)]), pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in found] or [np.empty(0)]), pa.int64()),
            "score": pa.array(np.concatenate([d for _, _, d in found] or [np.empty(0)]), pa.float64()),
        })

    local = (index.groupBy("dim", "b", "qb").cogroup(asked.groupBy("dim", "b", "qb"))
             .applyInArrow(search, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, query_modulus: int = 100, k: int = 10) -> pd.DataFrame:
    """Exact neighbours of a small table, to measure recall."""
    rows = []
    for q in np.flatnonzero(ids % query_modulus == 0):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        for rank, i in enumerate(np.lexsort((ids, d))[:k], 1):
            if np.isfinite(d[i]):
                rows.append((int(ids[q]), rank, int(ids[i]), float(d[i])))
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
