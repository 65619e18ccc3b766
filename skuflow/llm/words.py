"""Words and word shingles of a batch of texts, hashed with numpy.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]`` in the UTF-8 text,
ASCII letters in lower case. A word's hash is a polynomial over random values
per byte, taken from prefix sums, then mixed; a shingle's hash mixes those of
five words in a row. A text of one to four words has a single shingle, its
whole sequence of words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 19

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 3))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


@dataclass
class Words:
    """Words of ``n`` texts: hash and number of its text for each word, in order; first word of each text."""

    n: int
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a text column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts between consecutive offsets."""
    n = len(offsets) - 1
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return Words(n, np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(n + 1, np.int64))
    inside = ~_IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power_table(_BASE, len(data))[:len(data)], out=sums[1:])
    raw = (sums[end] - sums[begin]) * _power_table(_INVERSE, len(data))[begin]
    hashes = mix(raw + (end - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    first = np.searchsorted(begin, offsets)
    return Words(n, hashes, np.repeat(np.arange(n), np.diff(first)), first)


def shingles(w: Words, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of every shingle, texts ascending."""
    if not len(w.hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    count = np.diff(w.first)
    total = len(w.hashes)
    acc = np.zeros(total, dtype=np.uint64)
    for j in range(k):  # words beyond the text's end count as nothing
        part = w.hashes[j:] * _PLACE[j]
        same = w.text[j:] == w.text[:total - j]
        acc[:total - j] += np.where(same, part, _U(0))
    place = np.arange(total) - w.first[w.text]
    keep = place < np.maximum(count - k + 1, 1)[w.text]
    short = np.minimum(count, k).astype(np.uint64)[w.text]
    return w.text[keep], mix(acc[keep] + short[keep])
