"""Double-array tries in numpy: packing and walking.

A node sits in a cell; ``base[cell] + code`` is the cell of the child with that
code, provided that ``check`` names the parent there. Codes are positive dense
integers. Nodes with several children are placed first, those with most first,
by a first-fit search; only children fill the gaps that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_TRIALS = 1 << 18


@dataclass
class DoubleArray:
    """``base`` and ``check`` per cell, and the cell of each node given to ``pack``."""

    base: np.ndarray
    check: np.ndarray
    cell: np.ndarray

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The cells that ``code`` leads to from the cells ``state``; -1: no such child, or no state."""
        to = self.base[state] + code
        fits = (state >= 0) & (code > 0) & (to >= 0) & (to < len(self.check))
        to = np.where(fits, to, 0)
        return np.where(fits & (self.check[to] == state), to, -1)


def _first_fit(used: np.ndarray, codes: np.ndarray, low: int) -> tuple[np.ndarray, int, int]:
    """``(used, base, low)``: the first base at or after the free cell ``low`` at which all codes are free."""
    rows = max(1, _TRIALS // len(codes))
    while True:
        if low + rows + int(codes[-1]) + 1 > len(used):
            used = np.concatenate([used, np.zeros(len(used) + rows + int(codes[-1]), dtype=bool)])
        free = np.flatnonzero(~used[low:low + rows]) + low
        bases = free - int(codes[0])
        for part in np.array_split(bases, max(1, len(bases) * len(codes) // _TRIALS)):
            hit = np.flatnonzero(~used[part[:, None] + codes[None, :]].any(axis=1))
            if len(hit):
                base = int(part[hit[0]])
                return used, base, base + int(codes[0])
        low += rows


def pack(parent: np.ndarray, code: np.ndarray) -> DoubleArray:
    """Cells for nodes given by parent node and code; node 0 is the root, its parent is -1."""
    n = len(parent)
    kids = np.lexsort((code, parent))
    kids = kids[parent[kids] >= 0]
    heads, start, count = np.unique(parent[kids], return_index=True, return_counts=True)
    used = np.zeros(2 * n + int(code.max(initial=0)) + 2, dtype=bool)
    used[0] = True
    cell, base_of, low = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 1
    for g in np.argsort(-count, kind="stable"):
        if count[g] == 1:
            break
        group = kids[start[g]:start[g] + count[g]]
        used, base, low = _first_fit(used, code[group], low)
        cell[group] = base + code[group]
        used[cell[group]] = True
        base_of[heads[g]] = base
    single = count == 1
    only = kids[start[single]]
    free = np.flatnonzero(~used)[:len(only)]
    if len(free) < len(only):
        free = np.concatenate([free, len(used) + np.arange(len(only) - len(free))])
    cell[only] = free
    base_of[heads[single]] = free - code[only]
    size = int(cell.max(initial=0)) + 1
    base, check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    base[cell] = base_of
    check[cell[kids]] = cell[parent[kids]]
    return DoubleArray(base, check, cell)
