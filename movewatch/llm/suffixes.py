"""Suffix sort by hash comparison.

Two suffixes are compared by their longest common extension, which binary search over prefix hashes
finds in a logarithmic number of steps, and by the token behind it. The sort is a bottom-up mergesort
whose runs are seeded by the suffixes' first eight tokens; all merges of a level are done at once, each
suffix finding its rank in the sibling run by binary search.
"""

from __future__ import annotations

import numpy as np

from movewatch.llm.windows import PrefixHashes

SEED = 8


class SuffixOrder:
    """Orders suffixes (start places in ``data``, bytes) by their first ``depth`` tokens within groups."""

    def __init__(self, data: np.ndarray, hashes: PrefixHashes, depth: int):
        self.data, self.hashes, self.depth = data, hashes, depth

    def _seed(self, starts: np.ndarray) -> np.ndarray:
        key = np.zeros(len(starts), np.uint64)
        for i in range(min(SEED, self.depth)):
            key = key << np.uint64(8) | self.data[starts + i]
        return key

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many tokens, up to the depth, the suffixes at a and b have in common."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.depth)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.hashes.raw(a, middle) == self.hashes.raw(b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def before(self, a: np.ndarray, b: np.ndarray, code_a: np.ndarray, code_b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b; of equal ones, whether ``first``."""
        out = first.copy()
        unequal = np.flatnonzero(code_a != code_b)
        x, y = a[unequal], b[unequal]
        at = self.extension(x, y)
        differs = at < self.depth
        rank = np.minimum(at, self.depth - 1)
        out[unequal] = np.where(differs, self.data[x + rank] < self.data[y + rank], first[unequal])
        return out

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Positions in ``starts`` in suffix order, group by group."""
        seed = self._seed(starts)
        order = np.lexsort((seed, group))
        code = self.hashes.of(starts, self.depth)
        g, s = group[order], seed[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]))) if len(order) else np.zeros(0, bool)
        run = np.flatnonzero(new)
        size = np.diff(np.append(run, len(order)))
        place = np.arange(len(order)) - np.repeat(run, size)
        begin, length = np.repeat(run, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(length > width)
            block = place[at] // (2 * width)
            left = place[at] % (2 * width) < width
            own = begin[at] + block * 2 * width + np.where(left, 0, width)
            sibling = begin[at] + block * 2 * width + np.where(left, width, 0)
            end = np.minimum(sibling + width, begin[at] + length[at])
            low, high = np.minimum(sibling, end), np.maximum(sibling, end)
            high = np.where(sibling >= end, low, high)
            first_low = low.copy()
            mine = order[at]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                other, me = order[middle], mine[open_]
                # a left suffix goes before equal right ones, a right one after equal left ones
                ahead = self.before(starts[other], starts[me], code[other], code[me], ~left[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            target = begin[at] + block * 2 * width + (begin[at] + place[at] - own) + (low - first_low)
            merged = order.copy()
            merged[target] = mine
            order, width = merged, 2 * width
        return order

    def repeated(self, starts: np.ndarray, group: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
        """A class for each suffix, numbered so that equal ones of a group have equal numbers.

        Neighbours in suffix order that the hashes call equal are compared token by token.
        """
        order = self.sort(starts, group)
        code = self.hashes.of(starts, self.depth)[order]
        g = group[order]
        same = np.concatenate(([False], (code[1:] == code[:-1]) & (g[1:] == g[:-1]))) if len(order) else np.zeros(0, bool)
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.depth) if len(self.data) >= self.depth else None
        pairs = np.flatnonzero(same)
        for i in range(0, len(pairs), chunk):
            p = pairs[i : i + chunk]
            same[p] = (rows[starts[order[p]]] == rows[starts[order[p - 1]]]).all(axis=1)
        number = np.cumsum(~same)
        out = np.empty(len(starts), np.int64)
        out[order] = number
        return out
