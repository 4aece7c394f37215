"""A join of sets by signature trees.

A set's signature is a bitmap of its tokens, as wide as a power of two of at
least twice its size. A tree's nodes hold the OR of the bitmaps below, the range
of sizes and the most tokens that a bitmap hides. Two trees' nodes (here one
tree with itself) are visited together from the roots down: a pair of nodes is
dropped where the largest overlap that their bitmaps allow is below what their
sizes need, or where all sets below are known to be connected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FANOUT = 8
_CELLS = 1 << 21


def width(n: int) -> int:
    """Bits of the signature of n tokens."""
    return 1 << max(6, (2 * n - 1).bit_length())


def signature(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set's tokens, 64 bits to a word."""
    size = width(len(tokens))
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.frombuffer(np.packbits(bits, bitorder="little").tobytes(), np.uint64)


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


class Forest:
    """Union-find over places."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, x: int, y: int) -> None:
        self.parent[self.find(y)] = self.find(x)


def possible(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets whose sizes add up to `sizes` reach a similarity of 0.8 with this overlap."""
    return 180 * overlap >= 80 * sizes


def links(n: np.ndarray, bitmaps: list[np.ndarray], linked: Callable[[int, int], bool], forest: Forest) -> list[tuple[int, int]]:
    """Pairs that `linked` confirms and that join two trees of `forest`, which ends joined by them.

    Every pair whose bitmaps allow a similarity of 0.8 is either confirmed,
    refused by `linked`, or connected already.
    """
    found: list[tuple[int, int]] = []
    words = np.array([len(b) for b in bitmaps])
    for w in np.unique(words).tolist():
        # sets of the next width may link to the largest of this one
        border = (words == 2 * w) & (4 * n <= 5 * 32 * w)
        some = np.flatnonzero((words == w) | border)
        if len(some) > 1:
            _join(some, n[some], np.stack([fold(bitmaps[i], w) for i in some.tolist()]), linked, forest, found)
    return found


def _join(some, n, bits, linked, forest, found) -> None:
    # similar sets side by side: by size, then by the first set bit
    first = np.argmax(bits != 0, axis=1)
    lowest = bits[np.arange(len(bits)), first]
    order = np.lexsort((lowest & (~lowest + np.uint64(1)), first, np.floor(np.log(np.maximum(n, 1)) / np.log(1.1))))
    some, n, bits = some[order], n[order], bits[order]
    hidden = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)

    def confirm(i: np.ndarray, j: np.ndarray) -> None:
        a, b = bits[i], bits[j]
        overlap = np.minimum(n[i] - np.bitwise_count(a & ~b).sum(axis=1), n[j] - np.bitwise_count(b & ~a).sum(axis=1))
        good = possible(overlap.astype(np.int64), n[i] + n[j])
        for x, y in zip(some[i[good]].tolist(), some[j[good]].tolist(), strict=True):
            if forest.find(x) != forest.find(y) and linked(x, y):
                forest.union(x, y)
                found.append((x, y))

    step = max(16, _CELLS // bits.shape[1] // 8)
    # the first set against all: a crowd of copies is one component after this
    for low in range(1, len(some), step):
        j = np.arange(low, min(low + step, len(some)))
        confirm(np.zeros(len(j), np.int64), j)

    component = np.array([forest.find(x) for x in some.tolist()])
    levels = [(bits, n, n, hidden, component)]
    while len(levels[-1][1]) > 1:
        b, least, most, hid, comp = levels[-1]
        at = np.arange(0, len(least), FANOUT)
        same = np.where(np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at), comp[at], -1)
        levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(hid, at), same))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            stack.append((level, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        b, least, most, hid, comp = levels[level]
        alive = ((comp[i] != comp[j]) | (comp[i] < 0)) & (5 * most[i] >= 4 * least[j]) & (5 * most[j] >= 4 * least[i])
        if not level:
            alive &= i != j
        i, j = i[alive], j[alive]
        if not level:
            confirm(i, j)
            continue
        overlap = np.bitwise_count(b[i] & b[j]).sum(axis=1).astype(np.int64) + np.minimum(hid[i], hid[j])
        alive = possible(overlap, least[i] + least[j])
        i, j = i[alive], j[alive]
        if len(i):
            below = len(levels[level - 1][1])
            children = np.arange(FANOUT)
            x = (i[:, None, None] * FANOUT + children[None, :, None]).repeat(FANOUT, axis=2).ravel()
            y = (j[:, None, None] * FANOUT + children[None, None, :]).repeat(FANOUT, axis=1).ravel()
            inside = (x < below) & (y < below) & (x <= y)
            stack.append((level - 1, x[inside], y[inside]))
