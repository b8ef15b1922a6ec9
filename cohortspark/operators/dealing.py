"""Keyed draws that any task can repeat: cases dealt to runs of samples by a tree, places changed by a bijection.

Samples are numbered by odds bin first, so that a bin is a run of numbers and a block of samples holds few bins.  A cell is
the part of a bin that lies in one block.  `CaseTree` deals a permutation's cases from all cells to halves of them, and so
on down: at every node the cases of its left half follow their exact conditional law, which for cells of one bin is the
hypergeometric law and for bins Fisher's noncentral one.  A draw is a function of (seed, permutation, node), so that a task
walks only from the root to the cells of its own block, and all tasks agree.

`places` moves samples inside their bins: every sample's new number is a function of (seed, permutation, bin, number).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CELLS_AT_MOST = 1 << 20  # of a tree: bins within the range of the odds, and blocks of samples
ENTRIES_AT_MOST = 1 << 25  # of all laws of a tree, which travels to tasks (256 MB)
FFT_FROM = 4_096  # entries of the shorter law from which two are convolved by Fourier transform
SMALL_BIN = 4_096  # samples of a bin up to which places are drawn by sorting, exactly uniform
ROUNDS = 8

# Multipliers of the SplitMix64 finalizer and its increment.
FIRST, SECOND, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def keyed(*keys: int | np.ndarray) -> np.ndarray:
    """64 well mixed bits of integer keys, element by element."""
    h = np.zeros(1, np.uint64)
    for key in keys:
        h = (h ^ np.asarray(key).astype(np.uint64)) + STEP
        h = (h ^ (h >> np.uint64(30))) * FIRST
        h = (h ^ (h >> np.uint64(27))) * SECOND
        h = h ^ (h >> np.uint64(31))
    return h


def uniform(*keys: int | np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) of integer keys."""
    return ((keyed(*keys) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@dataclass(frozen=True)
class Law:
    """Probabilities of first, first + 1, ..."""

    first: int
    p: np.ndarray

    @property
    def last(self) -> int:
        return self.first + len(self.p) - 1

    def trimmed(self, least: float) -> Law:
        held = np.flatnonzero(self.p > least * self.p.max())
        return Law(self.first + int(held[0]), self.p[held[0] : held[-1] + 1])


def binomial_law(n: int, p: float) -> Law:
    """Successes among n, as far as double precision tells them from never."""
    if n == 0 or p <= 0:
        return Law(0, np.ones(1))
    if p >= 1:
        return Law(int(n), np.ones(1))
    mode, half = min(int((n + 1) * p), n), int(9 * np.sqrt(n * p * (1 - p)) + 40)
    low, high = max(0, mode - half), min(n, mode + half)
    k = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - k) / (k + 1) * (p / (1 - p))))))
    w = np.exp(logs - logs.max())
    return Law(low, w / w.sum()).trimmed(1e-18)


def sum_law(a: Law, b: Law) -> Law:
    """The law of the sum of two independent numbers."""
    if min(len(a.p), len(b.p)) < FFT_FROM:
        return Law(a.first + b.first, np.convolve(a.p, b.p)).trimmed(1e-18)
    size = len(a.p) + len(b.p) - 1
    wide = 1 << (size - 1).bit_length()
    p = np.fft.irfft(np.fft.rfft(a.p, wide) * np.fft.rfft(b.p, wide), wide)[:size]
    return Law(a.first + b.first, np.maximum(p, 0)).trimmed(1e-14)


def tilted(sizes: np.ndarray, odds: np.ndarray, cases: int) -> np.ndarray:
    """Probabilities with the cells' odds times a common factor, under which `cases` are expected: the factor cancels from
    the law of the cells given their total."""
    low, high = -745.0, 745.0
    logs = np.log(odds)
    for _ in range(200):
        mid = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(logs + mid, -700, 700)))
        low, high = (mid, high) if (sizes * p).sum() < cases else (low, mid)
    return p


class CaseTree:
    """How `cases` fall to cells of samples with given odds."""

    def __init__(self, sizes: np.ndarray, odds: np.ndarray, starts: np.ndarray, cases: int):
        """Cells in order of their samples; starts: each block's first cell, and the number of cells at the end."""
        if len(sizes) > CELLS_AT_MOST:
            raise ValueError(f"over {CELLS_AT_MOST} cells of odds bins and blocks; take a larger bin_epsilon")
        self.sizes, self.starts, self.cases = np.asarray(sizes, np.int64), np.asarray(starts), int(min(max(cases, 0), sizes.sum()))
        self.upto = np.concatenate(([0], np.cumsum(self.sizes)))
        self.laws: dict[tuple[int, int], Law] = {}
        if len(sizes) and 0 < self.cases < self.sizes.sum():
            self.p = tilted(self.sizes, np.clip(odds, 1e-300, 1e300), self.cases)
            self.grow(0, len(sizes))
        if sum(len(law.p) for law in self.laws.values()) > ENTRIES_AT_MOST:
            raise ValueError("the odds bins are too many for so many samples; take a larger bin_epsilon")

    def grow(self, low: int, high: int) -> Law:
        if high - low == 1:
            law = binomial_law(int(self.sizes[low]), float(self.p[low]))
        else:
            mid = (low + high) // 2
            law = sum_law(self.grow(low, mid), self.grow(mid, high))
        self.laws[low, high] = law
        return law

    def split(self, low: int, mid: int, high: int, cases: int, u: float) -> int:
        """Cases of the left half of a node's, by the inverse of their distribution."""
        left, right = (int(self.upto[b] - self.upto[a]) for a, b in ((low, mid), (mid, high)))
        if cases == 0 or cases == left + right or not right:
            return min(cases, left)
        a, b = self.laws[low, mid], self.laws[mid, high]
        first, last = max(a.first, cases - b.last), min(a.last, cases - b.first)
        w = np.cumsum(a.p[first - a.first : last - a.first + 1] * b.p[cases - last - b.first : cases - first - b.first + 1][::-1])
        return first + min(int(np.searchsorted(w, u * w[-1], side="right")), last - first)

    def dealt(self, seed: int, perm: int, block: int) -> np.ndarray:
        """Cases of each cell of a block in a permutation."""
        low, high = int(self.starts[block]), int(self.starts[block + 1])
        out = np.zeros(high - low, np.int64)
        ways = [(0, len(self.sizes), self.cases)]
        while ways:
            a, b, k = ways.pop()
            if b <= low or a >= high:
                continue
            if b - a == 1:
                out[a - low] = k
                continue
            mid = (a + b) // 2
            left = self.split(a, mid, b, k, float(uniform(seed, perm, a, b)[0]))
            ways += [(a, mid, left), (mid, b, k - left)]
        return out


def mixed_places(at: np.ndarray, size: np.ndarray, *keys: int | np.ndarray) -> np.ndarray:
    """A keyed bijection of 0 to size - 1 for each size: a Feistel network on two halves of bits, walked until in range."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rounds = [keyed(*keys, r) for r in range(ROUNDS)]
    rounds = [np.broadcast_to(k, at.shape) for k in rounds]
    out, todo = at.astype(np.uint64), np.arange(len(at))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for key in rounds:
            left, right = right, (left ^ keyed(key[todo], right)) & mask[todo]
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def places(first: int, count: int, starts: np.ndarray, seed: int, perm: int) -> np.ndarray:
    """New numbers of the samples first to first + count - 1: each stays inside its bin, a run between two of starts."""
    at = np.arange(first, first + count)
    own = np.searchsorted(starts, at, side="right") - 1
    low, size = starts[own], np.diff(starts)[own]
    out = np.empty(count, np.int64)
    large = size > SMALL_BIN
    if large.any():
        out[large] = low[large] + mixed_places(at[large] - low[large], size[large], seed, perm, own[large])
    small = np.unique(own[~large])
    if len(small):
        # Whole bins, also where they reach into other blocks.
        wide = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in small])
        of = np.repeat(small, np.diff(starts)[small])
        order = wide[np.lexsort((keyed(seed, perm, wide), of))]
        out[~large] = order[np.searchsorted(wide, at[~large])]
    return out
