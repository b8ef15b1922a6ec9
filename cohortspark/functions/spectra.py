"""Spectra of large covariances that are sparse but for a change of low rank, without a variants x variants matrix.

Cross products of variants that share no sample are zero, so that a large group's covariance is a sparse matrix S less the
covariates' part y c y'.  A form's tail needs sums over eigenvalues of logarithms, which few polynomials follow closely: the
sums of those over the spectrum are exact, and a Gauss-Radau rule that has them all stands for the eigenvalues.  S falls
apart into components of variants; a small one is decomposed, a large one gives traces of its powers.  What changes of low
rank do to the sums is read off their action on the Krylov space of their vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

DENSE = 2_048  # variants of a group or component that is decomposed at once
WIDE = 32  # dense columns at a time
CELLS = 1 << 20  # products made at a time
STEPS = 8  # least number of powers in the Krylov space
FIRST = 2  # depth that large components begin with
MARGIN = 1.05  # over the largest value found in the Krylov space
CLOSE = 1e-6  # of a p, between the two rules
LATE = 16  # depth from which a gap that stays is one of rounding


class Covariance:
    """S - y c y', symmetric and without negative eigenvalues; S from pairs (one, two, value) with one <= two."""

    def __init__(self, one: np.ndarray, two: np.ndarray, value: np.ndarray, y: np.ndarray, c: np.ndarray):
        self.n, self.y, self.c = len(y), y, c
        off = one != two
        lone = np.setdiff1d(np.arange(self.n), one[~off])  # every row holds its diagonal, so that none is empty
        rows = np.concatenate((one, two[off], lone)).astype(np.int32)
        cols = np.concatenate((two, one[off], lone)).astype(np.int32)
        values = np.concatenate((value, value[off], np.zeros(len(lone))))
        order = np.argsort(rows, kind="stable")
        self.cols, self.values = cols[order], values[order]
        self.start = np.searchsorted(rows[order], np.arange(self.n + 1))

    def __len__(self) -> int:
        return self.n

    def sparse(self, x: np.ndarray) -> np.ndarray:
        """S x, column by column."""
        return np.column_stack([np.add.reduceat(self.values * v[self.cols], self.start[:-1]) for v in x.T])

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.sparse(x) - self.y @ (self.c @ (self.y.T @ x))

    @cached_property
    def rows(self) -> np.ndarray:
        """Sums of its rows."""
        return self.times(np.ones((self.n, 1)))[:, 0]

    def sum(self) -> float:
        return float(self.rows.sum())

    @cached_property
    def labels(self) -> np.ndarray:
        """The least variant that S links with each."""
        label = np.arange(self.n)
        while True:
            new = np.minimum.reduceat(label[self.cols], self.start[:-1])
            new = new[new]
            if np.array_equal(new, label):
                return label
            label = new

    def part(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows' starts, columns, values) of S over the members of a component, numbered in their order."""
        place = np.full(self.n, -1, np.int32)
        place[members] = np.arange(len(members))
        counts = self.start[members + 1] - self.start[members]
        start = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat(self.start[members] - start[:-1], counts) + np.arange(start[-1])
        return start, place[self.cols[at]], self.values[at]

    @cached_property
    def known(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Eigenvalues of the components that are decomposed, and the parts of the others."""
        order = np.argsort(self.labels, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(self.labels[order])) + 1)
        alone = np.array([p[0] for p in parts if len(p) == 1], int)
        values, large = [self.values[self.start[alone]]], []
        for members in parts:
            if len(members) == 1:
                continue
            start, cols, cells = self.part(members)
            if len(members) > DENSE:
                large.append((start, cols, cells))
                continue
            dense = np.zeros((len(members), len(members)))
            dense[np.repeat(np.arange(len(members)), np.diff(start)), cols] = cells
            values.append(np.linalg.eigvalsh(dense))
        return np.concatenate(values), large

    def krylov(self, vectors: np.ndarray, steps: int) -> np.ndarray:
        """Orthonormal columns that span S^j times the vectors, j up to the steps."""
        basis = np.linalg.qr(vectors)[0]
        last = basis
        for _ in range(min(steps, max(0, self.n // vectors.shape[1] - 1))):
            more = self.sparse(last)
            for _ in range(2):
                more -= basis @ (basis.T @ more)
                more = np.linalg.qr(more)[0]
            last = more
            basis = np.hstack((basis, more))
        return basis


class Powers:
    """A large component of S, known by the traces of Chebyshev polynomials of it."""

    def __init__(self, start: np.ndarray, cols: np.ndarray, values: np.ndarray, top: float):
        """The polynomials are those of the interval from 0 to top."""
        self.start, self.n = start, len(start) - 1
        self.cols, self.values = cols, values * (2 / top)
        self.values[cols == np.repeat(np.arange(self.n), np.diff(start))] -= 1
        self.moments = np.array([float(self.n)])
        self.depth = 0

    def deepen(self, depth: int) -> None:
        """Traces of the polynomials up to twice the depth; a product of two polynomials is half the sum of two others."""
        if depth <= self.depth:
            return
        sums = np.zeros((depth + 1, 2))  # <T_j, T_j> and <T_j, T_(j-1)>
        for low in range(0, self.n, WIDE):
            high = min(low + WIDE, self.n)
            at = slice(self.start[low], self.start[high])
            row = np.repeat(np.arange(high - low), np.diff(self.start[low : high + 1]))
            cells, own = self.values[at], (np.arange(low, high), np.arange(high - low))
            sums[1] += float(cells @ cells), float(cells[self.cols[at] == low + row].sum())
            now = 2 * self.product_few(self.cols[at], row, cells, high - low)
            now[own] -= 1
            sums[2] += float(np.vdot(now, now)), float(now[self.cols[at], row] @ cells)
            if depth > 2:
                before = np.zeros_like(now)
                before[self.cols[at], row] = cells
            for j in range(3, depth + 1):
                after = self.product(now)
                after *= 2
                after -= before
                before, now = now, after
                sums[j] += float(np.vdot(now, now)), float(np.vdot(now, before))
        moments = np.empty(2 * depth + 1)
        moments[0], moments[1] = self.n, sums[1, 1]
        for j in range(1, depth + 1):
            moments[2 * j] = 2 * sums[j, 0] - self.n
            if j > 1:
                moments[2 * j - 1] = 2 * sums[j, 1] - moments[1]
        self.moments, self.depth = moments, depth

    @cached_property
    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first cells of all rows, the second ones, and so on: (columns, values), longest rows first."""
        order, counts = self.order, np.diff(self.start)[self.order]
        sizes = np.searchsorted(-counts, -np.arange(counts[0]), side="left")
        return [(self.cols[at], self.values[at, None]) for at in (self.start[order[:m]] + k for k, m in enumerate(sizes))]

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(-np.diff(self.start), kind="stable")

    def product(self, x: np.ndarray) -> np.ndarray:
        """The matrix times a block of columns."""
        sums, out, held = np.zeros_like(x), np.empty_like(x), np.empty_like(x)
        for cols, values in self.layers:
            cells = held[: len(cols)]
            np.take(x, cols, axis=0, out=cells, mode="clip")
            cells *= values
            sums[: len(cols)] += cells
        out[self.order] = sums
        return out

    def product_few(self, row: np.ndarray, col: np.ndarray, cells: np.ndarray, wide: int) -> np.ndarray:
        """The matrix times a block of so many columns that is zero but for some cells."""
        out = np.zeros(self.n * wide)
        counts = self.start[row + 1] - self.start[row]
        ends = np.cumsum(counts)
        pieces = np.searchsorted(ends, np.arange(0, ends[-1], CELLS), side="right")
        for low, high in zip(pieces, np.append(pieces[1:], len(row)), strict=True):
            n = counts[low:high]
            at = np.arange(int(n.sum())) + np.repeat(self.start[row[low:high]] - np.cumsum(n) + n, n)
            made = self.values[at] * np.repeat(cells[low:high], n)
            out += np.bincount(self.cols[at] * np.int64(wide) + np.repeat(col[low:high], n), made, len(out))
        return out.reshape(self.n, wide)


def radau(mu: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the Gauss-Radau rule on [-1, 1] with the moments mu of Chebyshev polynomials, an even number
    after the first; one place is the side, -1 or 1.

    For a function whose derivatives all have one sign, the two rules are on either side of the true sum.
    """
    plain = lambda i, j: (mu[i + j] + mu[np.abs(i - j)]) / 2
    shifted = lambda i, j: (plain(i + 1, j) + plain(np.abs(i - 1), j)) / 2
    for size in range(len(mu) // 2, 0, -1):
        i, j = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
        # Products with y + 1 or 1 - y, which are not negative inside; y T_i = (T_(i+1) + T_(i-1)) / 2.
        gram = shifted(i, j) * -side + plain(i, j)
        mixed = (shifted(i + 1, j) + shifted(np.abs(i - 1), j)) / 2 * -side + shifted(i, j)
        low = np.linalg.eigvalsh(gram)
        if low[0] <= 1e-12 * low[-1]:
            continue  # fewer different eigenvalues than places, to the last digits
        root = np.linalg.cholesky(gram)
        inner = np.linalg.solve(root, np.linalg.solve(root, mixed).T)
        y, q = np.linalg.eigh((inner + inner.T) / 2)
        weights = (q.T @ np.linalg.solve(root, gram[:, 0])) ** 2 / (1 - side * y)
        return np.append(y, side), np.append(weights, mu[0] - weights.sum())
    return np.array([mu[1] / mu[0]]), mu[:1]


class Spectra:
    """Spectra of a covariance R and of what it becomes by changes within the basis: values, and how often each stands.

    ones, rows: the vector of ones and R's row sums in the basis.
    """

    def __init__(self, r: Covariance):
        self.r, self.n = r, r.n
        self.exact, parts = r.known
        self.project(STEPS)
        most = max((np.add.reduceat(np.abs(v), s[:-1]).max() for s, _, v in parts), default=0.0)
        self.top = max(self.exact.max(initial=0.0), min(most, MARGIN * self.inner_values[-1]))
        self.large = [Powers(*p, self.top) for p in parts] if self.top > 0 else []
        self.deepen(FIRST if parts else STEPS)

    def sum(self) -> float:
        """Sum of R's cells."""
        return self.r.sum()

    def project(self, steps: int) -> None:
        r = self.r
        self.basis_steps = steps
        basis = r.krylov(np.column_stack((np.ones(r.n), r.y)), steps)
        inner, y = basis.T @ r.sparse(basis), basis.T @ r.y
        self.inner_values = np.linalg.eigvalsh((inner + inner.T) / 2)
        self.changed = (inner + inner.T) / 2 - y @ r.c @ y.T
        self.ones, self.rows = basis.T @ np.ones(r.n), basis.T @ r.rows

    def deepen(self, depth: int) -> None:
        """Sums of polynomials of S up to twice the depth."""
        self.depth = depth
        if depth > self.basis_steps:
            self.project(depth)
        self.moments = self.sums(self.exact / self.top if self.top > 0 else self.exact)
        for one in self.large:
            one.deepen(depth)
            self.moments = self.moments + one.moments

    def settled(self, f: Callable[[float], float]) -> float:
        """f(side), a p worked out from spectra by the rules of that side: the mean once both are close, deepened until then."""
        before = np.inf
        while True:
            one, two = f(-1.0), f(1.0)
            gap = abs(one - two)
            if gap <= CLOSE * min(one, two) or (self.depth >= LATE and gap > before / 2):
                return (one + two) / 2
            before = gap
            self.deepen(max(self.depth + 1, self.depth * 3 // 2))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of polynomials over values, the interval being 0 to 1."""
        return np.cos(np.arange(2 * self.depth + 1)[:, None] * np.arccos(np.clip(2 * values - 1, -1, 1))).sum(axis=1)

    def of(self, scale: float = 1.0, change: np.ndarray | float = 0.0, side: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """Values and weights of scale R plus a change, given in the basis."""
        now = scale * self.changed + change
        values, top = np.linalg.eigvalsh((now + now.T) / 2), scale * self.top
        if not top > 0:
            return np.zeros(1), np.array([float(self.n)])
        out = values > top  # beyond the interval: these stand for themselves
        mu = self.moments + self.sums(values[~out] / top) - self.sums(self.inner_values / self.top)
        y, weights = radau(mu, side)
        return np.append(values[out], (1 + y) * top / 2), np.append(np.ones(out.sum()), weights)
