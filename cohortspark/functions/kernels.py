"""Statistics of one (gene, transcript) group, from dense columns over its carriers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .special import chi2_isf, chi2_sf
from .spectra import Spectra
from .tails import exact_quantile, form_sf, form_sf_all, liu_quantile

# Mixing weights of the optimal test.
RHO = (0.0, 0.01, 0.04, 0.09, 0.16, 0.25, 0.5, 1.0)
SMALLEST = 2.2250738585072014e-308


def burden_p(q: float, total: float) -> float:
    stat = q / total if total > 0 else math.nan
    return chi2_sf(stat, 1) if math.isfinite(stat) else 1.0


def skat_p(z: np.ndarray, r: np.ndarray | Spectra, use_saddlepoint: bool = False) -> float:
    """Variance-component p-value of weighted scores z with covariance r."""
    if isinstance(r, Spectra):
        return r.settled(lambda side: spectrum_sf(float(z @ z), r.of(side=side), use_saddlepoint))
    return form_sf(float(z @ z), np.abs(np.linalg.eigvalsh(r)), use_saddlepoint)


def spectrum_sf(q: float, spectrum: tuple[np.ndarray, np.ndarray | None], use_saddlepoint: bool) -> float:
    return form_sf(q, spectrum[0], use_saddlepoint, spectrum[1])


def cauchy_p(values: list[float]) -> float:
    t = float(np.mean([math.tan((0.5 - min(max(p, 1e-300), 1 - 1e-16)) * math.pi) for p in values]))
    return 0.5 - math.atan(t) / math.pi


SIDES = np.polynomial.legendre.leggauss(7), np.polynomial.legendre.leggauss(15)
DEPTH, PIECES = 15, 256


def adaptive(f: Callable[[np.ndarray], np.ndarray], edges: np.ndarray, least: float, tol: float = 1e-9) -> tuple[float, float]:
    """(integral, error) of f over the pieces between edges: two Gauss rules on each, pieces halved where they differ by more
    than tol of the integral, or of `least` if that is more."""
    low, high, total, error = edges[:-1], edges[1:], 0.0, 0.0
    for depth in range(DEPTH + 1):
        half, mid = (high - low) / 2, (high + low) / 2
        at = [mid[:, None] + half[:, None] * nodes for nodes, _ in SIDES]
        values = f(np.concatenate([a.ravel() for a in at]))
        cut = at[0].size
        rough, fine = (half * (v.reshape(a.shape) @ weights) for v, a, (_, weights) in zip((values[:cut], values[cut:]), at, SIDES, strict=True))
        off = np.abs(fine - rough)
        enough = tol * max(least, abs(total + float(fine.sum())))
        done = (off <= enough / max(len(off), 8)) | (depth == DEPTH) | (len(off) > PIECES)
        total, error = total + float(fine[done].sum()), error + float(off[done].sum())
        if done.all():
            break
        low, high = np.concatenate((low[~done], mid[~done])), np.concatenate((mid[~done], high[~done]))
    return total, error


def lower_edges(offset: np.ndarray, slope: np.ndarray, top: float) -> np.ndarray:
    """Where the least of the lines offset + slope * v has a kink or meets zero, for v in (0, top)."""
    cuts = []
    for i in range(len(offset)):
        for j in range(i):
            if slope[i] != slope[j]:
                cuts.append((offset[j] - offset[i]) / (slope[i] - slope[j]))
        if slope[i]:
            cuts.append(-offset[i] / slope[i])
    inside = np.array(sorted({v for v in cuts if 0 < v < top}))
    least = lambda v: (offset + slope * v).min()
    # A kink is where the least line is below the chord around it.
    kept = [v for v in inside if abs(least(v)) < 1e-9 * np.abs(offset).max() or np.ptp([x for x, y in zip(slope, offset + slope * v, strict=True) if y <= least(v) + 1e-9 * np.abs(offset).max()]) > 0]
    return np.array(kept)


LARGE = 1_000  # variants from which one decomposition serves all mixing weights


def decomposed(r: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenvalues of a covariance in order, and the vector of ones along its eigenvectors; None if one is clearly negative.

    In these coordinates the mixed covariances have the eigenvalues of (1 - rho) D plus one square, and what the burden
    leaves of the covariance is D less one square.
    """
    d, q = np.linalg.eigh(r)
    return None if d[0] < -1e-9 * d[-1] else (np.maximum(d, 0.0), q.sum(axis=0))


def raised(d: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Eigenvalues of diag(d) + u u' for d in order and the squares of u: each lies between two of d, and is found by halving
    until doubles end; how many are below a value follows from the sign of 1 + sum square / (d - value)."""
    low, high = d.copy(), np.append(d[1:], d[-1] + square.sum())
    size = np.abs(d).max() + square.sum()
    low_all, high_all = low.copy(), high.copy()
    step = max(1, (1 << 19) // len(d))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for at in range(0, len(d), step):
            low, high = low_all[at : at + step], high_all[at : at + step]
            while (high - low).max() > 2e-16 * size:
                mid = (low + high) / 2
                cells = d[None, :] - mid[:, None]
                np.reciprocal(cells, out=cells)
                below = 1 + cells @ square > 0
                if np.array_equal(np.where(below, mid, high), high) and np.array_equal(np.where(below, low, mid), low):
                    break
                high[below], low[~below] = mid[below], mid[~below]
    return (low_all + high_all) / 2


def skato(z: np.ndarray, r: np.ndarray | Spectra, use_saddlepoint: bool = False, exact: bool = False) -> tuple[float, float]:
    """(p, error of the integral): optimal combination of burden and variance-component tests over a grid of mixing weights.

    Quantiles come from matched moments scaled by the degrees of freedom (not by their root), which makes a small p
    too large, about twice at 0.05; exact: quantiles from the tails themselves, with which p is right.
    """
    if isinstance(r, Spectra):
        errors = {}

        def of_side(side: float) -> float:
            p, errors[side] = optimal(z, r.r.rows, float(r.r.rows @ r.r.times(r.r.rows[:, None])[:, 0]), *sparse_mixed(r, side), use_saddlepoint, exact)
            return p

        p = r.settled(of_side)
        return p, max(errors.values())
    rows = r.sum(axis=1)
    return optimal(z, rows, float(rows @ r @ rows), *dense_mixed(r, rows), use_saddlepoint, exact)


Spectrum = tuple[np.ndarray, np.ndarray | None]  # values, and how often each stands


def lift_of(rho: float, n: int) -> tuple[float, float]:
    """(root, lift): root I + lift J is the square root of the mixing matrix, a rank-one change of the identity."""
    root = math.sqrt(1 - rho)
    return root, (math.sqrt(1 - rho + n * rho) - root) / n


def sparse_mixed(r: Spectra, side: float) -> tuple[Callable[[float], Spectrum], Callable[[], Spectrum]]:
    """Spectra of the mixed covariances, and of what the burden leaves."""
    total, both = r.sum(), np.outer(r.rows, r.ones) + np.outer(r.ones, r.rows)

    def mixed(rho: float) -> Spectrum:
        root, lift = lift_of(rho, r.n)
        return r.of(root * root, root * lift * both + lift * lift * total * np.outer(r.ones, r.ones), side)

    return mixed, lambda: r.of(1.0, -np.outer(r.rows, r.rows) / total, side)


def dense_mixed(r: np.ndarray, rows: np.ndarray) -> tuple[Callable[[float], Spectrum], Callable[[], Spectrum]]:
    """The same from a matrix."""
    n, total = len(r), float(rows.sum())
    known = decomposed(r) if n >= LARGE else None

    def mixed(rho: float) -> Spectrum:
        if known is not None:
            return np.maximum(raised((1 - rho) * known[0], rho * known[0] * known[1] ** 2), 1e-20), None
        root, lift = lift_of(rho, n)
        # (root I + lift J) r (root I + lift J), with J r = the rows' sums on every line.
        return np.maximum(np.linalg.eigvalsh(root * root * r + root * lift * (rows[:, None] + rows[None, :]) + lift * lift * total), 1e-20), None

    def left() -> Spectrum:
        if known is not None:
            return np.abs(raised(-known[0][::-1], (known[0] * known[1])[::-1] ** 2 / total)), None
        return np.abs(np.linalg.eigvalsh(r - np.outer(rows, rows) / total)), None

    return mixed, left


def optimal(z: np.ndarray, rows: np.ndarray, r3: float, mixed: Callable[[float], Spectrum], left: Callable[[], Spectrum], use_saddlepoint: bool, exact: bool) -> tuple[float, float]:
    """skato from the covariance's row sums, their form in it, and spectra."""
    total = float(rows.sum())
    q_skat, q_burden = float(z @ z), float(z.sum() ** 2)
    if len(z) == 1:
        return burden_p(q_burden, total), 0.0
    ps, spectra = [], []
    for rho in RHO:
        if rho == 1.0:
            ps.append(burden_p(q_burden, total))
            continue
        spectra.append(mixed(rho))
        ps.append(spectrum_sf((1 - rho) * q_skat + rho * q_burden, spectra[-1], use_saddlepoint))
    best = min(ps)
    bound = min(1.0, best * len(RHO))
    quantiles = np.array([exact_quantile(best, v, t) if exact else liu_quantile(best, v, 1.0 if t is None else t) for v, t in spectra])
    lam, times = left()
    r2 = float(rows @ rows)
    grid = np.array(RHO[:-1])
    tau = (1 - grid) * r2 / total + grid * total
    often = 1.0 if times is None else times
    mean, var = float((often * lam).sum()), float(2 * (often * lam**2).sum())
    shrink = math.sqrt(var) / math.sqrt(var + 4 * (r3 / total - (r2 / total) ** 2))
    top = chi2_isf(best, 1)
    if not math.isfinite(top) or top <= 0:
        return max(SMALLEST, bound), 0.0
    # The tail's argument: the least of lines in the square of the burden's normal variable.
    offset, slope = (quantiles / (1 - grid) - mean) * shrink + mean, -tau / (1 - grid) * shrink

    def inner(u: np.ndarray) -> np.ndarray:
        x = (offset[:, None] + slope[:, None] * u * u).min(axis=0)
        return form_sf_all(x, lam, use_saddlepoint, times) * math.sqrt(2 / math.pi) * np.exp(-0.5 * u * u)

    edges = np.sqrt(np.concatenate(([0.0], lower_edges(offset, slope, top), [top])))
    integral, error = adaptive(inner, edges, best)
    p = best + integral
    return max(SMALLEST, bound if not math.isfinite(p) or p <= 0 else min(p, bound)), error


def skato_p(z: np.ndarray, r: np.ndarray, use_saddlepoint: bool = False, exact: bool = False) -> float:
    return skato(z, r, use_saddlepoint, exact)[0]


def site_score(counts: np.ndarray, weight: float, cap: float) -> float:
    """Score of allele counts (case alternate, case reference, control alternate, control reference), merged or not."""
    a, b, c, d = counts
    if a == 0 or b * c > d * a or weight <= 0:
        return 0.0

    def ll(f: float, alt: float, ref: float) -> float:
        return alt * math.log(f) + ref * math.log(1 - f) if 0 < f < 1 else 0.0

    common = (a + c) / (a + b + c + d)
    ratio = ll(a / (a + b), a, b) + ll(min(c / (c + d), cap), c, d) - ll(common, a, b) - ll(common, c, d)
    return max(0.0, 2 * (ratio + math.log(weight)))


def grouped_scores(counts: np.ndarray, weights: np.ndarray, keys: list[str], limit: float, cap: float, score: np.ndarray | None = None) -> list[float]:
    """Scores after rare sites are merged greedily in sub-groups of five, the best first; score: known scores of the sites."""
    score = [site_score(c, w, cap) for c, w in zip(counts, weights, strict=True)] if score is None else score.tolist()
    merging, rest = merge_order(counts, weights, keys, limit, score, list(range(len(keys))))
    out = [score[k] for k in rest]
    groups = max(1, len(merging) // 5) if merging else 0
    for g in range(groups):
        out += merged_scores(counts, weights, merging[5 * g : 5 * g + 5 if g + 1 < groups else None], cap, score)
    return out


def merge_order(counts: np.ndarray, weights: np.ndarray, keys: list[str], limit: float, score: list[float], sites: list[int]) -> tuple[list[int], list[int]]:
    """The sites that are merged, the best first, and the others."""
    order = sorted(sites, key=lambda k: keys[k], reverse=True)
    order.sort(key=lambda k: (-weights[k], -score[k]))
    merges = lambda k: counts[k][0] <= limit and score[k] > 0
    return [k for k in order if merges(k)], [k for k in order if not merges(k)]


def merged_scores(counts: np.ndarray, weights: np.ndarray, members: list[int], cap: float, score: list[float]) -> list[float]:
    """Scores of a sub-group: of the sites that stay alone, and of the merged ones."""
    members, out = sorted(members, key=lambda k: score[k]), []
    total, weight, best = counts[members[-1]].copy(), weights[members[-1]], score[members[-1]]
    for k in members[-2::-1]:
        more = site_score(total + counts[k], weight * weights[k], cap)
        if more > best:
            total, weight, best = total + counts[k], weight * weights[k], more
        else:
            out.append(score[k])
    return [*out, best]


def vaast_grouped(counts: np.ndarray, weights: np.ndarray, types: list[str], keys: list[str], limit: float = 4, cap: float = 1.0, penalty: float = 2.0, by_type: bool = False, score: np.ndarray | None = None) -> float:
    """Sum of what the merged and single scores exceed the penalty by."""
    sets = [np.flatnonzero(np.array(types) == t) for t in sorted(set(types))] if by_type else [np.arange(len(keys))]
    scores = [s for at in sets for s in grouped_scores(counts[at], weights[at], [keys[k] for k in at], limit, cap, None if score is None else score[at])]
    return float(sum(s - penalty for s in scores if s > penalty))


def leave_one_out(counts: np.ndarray, weights: np.ndarray, types: list[str], keys: list[str], limit: float = 4, cap: float = 1.0, penalty: float = 2.0, by_type: bool = False) -> list[float]:
    """What each variant adds to the group's score.

    A variant that is not merged adds its own part.  Without a merged one the sub-groups before its own stay, its own is made
    again, and those after it move on by one place; their sums serve all variants.
    """
    score = [site_score(c, w, cap) for c, w in zip(counts, weights, strict=True)]
    out = [max(0.0, s - penalty) for s in score]
    kinds = np.array(types)
    for at in [np.flatnonzero(kinds == t) for t in sorted(set(types))] if by_type else [np.arange(len(keys))]:
        merging, _ = merge_order(counts, weights, keys, limit, score, at.tolist())
        m = len(merging)

        def part(members: list[int]) -> float:
            return sum(s - penalty for s in merged_scores(counts, weights, members, cap, score) if s > penalty)

        def after(start: int, size: int) -> list[float]:
            """For each sub-group of `size` merged sites, what it and those after it score; sites begin at start."""
            groups = max(1, size // 5) if size else 0
            parts = [part(merging[start + 5 * g : start + 5 * g + 5 if g + 1 < groups else m]) for g in range(groups)]
            return [*np.cumsum(parts[::-1])[::-1].tolist(), 0.0]

        now, moved = after(0, m), after(1, max(m - 1, 0))
        groups = len(moved) - 1
        for j, k in enumerate(merging):
            g = min(j // 5, groups - 1)
            own = [merging[i] for i in range(5 * g, 5 * g + 6 if g + 1 < groups else m) if i != j] if groups else []
            out[k] = max(0.0, now[max(g, 0)] - (part(own) if own else 0.0) - (moved[g + 1] if groups else 0.0))
    return out
