"""Statistics of one (gene, transcript) group for a whole block of permutations: every array's last axis is the permutation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..config import AssocConfig

COUNTED = ("CALPHA", "WSS", "VT", "CMC", "CMC1df", "RVT2", "BURDEN", "SKAT", "VAAST")  # methods that need no more than counts


@dataclass
class GroupCounts:
    """Counts of a group's variants; a, c: case alleles and case carriers, variants x permutations.

    held: carriers of any variant; h: cases among them.  z, r1: weighted scores against a null model with covariates, and
    the variance of their sum, where there is one.
    """

    n: int
    cases: int
    ac: np.ndarray
    ac2: np.ndarray
    carriers: np.ndarray
    weight: np.ndarray
    types: list[str]
    keys: list[str]
    a: np.ndarray
    c: np.ndarray
    held: float = 0.0
    h: np.ndarray | None = None
    burden: tuple[float, float] = (0.0, 0.0)
    z: np.ndarray | None = None
    r1: np.ndarray | None = None
    scatter: np.ndarray | None = None
    known: dict = field(default_factory=dict)

    @property
    def scores(self) -> np.ndarray:
        return self.z if self.z is not None else self.weight[:, None] * (self.a - self.cases / self.n * self.ac[:, None])


def calpha(g: GroupCounts) -> np.ndarray:
    p, m = g.cases / g.n, g.carriers[:, None]
    return ((g.c - m * p) ** 2 - m * p * (1 - p)).sum(axis=0)


def wss(g: GroupCounts) -> np.ndarray:
    f = (1 + g.ac) / (2.0 + 2 * g.n)
    return (g.a / np.sqrt(f * (1 - f))[:, None]).sum(axis=0)


def variable_threshold(g: GroupCounts) -> np.ndarray:
    order = np.argsort(g.ac, kind="stable")
    last = np.append(g.ac[order][1:] != g.ac[order][:-1], True)
    a, ac, ac2 = (np.cumsum(x[order], axis=0)[last] for x in (g.a, g.ac, g.ac2))
    some = ac2 > 0
    if not some.any():
        return np.full(g.a.shape[1], np.nan)
    return ((a[some] - g.cases / g.n * ac[some, None]) / np.sqrt(ac2[some])[:, None]).max(axis=0)


def carrier_chi(g: GroupCounts) -> np.ndarray:
    f, k, m = g.held / g.n, g.cases, g.n - g.cases
    return (g.h - k * f) ** 2 * (1 / (k * f) + 1 / (k * (1 - f)) + 1 / (m * f) + 1 / (m * (1 - f)))


def cmc(g: GroupCounts, rare: float = 0.005) -> np.ndarray:
    """Chi-square of allele sums by status, rare variants as one column; a lone column is tested by carriers."""
    few = g.ac / (2.0 * g.n) < rare
    a = np.vstack((g.a[~few], g.a[few].sum(axis=0)))
    t = np.append(g.ac[~few], g.ac[few].sum())
    a, t = a[t > 0], t[t > 0]
    if len(t) < 2:
        return carrier_chi(g)
    q = a.sum(axis=0) / t.sum()
    spread = (a**2 / t[:, None]).sum(axis=0) - 2 * q * a.sum(axis=0) + q * q * t.sum()
    return spread * (1 / q + 1 / (1 - q))


def hotelling(g: GroupCounts) -> np.ndarray:
    """F statistic of two-sample T2; a: case sums of the design's columns, scatter: their cross products.

    Cases and controls share the total scatter, so that one inverse serves all permutations: what status takes away from
    it has rank one.
    """
    n1, n0, p = g.cases, g.n - g.cases, len(g.ac)
    total = g.scatter - np.outer(g.ac, g.ac) / g.n
    d = g.a / n1 - (g.ac[:, None] - g.a) / n0
    share = n1 * n0 / g.n
    q = np.einsum("ib,ib->b", d, np.linalg.pinv(total, hermitian=True) @ d)
    t2 = (g.n - 2) * share * q / np.maximum(1 - share * q, 1e-300)
    return np.maximum(0.0, t2 * (g.n - 1 - p) / (p * (g.n - 2)))


def odds_ratio(g: GroupCounts) -> np.ndarray:
    a, b = g.h, g.held - g.h
    c, d = g.cases - a, g.n - g.cases - b
    add = np.where(np.minimum(np.minimum(a, b), np.minimum(c, d)) == 0, 0.5, 0.0)
    return (a + add) * (d + add) / ((b + add) * (c + add))


def carrier_g(g: GroupCounts) -> np.ndarray:
    """Likelihood ratio of status by carrying any variant, without covariates."""

    def cell(o: np.ndarray, e: float) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1) / e), 0.0) if e > 0 else np.zeros_like(o)

    m, k, n = g.held, g.cases, g.n
    return 2 * (cell(g.h, m * k / n) + cell(m - g.h, m * (n - k) / n) + cell(k - g.h, (n - m) * k / n) + cell(n - k - m + g.h, (n - m) * (n - k) / n))


def burden(g: GroupCounts) -> np.ndarray:
    """Squared sum of scores over its variance; 0 where nothing varies."""
    p, (b, bb) = g.cases / g.n, g.burden
    r1 = g.r1 if g.r1 is not None else np.full(g.a.shape[1], p * (1 - p) * (bb - b * b / g.n))
    return np.where(r1 > 0, g.scores.sum(axis=0) ** 2 / np.maximum(r1, 1e-300), 0.0)


def skat(g: GroupCounts) -> np.ndarray:
    return (g.scores**2).sum(axis=0)


def allele_ratio(a: np.ndarray, b: np.ndarray, na: float | np.ndarray, nb: float | np.ndarray, cap: float) -> np.ndarray:
    """Log likelihood ratio of separate frequencies of a among na and b among nb, the second capped, against a common one; 0
    where a is 0."""

    def part(alt: np.ndarray, ref: np.ndarray, f: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(alt == 0, 0.0, alt * np.log(f)) + np.where(ref == 0, 0.0, ref * np.log(1 - f))

    f = (a + b) / (na + nb)
    return np.where(a == 0, 0.0, part(b, nb - b, np.minimum(b / nb, cap)) + part(a, na - a, a / na) - part(a, na - a, f) - part(b, nb - b, f))


def site_likelihood(g: GroupCounts, cap: float) -> np.ndarray:
    """The ratio of case and control alleles at each site."""
    return allele_ratio(g.a, g.ac[:, None] - g.a, 2.0 * g.cases, 2.0 * (g.n - g.cases), cap)


def site_scores(g: GroupCounts, cap: float) -> np.ndarray:
    """Site scores after weight and floor."""
    w = g.weight[:, None]
    with np.errstate(divide="ignore"):
        raw = 2 * (site_likelihood(g, cap) + np.log(np.maximum(w, 0)))
    return np.where((w <= 0) | (raw < 0) | (g.a == 0), 0.0, raw)


def vaast(g: GroupCounts, penalty: float, cap: float) -> np.ndarray:
    """Sum of the site scores beyond the penalty."""
    floored = site_scores(g, cap)
    return np.where(floored > penalty, floored - penalty, 0.0).sum(axis=0)


MERGED = 5  # sites in a sub-group; the last one takes what is left, up to nine


def merged_sum(a: np.ndarray, c: np.ndarray, weight: np.ndarray, keys: list[str], score: np.ndarray, na: float, nb: float, limit: float, cap: float, penalty: float) -> np.ndarray:
    """What scores exceed the penalty by, after rare sites are merged greedily in sub-groups, the best first, in all
    permutations side by side; a, c: case and control alleles, sites x permutations."""
    n, width = score.shape
    back = np.empty(n, np.int64)
    back[sorted(range(n), key=lambda k: keys[k], reverse=True)] = np.arange(n)
    wide = lambda v: np.broadcast_to(v[:, None], score.shape)
    order = np.lexsort((wide(back), -score, wide(-weight)), axis=0)
    of = lambda m: np.take_along_axis(m, order, axis=0)
    beyond = lambda s: np.where(s > penalty, s - penalty, 0.0)
    merging = (of(a) <= limit) & (of(score) > 0)
    out = np.where(merging, 0.0, beyond(of(score))).sum(axis=0)
    count = merging.sum(axis=0)
    if not count.any():
        return out
    groups = np.maximum(count // MERGED, 1)
    place = np.cumsum(merging, axis=0) - 1
    group = np.minimum(place // MERGED, groups - 1)
    site, perm = np.nonzero(merging)
    member = np.full((groups.max(), 2 * MERGED - 1, width), -1)
    member[group[site, perm], (place - MERGED * group)[site, perm], perm] = order[site, perm]
    perms = np.arange(width)
    pick = lambda m, at: np.where(at >= 0, m[at, perms], 0.0)
    member = np.take_along_axis(member, np.argsort(np.where(member >= 0, score[member, perms], -np.inf), axis=1, kind="stable"), axis=1)
    top = member[:, -1]
    alleles, others, w, best, sites = pick(a, top), pick(c, top), np.where(top >= 0, weight[top], 1.0), pick(score, top), np.ones(top.shape)
    for k in range(member.shape[1] - 2, -1, -1):
        at = member[:, k]
        if not (at >= 0).any():
            break
        more_a, more_c, more_w = alleles + pick(a, at), others + pick(c, at), w * weight[at]
        all_a, all_c = (sites + 1) * na, (sites + 1) * nb
        with np.errstate(divide="ignore", invalid="ignore"):
            more = np.maximum(2 * (allele_ratio(more_a, more_c, all_a, all_c, cap) + np.log(np.maximum(more_w, 0))), 0.0)
        more = np.where((more_a == 0) | ((all_a - more_a) * more_c > (all_c - more_c) * more_a) | (more_w <= 0), 0.0, more)
        wins = (at >= 0) & (more > best)
        out += np.where((at >= 0) & ~wins, beyond(pick(score, at)), 0.0).sum(axis=0)
        changes = (more_a, alleles), (more_c, others), (more_w, w), (more, best), (sites + 1, sites)
        alleles, others, w, best, sites = (np.where(wins, new, old) for new, old in changes)
    return out + beyond(best).sum(axis=0)


def vaast_grouped(g: GroupCounts, limit: float, cap: float, penalty: float, by_type: bool) -> np.ndarray:
    """Scores after merging rare sites, among all or among those of a type."""
    na, nb = 2.0 * g.cases, 2.0 * (g.n - g.cases)
    b = g.ac[:, None] - g.a
    score = np.where((na - g.a) * b > (nb - b) * g.a, 0.0, site_scores(g, cap))
    types = np.array(g.types)
    sets = [np.flatnonzero(types == t) for t in sorted(set(g.types))] if by_type else [np.arange(len(types))]
    return sum(merged_sum(g.a[at], b[at], g.weight[at], [g.keys[k] for k in at], score[at], na, nb, limit, cap, penalty) for at in sets)


def stat_of(g: GroupCounts, config: AssocConfig) -> np.ndarray:
    """The method's statistic for every permutation of a block."""
    match config.method:
        case "CALPHA":
            return calpha(g)
        case "WSS":
            return wss(g)
        case "VT":
            return variable_threshold(g)
        case "CMC":
            return hotelling(g) if config.hotellings else cmc(g, config.cmcmaf)
        case "CMC1df":
            return odds_ratio(g)
        case "RVT2":
            return carrier_g(g)
        case "BURDEN":
            return burden(g)
        case "SKAT":
            return skat(g)
        case "VAAST":
            if config.group_size:
                return vaast_grouped(g, config.group_size, config.soft_maf_filter, config.site_penalty, config.grouping == "by_type")
            return vaast(g, config.site_penalty, config.soft_maf_filter)
    raise ValueError(f"no statistic of counts for {config.method}")
