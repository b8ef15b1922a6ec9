"""Tail probabilities as columns (JVM) and as numpy functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA = "org.apache.commons.math3.special.Gamma"
BETA = "org.apache.commons.math3.special.Beta"


def chi2_sf_col(x: Column, df: Column | float) -> Column:
    """Upper tail of chi-square; 1 at or below zero, null stays null."""
    half = (df if isinstance(df, Column) else F.lit(float(df))) / 2
    tail = F.reflect(F.lit(GAMMA), F.lit("regularizedGammaQ"), half.cast("double"), (F.greatest(x, F.lit(0.0)) / 2).cast("double"))
    return F.when(x <= 0, 1.0).when(x.isNotNull(), tail.cast("double"))


def log_gamma_col(x: Column) -> Column:
    return F.reflect(F.lit(GAMMA), F.lit("logGamma"), x.cast("double")).cast("double")


def f_sf_col(x: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of the F distribution."""
    at = df2 / (df2 + df1 * F.greatest(x, F.lit(0.0)))
    return F.reflect(F.lit(BETA), F.lit("regularizedBeta"), at.cast("double"), (df2 / 2).cast("double"), (df1 / 2).cast("double")).cast("double")


def gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, front * h)


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_isf(p: float, df: float) -> float:
    """The value whose upper tail is p, by bisection in the logarithm."""
    if p >= 1:
        return 0.0
    p = max(p, 1e-300)
    low, high = 0.0, max(1.0, df)
    while chi2_sf(high, df) > p:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_sf(mid, df) > p else (low, mid)
        if high - low <= 1e-14 * high:
            break
    return (low + high) / 2


def beta_inc(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / (d2 + d1 * x), d2 / 2, d1 / 2) if x > 0 else 1.0


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def noncentral_chi2_sf(x: float, df: float, shift: float) -> float:
    """Upper tail as a Poisson mixture of central ones, from the mode outwards."""
    if shift <= 0:
        return chi2_sf(x, df)
    mode = int(shift / 2)
    total = 0.0
    for step, start in ((1, mode), (-1, mode - 1)):
        k = start
        while k >= 0:
            weight = math.exp(-shift / 2 + k * math.log(shift / 2) - math.lgamma(k + 1))
            total += weight * chi2_sf(x, df + 2 * k)
            if weight < 1e-17:
                break
            k += step
    return min(1.0, total)


def poisson_ci(hits: float, n: float) -> tuple[float, float]:
    """95 % interval of a rate of hits in n trials, by chi-square quantiles; hits may end in a half."""
    if n <= 0:
        return 0.0, 1.0
    low = chi2_isf(0.975, 2 * hits) / (2 * n) if hits > 0 else 0.0
    return low, chi2_isf(0.025, 2 * hits + 2) / (2 * n)


def wilson(hits: float, n: float, z: float = 1.959963984540054) -> tuple[float, float]:
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return centre - half, centre + half


def hypergeometric_sf(x: int, total: int, good: int, drawn: int) -> float:
    """P(X >= x) for a hypergeometric count."""
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    low, high = max(0, drawn + good - total), min(good, drawn)
    if x <= low:
        return 1.0
    terms = [math.exp(lc(good, k) + lc(total - good, drawn - k) - lc(total, drawn)) for k in range(x, high + 1)]
    return min(1.0, math.fsum(terms))


FAINT = -60.0  # log weight, relative to the largest, from which on a law's cells are left out


def fisher_odds_ratio(a: int, b: int, c: int, d: int) -> float:
    """Conditional maximum likelihood odds ratio of [[a, b], [c, d]]: the root of E[X | odds] = a, by bisection.

    At the root X stays near a: the law's weights are log-concave, and cells whose weight is below e^FAINT of the largest are
    left out, so that work grows with the deviation of X, not with its range.
    """
    row, col, total = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - total), min(row, col)
    if low == high:
        return math.nan
    if a == low:
        return 0.0
    if a == high:
        return math.inf
    reach = int(12 / math.sqrt(sum(1 / (x + 1.0) for x in (a, b, c, d)))) + 64
    while True:
        first, last = max(low, a - reach), min(high, a + reach)
        log_odds, w = odds_within(np.arange(first, last + 1.0), row, col, total, a)
        if (first == low or w[0] < FAINT) and (last == high or w[-1] < FAINT):
            return math.exp(log_odds)
        reach *= 2


def odds_within(k: np.ndarray, row: int, col: int, total: int, a: int) -> tuple[float, np.ndarray]:
    """(log odds under which X, held to the values k, has mean a; log weights of k there, the largest 0)."""
    step = np.log((col - k[:-1]) * (row - k[:-1]) / ((k[:-1] + 1) * (total - row - col + k[:-1] + 1)))
    base, off = np.concatenate(([0.0], np.cumsum(step))), k - a

    def logs(log_odds: float) -> np.ndarray:
        w = base + off * log_odds
        return w - w.max()

    def more(log_odds: float) -> bool:
        """Whether the mean is below a."""
        return float(np.exp(logs(log_odds)) @ off) < 0

    left, right = -1.0, 1.0
    while not more(left):
        left *= 2
    while more(right):
        right *= 2
    while left < (mid := (left + right) / 2) < right:
        left, right = (mid, right) if more(mid) else (left, mid)
    return (left + right) / 2, logs((left + right) / 2)
