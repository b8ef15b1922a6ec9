"""Tails of quadratic forms in normal variables: inversion along a contour, Davies' inversion, saddlepoint, moment matching."""

from __future__ import annotations

import math

import numpy as np

from .special import chi2_isf, chi2_sf, noncentral_chi2_sf, normal_sf


LIMIT = 250_000  # terms of an inversion sum
CHUNK = 1 << 21  # cells of a piece of it


def davies_all(q: np.ndarray, lam: np.ndarray, accuracy: float = 1e-9, limit: int = LIMIT) -> tuple[np.ndarray, bool]:
    """P(sum lam_j X_j > q) for each q, X_j chi-square with one degree, by inversion of the characteristic function.

    The trapezoidal sum (1/pi) sum sin(theta(u)) / (u rho(u)) uses a step that keeps the aliasing tails below the
    accuracy and stops where the integrand's envelope does; all values share its terms.  The second value tells that the
    limit was too small.
    """
    lam = lam[lam != 0]
    if not len(lam):
        return (q < 0).astype(float), False
    scale = float(np.abs(lam).max())
    lam, q = lam / scale, np.asarray(q, float) / scale
    sd = math.sqrt(2 * (lam**2).sum())

    def tail_bound(sign: float) -> float:
        """A distance from the mean beyond which the mass is below the accuracy (Chernoff)."""
        pos = np.max(sign * lam)
        best = math.inf
        for frac in (0.5, 0.8, 0.9, 0.95, 0.99):
            t = frac / (2 * pos) if pos > 0 else 2.0 / sd
            cumulant = -0.5 * np.log1p(-2 * t * sign * lam).sum()
            best = min(best, (cumulant - math.log(accuracy / 4)) / t)
        return best

    upper, lower = tail_bound(1.0), -tail_bound(-1.0)
    span = max(upper - q.min(), q.max() - lower, upper - lower, 4 * sd)
    step = 2 * math.pi / (1.05 * span)
    # The envelope 1 / (pi u prod (1 + 4 lam^2 u^2)^(1/4)) bounds what is cut off.
    top = 1.0
    while True:
        rest = math.exp(-0.25 * np.log1p(4 * (lam * top) ** 2).sum()) * 2 / (math.pi * max(1, min(len(lam), 1 + int((np.abs(lam * top) > 1).sum()))))
        if rest < accuracy / 4 or top / step > limit:
            break
        top *= 1.2
    count = min(int(top / step) + 1, limit)
    if rest > 1e-6:
        return np.full(len(q), np.nan), True
    total = np.zeros(len(q))
    piece = max(1, CHUNK // max(len(lam), len(q)))
    for at in range(0, count, piece):
        u = (np.arange(at, min(at + piece, count)) + 0.5) * step
        w = 2 * np.outer(u, lam)
        theta = 0.5 * np.arctan(w).sum(axis=1)
        size = np.exp(-0.25 * np.log1p(w * w).sum(axis=1)) / (np.arange(at, at + len(u)) + 0.5)
        total += size @ np.sin(theta[:, None] - np.outer(u, q))
    return 0.5 + total / math.pi, False


TERMS = 12  # of the logarithm's series for weights far below the largest
SURE = 32.0  # exponent of what the rule of a contour integral leaves out


def positive_tail(q: np.ndarray, lam: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """P(sum lam_j X_j > q) for weights that are not negative, to about twelve digits of the smaller tail.

    The tail is the integral of exp(-z q) / (z prod sqrt(1 - 2 z lam_j)) along a line between 0 and the first branch point,
    the lower tail likewise left of 0.  The line is laid through the saddlepoint and bent into a parabola around the cut, on
    which the integrand falls like a Gaussian; the trapezoidal rule's step follows from how far the singularities are off.
    times: how often each weight stands in the form (see spectra).
    """
    q, lam = np.asarray(q, float), np.asarray(lam, float)
    times = np.ones(len(lam)) if times is None else times
    times, lam = times[lam > 0], lam[lam > 0]
    out = np.where(q > 0, 0.0, 1.0) if not len(lam) else np.where(np.isposinf(q), 0.0, 1.0)
    fine = np.isfinite(q) & (q > 0)
    out[np.isnan(q)] = np.nan
    if not len(lam) or not fine.any():
        return out
    w = lam / lam.max()  # the branch point is at 1/2
    x, sd = q[fine] / lam.max(), math.sqrt(2 * (times * w**2).sum())
    near, far = np.full(len(x), 1e-18), np.maximum(np.abs(times).sum() / x, 1.0) + 1.0
    rows = max(1, CHUNK // len(w))
    for _ in range(48):
        mid = np.sqrt(near * far)
        more = np.concatenate([(times * w / (1 - w + 2 * mid[k : k + rows, None] * w)).sum(axis=1) for k in range(0, len(x), rows)]) > x
        near, far = np.where(more, mid, near), np.where(more, far, mid)
    saddle, off = 0.5 - np.sqrt(near * far), min(0.25, 1 / sd)
    upper = x >= (times * w).sum()
    mu = 0.5 - np.where(upper, np.maximum(saddle, off), np.minimum(saddle, -off))
    # Along the line the integrand falls like exp(-wide u^2) at first, at last like exp(-mu q u^2).  Moved off by some distance it
    # grows by wide times its square; the rule's step allows for that, so that far tails keep their digits.  The largest weight alone
    # makes wide at least 1, and mu q 1/2, if it stands once in the form.
    rows = max(1, CHUNK // len(w))
    wide = 4 * mu * mu * np.concatenate([(times * (w / (1 - (1 - 2 * mu[k : k + rows, None]) * w)) ** 2).sum(axis=1) for k in range(0, len(x), rows)])
    clear = np.minimum(np.minimum(1.0, np.abs(np.sqrt(0.5 / mu) - 1)), np.sqrt(SURE / wide))
    step = 2 * math.pi * clear / (SURE + wide * clear * clear)
    last = np.ceil(np.sqrt((SURE + 2) / np.maximum(np.minimum(mu * x, wide), 0.5)) / step).astype(int) + 2
    found, order, at = np.empty(len(x)), np.argsort(last), 0
    while at < len(order):  # alike numbers of nodes together
        most = max(1, CHUNK // (min(len(w), 64) * int(last[order[at]])))
        some = order[at : at + most]
        some = some[last[some] <= 2 * last[some[0]]]
        at += len(some)
        m, t, h = mu[some, None], x[some, None], step[some, None]
        u = np.arange(last[some].max()) * h
        z = 0.5 - m * (1 + 1j * u) ** 2
        logs = np.zeros(z.shape, complex)
        small = w < 0.1 / np.abs(z).max()
        large, often = w[~small], times[~small]
        for k in range(TERMS if small.any() else 0, 0, -1):  # their logarithms by power sums
            logs = 2 * z * (logs - (times[small] * w[small] ** k).sum() / k)
        for j in range(0, len(large), 64):  # logarithms of 1 - 2 z w, by size and angle
            part, count = large[j : j + 64], often[j : j + 64]
            real, imag = 1 - 2 * z.real[..., None] * part, -2 * z.imag[..., None] * part
            logs += (0.5 * np.log(real * real + imag * imag) * count).sum(axis=-1) + 1j * (np.arctan2(imag, real) * count).sum(axis=-1)
        f = (np.exp(-z * t - 0.5 * logs) / z * (1 + 1j * u)).real
        found[some] = 2 * m[:, 0] / math.pi * h[:, 0] * (f.sum(axis=1) - 0.5 * f[:, 0])
    out[fine] = np.clip(np.where(upper, found, 1 + found), 0.0, 1.0)
    return out


def davies(q: float, lam: np.ndarray, accuracy: float = 1e-9, limit: int = LIMIT) -> tuple[float, bool]:
    p, fault = davies_all(np.array([q]), lam, accuracy, limit)
    return float(p[0]), fault or not math.isfinite(p[0])


def moments(lam: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[float, float, float, float]:
    """Mean, deviation, and the two shape ratios of the form."""
    c = [float((times * lam**k).sum()) for k in (1, 2, 3, 4)]
    return c[0], math.sqrt(2 * c[1]), c[2] / c[1] ** 1.5, c[3] / c[1] ** 2


def matched(lam: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[float, float, float]:
    """Degrees, shift and scale of the noncentral chi-square that matches the form's moments."""
    _, _, s1, s2 = moments(lam, times)
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        shift = s1 * a**3 - a**2
        return a * a - 2 * shift, shift, a
    return 1 / s2, 0.0, math.sqrt(1 / s2)


def liu(q: float, lam: np.ndarray, times: np.ndarray | float = 1.0) -> float:
    """Upper tail by moment matching."""
    if not (times * lam**2).sum() > 0:
        return 1.0
    mean, sd, _, _ = moments(lam, times)
    df, shift, a = matched(lam, times)
    return noncentral_chi2_sf((q - mean) / sd * math.sqrt(2) * a + df + shift, df, shift)


def liu_quantile(p: float, lam: np.ndarray, times: np.ndarray | float = 1.0) -> float:
    """The value with upper tail p: moments matched, scaled by the degrees of freedom alone."""
    mean, sd, _, _ = moments(lam, times)
    df, _, _ = matched(lam, times)
    return (chi2_isf(p if p > 0 else 1.5e-154, df) - df) / (math.sqrt(2) * df) * sd + mean


def exact_quantile(p: float, lam: np.ndarray, times: np.ndarray | None = None) -> float:
    """The value with upper tail p of a form without negative weights: the tail at 32 points at once narrows it down."""
    low, high = 0.0, float((lam if times is None else times * lam).sum())
    while positive_tail(np.array([high]), lam, times)[0] > p:
        low, high = high, 2 * high
    for _ in range(6):
        at = np.linspace(low, high, 33)
        k = int(np.flatnonzero(np.append(positive_tail(at[:-1], lam, times), 0.0) <= p)[0])
        low, high = at[max(k - 1, 0)], at[max(k, 1)]
    return (low + high) / 2


def saddlepoint(q: float, lam: np.ndarray, times: np.ndarray | float = 1.0) -> float:
    """Upper tail by Kuonen's (1999) saddlepoint approximation; moments are matched where it does not hold (at the mean).

    K(z) = -1/2 sum log(1 - 2 z lam) has a slope that grows from its limit at minus infinity (0 for positive forms) to
    infinity at the pole: K'(z) = q has one root, found by bisection on the distance to the pole.
    """
    lam = np.nan_to_num(np.asarray(lam, float))
    pole = 1 / (2 * lam.max(initial=0.0)) if lam.max(initial=0.0) > 0 else math.inf
    if not math.isfinite(pole):
        return liu(q, lam, times)
    if q <= 0 and lam.min() >= 0:
        return 1.0
    below = 1 / (2 * lam.min()) if lam.min() < 0 else -math.inf

    def slope(z: float) -> float:
        return float((times * lam / (1 - 2 * z * lam)).sum())

    # z = pole - gap: the gap is bracketed between powers of two of the pole.
    near, far = pole * 2.0**-50, pole
    while slope(pole - far) > q:
        far *= 2
        if pole - far <= below or far > pole * 2.0**60:
            return liu(q, lam, times)
    for _ in range(120):
        mid = math.sqrt(near * far)
        near, far = (mid, far) if slope(pole - mid) > q else (near, mid)
    z = pole - math.sqrt(near * far)
    exponent = z * q + 0.5 * float((times * np.log1p(-2 * z * lam)).sum())
    w = math.copysign(math.sqrt(max(2 * exponent, 0.0)), z)
    v = z * math.sqrt(2 * float((times * (lam / (1 - 2 * z * lam)) ** 2).sum()))
    if abs(w) < 1e-3 or v / w <= 0:
        return liu(q, lam, times)
    return normal_sf(w + math.log(v / w) / w)


def form_sf_all(q: np.ndarray, lam: np.ndarray, use_saddlepoint: bool = False, times: np.ndarray | None = None) -> np.ndarray:
    """Upper tails: inversion, and the saddlepoint where it fails or leaves (0, 1); forms of equal weights are chi-square."""
    q, lam = np.asarray(q, float), np.asarray(lam, float)
    large = lam[lam > lam.max(initial=0.0) * 1e-12]
    if times is None and len(large) and np.ptp(large) <= 1e-12 * large.max() and len(large) == (lam != 0).sum():
        return np.array([1.0 if math.isnan(x) else chi2_sf(x / large[0], len(large)) for x in q])
    out = np.full(len(q), np.nan)
    fine = ~np.isnan(q)
    if not use_saddlepoint and fine.any():
        if lam.min(initial=0.0) >= 0:
            p = positive_tail(q[fine], lam, times)
        else:
            p, fault = davies_all(q[fine], lam)
            p = np.where(fault, np.nan, p)
        out[fine] = np.where((p > 0) & (p < 1), p, np.nan)
    for k in np.flatnonzero(np.isnan(out)):
        out[k] = saddlepoint(float(q[k]), lam, 1.0 if times is None else times) if fine[k] else 1.0
    return out


def form_sf(q: float, lam: np.ndarray, use_saddlepoint: bool = False, times: np.ndarray | None = None) -> float:
    return float(form_sf_all(np.array([q]), lam, use_saddlepoint, times)[0])
