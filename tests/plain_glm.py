"""A plain fit on a whole design, for comparison."""

from types import SimpleNamespace

import numpy as np

from cohortspark.functions.glm import family, independent


def fit(x, y, fam=None, rounds=50):
    """Weighted least squares until the deviance settles; dependent columns get nan."""
    fam = fam or family()
    keep = independent(np.asarray(x, float))
    a, ones = np.asarray(x, float)[:, keep], np.ones(len(y))
    eta, before = fam.link(fam.start(np.asarray(y, float))), np.inf
    for _ in range(rounds):
        mu, slope = fam.inverse(eta), fam.slope(eta)
        w = np.sqrt(slope**2 / np.maximum(fam.variance(mu), 1e-10))
        beta = np.linalg.lstsq(a * w[:, None], (eta + (y - mu) / slope) * w, rcond=None)[0]
        eta = a @ beta
        now = fam.deviance(y, fam.inverse(eta), ones)
        if abs(now - before) < 1e-12 * (abs(now) + 0.1):
            break
        before = now
    full = np.full(np.shape(x)[1], np.nan)
    full[keep] = beta
    return SimpleNamespace(beta=full, mu=fam.inverse(eta), deviance=now)
