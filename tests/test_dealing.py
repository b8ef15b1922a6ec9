"""Dealt cases against enumeration, places against what a permutation is."""

import math
import time
from collections import Counter
from itertools import product

import numpy as np
import pytest

from cohortspark.operators.dealing import SMALL_BIN, CaseTree, binomial_law, keyed, places, sum_law, uniform


def shares(tree, blocks, draws):
    return Counter(tuple(int(k) for b in range(blocks) for k in tree.dealt(7, p, b)) for p in range(draws))


@pytest.mark.parametrize(("sizes", "odds", "starts", "cases"), [
    ([3, 4, 2], [0.3, 1.0, 4.0], [0, 3], 4),
    ([3, 2, 2, 3], [0.5, 0.5, 3.0, 3.0], [0, 1, 3, 4], 5),  # two bins, cut by blocks
    ([4, 4, 1], [1.0, 1.0, 1.0], [0, 1, 2, 3], 3),
])
def test_law_of_cases(sizes, odds, starts, cases):
    """Fisher's noncentral law of cells given their total; blocks agree on the total without seeing each other."""
    weight = {k: math.prod(math.comb(m, x) * o**x for m, x, o in zip(sizes, k, odds, strict=True)) for k in product(*(range(m + 1) for m in sizes)) if sum(k) == cases}
    total = sum(weight.values())
    tree = CaseTree(np.array(sizes), np.array(odds), np.array(starts), cases)
    draws = 12_000
    seen = shares(tree, len(starts) - 1, draws)
    assert seen.keys() <= weight.keys()
    chi = sum((seen.get(k, 0) - draws * w / total) ** 2 / (draws * w / total) for k, w in weight.items())
    freedom = len(weight) - 1
    assert chi < freedom + 4 * math.sqrt(2 * freedom) + 4


def test_extremes():
    sizes = np.array([5, 3])
    for cases, want in ((0, [0, 0]), (8, [5, 3]), (9, [5, 3]), (-1, [0, 0])):
        assert CaseTree(sizes, np.array([1.0, 2.0]), np.array([0, 2]), cases).dealt(1, 1, 0).tolist() == want
    skewed = CaseTree(sizes, np.array([1e-13, 1e13]), np.array([0, 2]), 4)
    assert all(skewed.dealt(1, p, 0).tolist() == [1, 3] for p in range(50))


def test_many_samples():
    """Ten million samples in 5,000 bins and 153 blocks: a block walks a path, and totals agree."""
    rng = np.random.default_rng(1)
    edges = np.sort(np.concatenate((rng.choice(10**7, 4_999, replace=False), np.arange(0, 10**7, 65_536), [10**7])))
    edges = np.unique(edges)
    sizes = np.diff(edges)
    starts = np.append(np.searchsorted(edges, np.arange(0, 10**7, 65_536)), len(sizes))
    tree = CaseTree(sizes, np.exp(np.linspace(-2, 1, len(sizes))), starts, 3 * 10**6)
    begin = time.time()
    for perm in range(3):
        assert sum(tree.dealt(1, perm, b).sum() for b in range(len(starts) - 1)) == 3 * 10**6
    assert time.time() - begin < 20
    visited = []
    split = tree.split
    tree.split = lambda *x: visited.append(x[:3]) or split(*x)
    tree.dealt(1, 9, 40)
    assert len(visited) <= starts[41] - starts[40] + 2 * math.ceil(math.log2(len(sizes)))


def test_laws():
    for n, p in ((1, 0.3), (40, 0.01), (300, 0.6)):
        law = binomial_law(n, p)
        want = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(law.first, law.last + 1)]
        assert np.allclose(law.p, want, rtol=1e-9) and law.p.sum() == pytest.approx(1)
    big = binomial_law(4_000_000, 0.3)
    both = sum_law(big, big)
    want = binomial_law(8_000_000, 0.3)
    low, high = max(both.first, want.first), min(both.last, want.last)
    assert np.allclose(both.p[low - both.first : high - both.first + 1], want.p[low - want.first : high - want.first + 1], atol=1e-13)


def test_places():
    """A permutation inside each bin, the same from any cut into blocks, for small and large bins."""
    starts = np.array([0, 1, 4, 5 * SMALL_BIN, 5 * SMALL_BIN + 7, 8 * SMALL_BIN + 11])
    n = int(starts[-1])
    whole = places(0, n, starts, 3, 5)
    cut = np.concatenate([places(at, min(1_000, n - at), starts, 3, 5) for at in range(0, n, 1_000)])
    assert (whole == cut).all() and sorted(whole.tolist()) == list(range(n))
    of = lambda at: np.searchsorted(starts, at, side="right")
    assert (of(whole) == of(np.arange(n))).all() and (whole != places(0, n, starts, 3, 6)).any() and (whole != np.arange(n)).mean() > 0.99
    seen = Counter(tuple(places(0, 4, np.array([0, 4]), 1, p).tolist()) for p in range(4_800))
    assert len(seen) == 24 and all(abs(c - 200) < 75 for c in seen.values())
    moved = np.array([places(0, 3 * SMALL_BIN, np.array([0, 3 * SMALL_BIN]), 2, p) for p in range(200)]) / (3 * SMALL_BIN)
    assert abs(moved.mean() - 0.5) < 0.002 and np.abs(moved.mean(axis=0) - 0.5).max() < 0.1
    assert abs(np.corrcoef(moved[:, 0], moved[:, 1])[0, 1]) < 0.3


def test_keys():
    assert keyed(1, 2)[0] != keyed(2, 1)[0] and np.array_equal(keyed(1, np.arange(3))[1:2], keyed(1, 1))
    u = uniform(5, np.arange(100_000))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.004 and abs(u.var() - 1 / 12) < 0.001
