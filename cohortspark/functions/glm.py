"""Generalized linear models fitted over all samples by passes of Spark.

The rows of a design never meet: a pass sums k x k tables, or reduces the triangular factors of the tasks' rows to one
(`triangle`: tall-skinny QR).  Dependent columns are found on the factor of the whole design, where sums of squares would
hide them; they are left out, and the rank counts for residual degrees.  A logistic fit that runs away, as under separation, is
made once more with Cauchy priors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OPTIMIZERS

EPS = 1e-10


@dataclass(frozen=True)
class Family:
    """A distribution with a link: mean and slope of the mean from the linear predictor, variance and deviance."""

    name: str
    inverse: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], np.ndarray]
    link: Callable[[np.ndarray], np.ndarray]

    def variance(self, mu: np.ndarray) -> np.ndarray:
        return mu * (1 - mu) if self.name == "binomial" else np.ones_like(mu)

    def deviance(self, y: np.ndarray, mu: np.ndarray, w: np.ndarray) -> float:
        if self.name == "gaussian":
            return float((w * (y - mu) ** 2).sum())
        mu = np.clip(mu, EPS, 1 - EPS)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(y > 0, y * np.log(y / mu), 0) + np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - mu)), 0)
        return float(2 * (w * part).sum())

    def start(self, y: np.ndarray) -> np.ndarray:
        return (y + 0.5) / 2 if self.name == "binomial" else (y if self.link(np.ones(1))[0] == 1 else np.maximum(y, 0.1))


def erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def probit(p: np.ndarray) -> np.ndarray:
    low, high = np.full_like(p, -12.0), np.full_like(p, 12.0)
    for _ in range(80):
        mid = (low + high) / 2
        less = 0.5 * (1 + erf(mid / math.sqrt(2))) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def family(name: str = "binomial", link: str | None = None) -> Family:
    clip = lambda e: np.clip(e, -30, 30)
    links = {
        ("binomial", "logit"): (lambda e: 1 / (1 + np.exp(-clip(e))), lambda e: np.maximum(1 / (2 + np.exp(clip(e)) + np.exp(-clip(e))), EPS), lambda m: np.log(m / (1 - m))),
        ("binomial", "probit"): (lambda e: np.clip(0.5 * (1 + erf(e / math.sqrt(2))), EPS, 1 - EPS), lambda e: np.maximum(np.exp(-e * e / 2) / math.sqrt(2 * math.pi), EPS), probit),
        ("binomial", "cloglog"): (lambda e: np.clip(-np.expm1(-np.exp(clip(e))), EPS, 1 - EPS), lambda e: np.maximum(np.exp(clip(e) - np.exp(clip(e))), EPS), lambda m: np.log(-np.log1p(-m))),
        ("binomial", "cauchit"): (lambda e: np.clip(0.5 + np.arctan(e) / math.pi, EPS, 1 - EPS), lambda e: np.maximum(1 / (math.pi * (1 + e * e)), EPS), lambda m: np.tan(math.pi * (m - 0.5))),
        ("binomial", "log"): (lambda e: np.clip(np.exp(clip(e)), EPS, 1 - EPS), lambda e: np.maximum(np.exp(clip(e)), EPS), np.log),
        ("gaussian", "identity"): (lambda e: e, np.ones_like, lambda m: m),
        ("gaussian", "inverse"): (lambda e: 1 / e, lambda e: -1 / (e * e), lambda m: 1 / m),
        ("gaussian", "log"): (lambda e: np.maximum(np.exp(clip(e)), EPS), lambda e: np.maximum(np.exp(clip(e)), EPS), np.log),
    }
    return Family(name, *links[name, link or {"binomial": "logit", "gaussian": "identity"}[name]])


FAN_IN = 32  # triangles that a task reduces to one


@dataclass
class Fit:
    """Coefficients (0 for columns left out), the columns kept, deviance, and whether the passes settled without priors."""

    beta: np.ndarray
    keep: np.ndarray
    deviance: float
    settled: bool
    passes: int

    @property
    def rank(self) -> int:
        return len(self.keep)


def independent(x: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Columns that are no combination of earlier ones."""
    keep: list[int] = []
    basis = np.empty((len(x), 0))
    for k in range(x.shape[1]):
        rest = x[:, k] - basis @ (basis.T @ x[:, k])
        rest -= basis @ (basis.T @ rest)
        size = np.linalg.norm(rest)
        if size > tol * np.linalg.norm(x[:, k]):
            keep.append(k)
            basis = np.column_stack((basis, rest / size))
    return np.array(keep, int)


Rows = Callable[[np.ndarray, np.ndarray], np.ndarray]


def parts(samples: DataFrame, x: str, y: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]) -> DataFrame:
    """(part, cells): what work makes of a task's rows, batch by batch on top of what it made so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            if batch.num_rows:
                wide = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                made = work(wide, batch.column("y").to_numpy(zero_copy_only=False), made)
        if made is not None:
            yield pa.RecordBatch.from_arrays([batch.column("part").slice(0, 1) if batch.num_rows else pa.array([0]), pa.array([made.tobytes()], pa.binary())], names=["part", "cells"])

    source = samples.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.spark_partition_id().cast("long").alias("part"))
    return source.mapInArrow(run, "part long, cells binary")


def reduced(rows: DataFrame, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """Cells of all parts joined to one, by a level of groups in tasks and the rest of at most FAN_IN here."""

    def run(group: pa.Table) -> pa.Table:
        return pa.table({"cells": pa.array([join([np.frombuffer(c) for c in group.column("cells").to_pylist()]).tobytes()], pa.binary())})

    found = rows.groupBy(F.pmod("part", F.lit(FAN_IN)).alias("lot")).applyInArrow(run, "cells binary").collect()
    return join([np.frombuffer(r.cells) for r in found]) if found else None


def triangle(samples: DataFrame, x: str, y: str, scaled: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The triangular factor of the matrix scaled(x, y) over all rows."""

    def of(rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(rows, mode="r")
        return np.vstack((r, np.zeros((rows.shape[1] - len(r), rows.shape[1])))) if len(r) < rows.shape[1] else r

    def work(wide: np.ndarray, target: np.ndarray, made: np.ndarray | None) -> np.ndarray:
        rows = scaled(wide, target)
        return of(rows if made is None else np.vstack((made, rows)))

    def join(cells: list[np.ndarray]) -> np.ndarray:
        width = math.isqrt(len(cells[0]))
        return of(np.vstack([c.reshape(width, width) for c in cells])).ravel()

    cells = reduced(parts(samples, x, y, work), join)
    return np.zeros((0, 0)) if cells is None else cells.reshape(math.isqrt(len(cells)), -1)


def sums(samples: DataFrame, x: str, y: str, part: Rows) -> np.ndarray:
    """The sum of part(x, y) over all rows."""
    cells = reduced(parts(samples, x, y, lambda wide, target, made: part(wide, target) + (0 if made is None else made)), lambda c: np.sum(c, axis=0))
    return np.zeros(0) if cells is None else cells


def working(fam: Family, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, working response, deviance) at a linear predictor."""
    mu, slope = fam.inverse(eta), fam.slope(eta)
    return slope**2 / np.maximum(fam.variance(mu), EPS), eta + (y - mu) / slope, fam.deviance(y, mu, np.ones(len(y)))


def distributed_fit(samples: DataFrame, y: str, x: str, kind: str = "binomial", optimizer: str = "irls", rounds: int = 25, tol: float = 1e-8, priors: bool = True) -> Fit:
    """Fit y on the columns of the array x.

    irls: normal equations of the columns as they are.  irls_qr and irls_svdnewton: in coordinates of an orthogonal basis
    of the design, from its triangular factor or that factor's singular vectors.  irls_qr_R: a triangular factor of the
    weighted rows in every round.  gradient_descent: steps along the gradient in the orthogonal basis.
    """
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"optimizer is one of {', '.join(OPTIMIZERS)}")
    fam = family(kind)
    whole = triangle(samples, x, y, lambda wide, target: wide)
    width = whole.shape[1]
    keep = independent(whole)
    r = np.linalg.qr(whole[:, keep], mode="r") if len(keep) else np.zeros((0, 0))
    if optimizer == "irls":
        basis = np.eye(len(keep))
    elif optimizer == "irls_svdnewton":
        _, s, v = np.linalg.svd(r)
        basis = v.T / s
    else:
        basis = np.linalg.inv(r)
    start = np.zeros(len(keep))

    def equations(now: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Information and right side in the basis, and the deviance."""

        def part(wide: np.ndarray, target: np.ndarray) -> np.ndarray:
            a = wide[:, keep] @ basis
            w, z, loss = working(fam, a @ now, target)
            return np.concatenate(((a.T @ (a * w[:, None])).ravel(), a.T @ (w * z), [loss]))

        cells, k = sums(samples, x, y, part), len(keep)
        return cells[: k * k].reshape(k, k), cells[k * k : -1], float(cells[-1])

    def weighted(now: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The same from the triangular factor of the weighted rows and response: its own blocks, without squares."""

        def scaled(wide: np.ndarray, target: np.ndarray) -> np.ndarray:
            a = wide[:, keep] @ basis
            w, z, loss = working(fam, a @ now, target)
            root = np.sqrt(w)[:, None]
            rows = np.hstack((a * root, z[:, None] * root, np.zeros((len(a), 1))))
            return np.vstack((rows, [*np.zeros(rows.shape[1] - 1), math.sqrt(loss)]))

        t = triangle(samples, x, y, scaled)
        k = len(keep)
        return t[:k, :k], t[:k, k], float((t[:, -1] ** 2).sum())

    def newton(now: np.ndarray, prior: bool) -> tuple[np.ndarray, float, bool, int]:
        """Rounds of weighted least squares; a step that leaves the finite numbers is halved.  prior: with rows of information."""
        scale = np.full(len(now), 2.5)
        scale[:1] = 10.0
        sigma, before, last = scale.copy(), math.inf, now
        for done in range(1, rounds + 1):
            left, right, loss = weighted(now) if optimizer == "irls_qr_R" and not prior else equations(now)
            halved = 0
            while not (math.isfinite(loss) and np.isfinite(left).all()) and halved < rounds:
                now, halved = (now + last) / 2, halved + 1
                left, right, loss = equations(now)
            if prior:
                extra = basis.T @ np.diag(1 / sigma**2) @ basis
                left = left + extra
            if abs(loss - before) <= tol * (abs(loss) + 0.1):
                return now, loss, True, done
            last, before = now, loss
            if optimizer == "gradient_descent" and not prior:
                # In an orthonormal basis weights of at most w bound the curvature: a step of 1 / w never overshoots.
                now = now + (right - left @ now) / (0.25 if kind == "binomial" else 1.0)
            else:
                now = np.linalg.solve(left, right) if optimizer == "irls_qr_R" and not prior else np.linalg.lstsq(left, right, rcond=None)[0]
            if prior:
                spread = np.diag(basis @ np.linalg.pinv(left, hermitian=True) @ basis.T)
                sigma = np.sqrt(((basis @ now) ** 2 + spread + scale**2) / 2)
        return now, before, False, rounds

    if optimizer == "gradient_descent":
        rounds, tol = 20 * rounds, 1e-4 * tol  # small steps settle slowly
    if not len(keep):
        loss = float(sums(samples, x, y, lambda wide, target: np.array([working(fam, np.zeros(len(target)), target)[2]])).sum())
        return Fit(np.zeros(width), keep, loss, True, 1)
    now, loss, settled, done = newton(start, False)
    rows = max(1.0, float(sums(samples, x, y, lambda wide, target: np.array([float(len(target))]))[0]))
    if priors and kind == "binomial" and not (settled and np.isfinite(now).all() and loss > 1e-6 * rows):
        now, loss, _, more = newton(start, True)
        settled, done = False, done + more
    beta = np.zeros(width)
    beta[keep] = basis @ now
    return Fit(beta, keep, loss, settled, done)
