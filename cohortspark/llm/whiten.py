"""Whitening components of embeddings by shifted Cholesky QR.

Entries are scaled and floored to integers; the fit list holds each distinct integer vector once.  Its centred rows A are
orthogonalised in passes: each pass sums Gram matrices over partitions, the driver takes the Cholesky factor of the Gram matrix
plus a small shift (which makes it safe for ill-conditioned and dependent columns), and the next pass solves the triangular
systems in its tasks, so that Q = A R1^-1 R2^-1 ... is never stored.  The factors are composed, R = ... R2 R1, and the Gram
matrix G of the last Q, near the identity or a projection, corrects what the shifts leave: A'A = R'GR exactly, so that the
singular values and right vectors of G^(1/2) R are those of A.  Only sums and d x d matrices reach the driver.

Null vectors, empty ones, and those with null or non-finite entries are dropped; ones shorter than the longest count as zero
beyond their end.  Repeated rows and ties each get their own results and count once in the fit list.  A component without
variance (a constant table, fewer vectors than components) has a null whitened value; explained is null if no vector varies.
An empty table gives an empty result.  Extra columns are ignored.  A deviation that doesn't fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import save

SCALE = 256
COMPONENTS = 4
PASSES = 8  # at most; three do for all but badly scaled data
SETTLED = 1e-12
BLOCK_ROWS = 4_096
EPS = float(np.finfo(np.float64).eps)


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) saved: floor(scale * entry) of each vector whose entries are all finite."""
    source = table.select(table[id_col].alias("vec_id"), table[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return save(source.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite).select("vec_id", F.transform("v", lambda c: F.floor(scale * c)).alias("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of longs, zero beyond a row's end."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            piece = batch.slice(at, BLOCK_ROWS)
            yield piece, matrix(piece.column("x"), width)


def summed(rows: DataFrame, width: int, kind: str, part: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """The sum of part(rows of a block) over all blocks: within tasks first, then cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches, width):
            add = part(x).ravel()
            total = add if total is None else total + add
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    found = rows.mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(cells, np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r.cell] = r.value
    return out


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor in turn, by substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def shifted_factor(gram: np.ndarray, rows: int) -> np.ndarray:
    """The Cholesky factor (upper) of a Gram matrix of `rows` rows, shifted by what rounding may take away."""
    d = len(gram)
    shift = 11 * (rows * d + d * (d + 1)) * EPS / 2 * np.trace(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


class Whitening:
    """n, sums S, right vectors (columns) with variances e, and the total variance."""

    def __init__(self, n: int, sums: np.ndarray, vectors: np.ndarray, variances: np.ndarray, total: float):
        self.n, self.sums, self.vectors, self.variances, self.total = n, sums, vectors, variances, total

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding leaves of none."""
        return self.variances > 1e-13 * self.total

    def projected(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.variances, 1)), np.nan)
        # x - S / n with one rounding only.
        return ((self.n * x - self.sums).astype(np.float64) / self.n) @ self.vectors / scale


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of saved vectors (vec_id, x), and the fit list (None if it is empty)."""
    fit_list = save(vectors.select("x").distinct())
    n, width = fit_list.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None, fit_list
    sums = summed(fit_list, width, "long", lambda x: x.sum(axis=0), width)
    factors: list[np.ndarray] = []

    def gram() -> np.ndarray:
        known = list(factors)

        def part(x: np.ndarray) -> np.ndarray:
            q = solved((n * x - sums).astype(np.float64) / n, known)
            return q.T @ q

        return summed(fit_list, width, "double", part, width * width).reshape(width, width)

    g = gram()
    for _ in range(PASSES):
        if not np.trace(g) or factors and np.abs(g @ g - g).max() < SETTLED:
            break
        factors.append(shifted_factor(g, n))
        g = gram()
    r = np.eye(width)
    for factor in factors:
        r = factor @ r
    values, basis = np.linalg.eigh(g)
    root = np.sqrt(np.maximum(values, 0))[:, None] * basis.T
    _, singular, right = np.linalg.svd(root @ r)
    variances = singular**2 / n
    k = min(components, width)
    return Whitening(n, sums, right[:k].T.copy(), variances[:k], float(variances.sum())), fit_list


def whitened_columns(rows: DataFrame, model: Whitening, width: int) -> DataFrame:
    """The whitened values w0, w1, ... of rows (x)."""
    names = [f"w{k}" for k in range(len(model.variances))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in blocks(batches, width):
            w = model.projected(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, k])) for k in range(w.shape[1])], names=names)

    return rows.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))


def identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of the usable whitened columns minus the identity (covar_pop centres first)."""
    names = [f"w{k}" for k in np.flatnonzero(model.usable)]
    if not names:
        return None
    w = whitened_columns(fit_list, model, len(model.sums))
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    row = w.agg(*(F.covar_pop(a, b) for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs, strict=True))


def deviations(centred: np.ndarray) -> list[int]:
    """Sums of squares of rows of longs, exactly."""
    if not centred.size or float(np.abs(centred).max()) ** 2 * centred.shape[1] < 2**62:
        return (centred * centred).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in centred.tolist()]


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per vector and component: n, deviation, whitened value, explained share, and the fit's identity error."""
    vectors = integer_vectors(table, id_col, vector_col, scale)
    model, fit_list = fit(vectors, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(fit_list, model)
    width, k = len(model.sums), len(model.variances)
    shares = [float(v) / model.total if model.total else None for v in model.variances]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, width):
            rows = len(x)
            w = model.projected(x)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, np.int64)),
                pa.array(np.repeat(np.array(deviations(model.n * x - model.sums), np.int64), k)),
                pa.array(w.ravel(), from_pandas=True),
                pa.array(shares * rows, pa.float64()),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
