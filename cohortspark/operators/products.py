"""Products of sparse genotype columns with matrices over the samples, for whole blocks of permutations at once.

Samples are numbered and cut into blocks of `BLOCK`.  A column (the carriers of a variant, or of any variant of a
transcript) has one row for each block that holds a carrier: positions and values.  A task takes one block of samples and
a lot of columns, works out its part of the label matrix, which is a function of (seed, permutation, block), and
multiplies.  Calls are shuffled once, when columns are packed; a block of permutations moves label sums only.  Permuted
traits are sent from their block to the one where they go, each task working out where from the same keys (`routed_traits`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.blocks import persist
from .dealing import CaseTree, places

BLOCK = 65_536  # samples in a block
CELLS = 1 << 24  # cells of a matrix that a task holds at once
LOT = 4_000_000  # entries of the columns that a task multiplies
ADDED = 1 << 22  # cells that a task adds up at once


def numbered(rows: DataFrame, *order: str, name: str = "at") -> DataFrame:
    """rows with their number from 0 in the given order: ranges are sorted apart and get offsets."""
    spark = rows.sparkSession
    placed = persist(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id()))
    part = F.shiftright("place_", 33)
    starts, at = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("size")).orderBy("part").collect():
        starts.append((r.part, at))
        at += r["size"]
    first = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part_ long, first_ long"))
    return placed.join(first, part == F.col("part_")).select(*rows.columns, (F.col("place_").bitwiseAND(2**33 - 1) + F.col("first_")).alias(name))


def sample_blocks(samples: DataFrame) -> DataFrame:
    """One row for each block of numbered samples (at, y, trait[, bin][, x][, id][, u0, v]): its columns as arrays."""
    has = samples.columns
    more = {c: F.col(c) for c in ("id", "u0", "v") if c in has}
    known = {"y": F.col("y").cast("int"), "trait": F.col("trait").cast("double"), "bin": F.col("bin").cast("int") if "bin" in has else F.lit(0), "x": F.col("x") if "x" in has else F.array(F.lit(1.0)), **more}
    row = F.struct(F.col("at").alias("at"), *(c.alias(k) for k, c in known.items()))
    packed = samples.groupBy(F.floor(F.col("at") / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("s"))
    return packed.select("block", *(F.col("s").getField(k).alias(k) for k in known))


def packed_columns(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Columns from entries (keys, at, value): one row for each key and block, positions in the block in order."""
    cell = F.struct(F.pmod("at", F.lit(BLOCK)).cast("int").alias("pos"), F.col("value").cast("double").alias("value"))
    packed = entries.groupBy(*keys, F.floor(F.col("at") / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return packed.select(*keys, "block", F.transform("c", lambda c: c.pos).alias("pos"), F.transform("c", lambda c: c.value).alias("value"))


@dataclass(frozen=True)
class Labels:
    """Which labels the samples have in permutations first to last; permutation 0 holds the labels as observed.

    Cases are dealt to cells (bin and block) by the tree, then by lot among a cell's samples.  bins: the number of the first
    sample of each odds bin, and of samples.  wide: traits change places inside their bins instead.
    """

    seed: int
    first: int
    last: int
    tree: CaseTree
    bins: np.ndarray
    rows: int = BLOCK  # samples in a block
    wide: bool = False

    @property
    def perms(self) -> range:
        return range(self.first, self.last + 1)

    def matrix(self, block: int, y: np.ndarray, trait: np.ndarray, given: list | None = None) -> np.ndarray:
        """Samples x permutations: 0 or 1, or traits."""
        out = np.zeros((len(self.perms), len(y)), np.float64 if self.wide else np.float32)
        if self.first == 0:
            out[0] = trait if self.wide else y
        if self.wide:
            for piece in given or ():
                out[piece["perm_id"] - self.first, np.frombuffer(piece["pos"], np.int32)] = np.frombuffer(piece["value"], np.float64)
            return np.ascontiguousarray(out.T)
        size = self.tree.sizes[self.tree.starts[block] : self.tree.starts[block + 1]]
        cell, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        for k, perm in enumerate(self.perms):
            if perm == 0:
                continue
            if given is not None:
                out[k] = np.frombuffer(given[perm - max(1, self.first)].encode(), np.uint8) - 48
                continue
            take, rng = self.tree.dealt(self.seed, perm, block), np.random.default_rng([self.seed, perm, block])
            if len(size) == 1:
                out[k, rng.permutation(len(y))[: take[0]]] = 1
            else:
                order = np.lexsort((rng.random(len(y)), cell))
                out[k, order[np.arange(len(y)) - start[cell] < take[cell]]] = 1
        return np.ascontiguousarray(out.T)

    def part(self, first: int, last: int) -> Labels:
        return replace(self, first=first, last=last)


@dataclass
class SampleBlock:
    """The samples of one block in a task."""

    number: int
    y: np.ndarray
    trait: np.ndarray
    x: np.ndarray
    given: list | None
    u0: np.ndarray | None = None  # residuals and variances of a null model, if the samples bring one
    v: np.ndarray | None = None

    @classmethod
    def of(cls, table: pa.Table, row: int = 0) -> SampleBlock:
        get = lambda c: table.column(c)[row].values.to_numpy(zero_copy_only=False)
        x = table.column("x")[row].values
        wide = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        given = table.column("given")[row].as_py() if "given" in table.column_names else None
        null = {c: get(c) for c in ("u0", "v") if c in table.column_names}
        return cls(table.column("block")[row].as_py(), get("y"), get("trait"), wide, given, **null)

    def labels(self, spec: Labels) -> np.ndarray:
        return spec.matrix(self.number, self.y, self.trait, self.given)


def label_cells(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, samples) of each cell in order of the samples, and each block's first cell: at most bins + blocks rows."""
    rows = blocks.select("block", F.explode("bin").alias("bin")).groupBy("block", "bin").count().orderBy("block", "bin").collect()
    number = 1 + max((r.block for r in rows), default=0)
    starts = np.searchsorted([r.block for r in rows], np.arange(number + 1))
    return np.array([r.bin for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64), starts


def routed_traits(blocks: DataFrame, spec: Labels) -> DataFrame:
    """blocks with `given`: the traits that each permutation of spec brings to a block, with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in range(table.num_rows):
                number, trait = table.column("block")[row].as_py(), table.column("trait")[row].values.to_numpy(zero_copy_only=False)
                for perm in spec.perms:
                    if perm == 0:
                        continue
                    to = places(number * spec.rows, len(trait), spec.bins, spec.seed, perm)
                    order = np.argsort(to, kind="stable")
                    block, cut = np.unique(to[order] // spec.rows, return_index=True)
                    pieces = [(to[at] % spec.rows, trait[at]) for at in np.split(order, cut[1:])]
                    columns = [
                        pa.array(block.astype(np.int32)), pa.array(np.full(len(block), perm, np.int32)), pa.array(np.full(len(block), number, np.int32)),
                        pa.array([p.astype(np.int32).tobytes() for p, _ in pieces], pa.binary()), pa.array([t.astype(np.float64).tobytes() for _, t in pieces], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "perm_id", "source", "pos", "value"])

    sent = blocks.select("block", "trait").mapInArrow(run, "block int, perm_id int, source int, pos binary, value binary")
    given = sent.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("perm_id", "source", "pos", "value"))).alias("given"))
    return persist(blocks.join(given, "block"))


@dataclass(frozen=True)
class Layout:
    """Numbered samples, their blocks, how many there are, and the labels that all permutations share."""

    index: DataFrame
    blocks: DataFrame
    number: int
    base: Labels

    def columns(self, entries: DataFrame, keys: list[str]) -> DataFrame:
        """Packed columns of entries (keys, sample_id, value)."""
        return persist(packed_columns(entries.join(self.index.select("sample_id", "at"), "sample_id"), keys))


def lay_out(samples: DataFrame, cases: int, seed: int, quantitative: bool = False, odds: np.ndarray | None = None) -> Layout:
    """Layout of samples (sample_id, y, trait[, bin][, x][, u0, v]), numbered by bin first; odds: of each bin."""
    index = persist(numbered(samples, *(["bin"] if "bin" in samples.columns else []), "sample_id"))
    blocks = persist(sample_blocks(index))
    bins, sizes, starts = label_cells(blocks)
    tree = CaseTree(sizes, odds[bins] if odds is not None else np.ones(len(bins)), starts, cases)
    edges = np.concatenate((tree.upto[:-1][np.diff(bins, prepend=-1) > 0], tree.upto[-1:]))
    return Layout(index, blocks, max(1, len(starts) - 1), Labels(seed, 1, 0, tree, edges, BLOCK, quantitative))


def column_sums(pos: pa.ListArray, value: pa.ListArray, matrix: np.ndarray, weights: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """columns x weightings x matrix columns: weights turns a column's values into rows of weightings."""
    pos, value = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (pos, value))
    ends = pos.offsets.to_numpy() - pos.offsets[0].as_py()
    at, v = pos.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
    step = max(1, CELLS // matrix.shape[1])
    out = None
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        w = weights(v[lo:hi]).astype(matrix.dtype)
        total = sum(w[:, s : s + step] @ matrix[at[lo + s : min(hi, lo + s + step)]] for s in range(0, hi - lo, step))
        if out is None:
            out = np.zeros((len(ends) - 1, *total.shape), matrix.dtype)
        out[k] = total
    return np.zeros((0, 1, matrix.shape[1]), matrix.dtype) if out is None else out


def both_counts(v: np.ndarray) -> np.ndarray:
    """Weightings of a column: its values, and one for each carrier."""
    return np.vstack((v, v > 0))


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())


def narrow(rows: np.ndarray) -> pa.Array:
    """Rows as binary with a first byte for the kind of their cells: whole numbers travel in one or two bytes."""
    rows = np.ascontiguousarray(rows)
    kind = 8
    if rows.size and rows.min() >= 0 and (most := rows.max()) < 1 << 16 and (rows == np.floor(rows)).all():
        kind = 1 if most < 1 << 8 else 2
    rows, head = rows.astype(KINDS[kind]), bytes([kind])
    return pa.array([head + r.tobytes() for r in rows], pa.binary())


KINDS = {1: np.uint8, 2: np.uint16, 8: np.float64}


def lots(columns: DataFrame, blocks: int, keys: list[str], width: int = 1) -> tuple[DataFrame, int, int]:
    """columns with their lot, and the numbers of lots to multiply and to add: tasks for every core, none with more than LOT
    entries on average, with results (width numbers a column) of more than CELLS, or with more than ADDED cells to add."""
    entries, rows = columns.agg(F.sum(F.size("pos")), F.count("*")).first()
    cores = columns.sparkSession.sparkContext.defaultParallelism
    count = max(1, -(-cores // blocks), -(-(entries or 0) // (blocks * LOT)), -(-rows * width // (blocks * CELLS)))
    return columns.withColumn("lot", F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")), count, max(count, -(-rows * width // ADDED))


def product(columns: DataFrame, blocks: DataFrame, number: int, keys: list[str], work: Callable[[SampleBlock, pa.Table], dict[str, np.ndarray]], names: list[str], width: int = 1) -> DataFrame:
    """(keys, names as binary): what work makes of each column in each block of samples, added over blocks.

    work(sample block, columns) gives for each name an array of columns x cells (float64 or float32), about width in all.
    """
    dealt, count, groups = lots(columns, number, keys, width)
    everywhere = blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    kinds = ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys)
    schema = kinds + ", " + ", ".join(f"{n} binary" for n in names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({**{k: left.column(k).slice(0, 0) for k in keys}, **{n: pa.array([], pa.binary()) for n in names}})
        found = work(SampleBlock.of(right), left)
        return pa.table({**{k: left.column(k) for k in keys}, **{n: packed(found[n].astype(np.float64)) if number == 1 else narrow(found[n]) for n in names}})

    parts = dealt.groupBy("block", "lot").cogroup(everywhere.groupBy("block", "lot")).applyInArrow(run, schema)
    return parts if number == 1 else added(parts, keys, names, schema, groups)


def added(parts: DataFrame, keys: list[str], names: list[str], schema: str, count: int) -> DataFrame:
    """Narrow rows of equal keys added up, cell by cell."""

    def run(group: pa.Table) -> pa.Table:
        frame = group.select(keys).to_pandas()
        number, _ = pd.factorize(pd.MultiIndex.from_frame(frame.astype(str).where(frame.notna(), "")))
        firsts = np.unique(number, return_index=True)[1]
        out = {k: group.column(k).take(pa.array(firsts)) for k in keys}
        for n in names:
            total = None
            for at, x in zip(number, group.column(n), strict=True):
                x = x.as_py()
                cells = np.frombuffer(x, KINDS[x[0]], offset=1)
                if total is None:
                    total = np.zeros((len(firsts), len(cells)))
                total[at] += cells
            out[n] = packed(total)
        return pa.table(out)

    dealt = parts.withColumn("lot", F.pmod(F.xxhash64(*keys), F.lit(count)))
    return dealt.groupBy("lot").applyInArrow(run, schema)


def refit(blocks: DataFrame, spec: Labels, start: np.ndarray, rounds: int = 25, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, information and deviance of the null model for each permutation: one logistic fit for all of them, by
    sums over blocks.

    A permutation whose fit is not finite or runs away is fitted once more with Cauchy priors (scale 2.5, the intercept's
    10), as rows of prior information.
    """
    k, b = len(start), len(spec.perms)
    beta = np.tile(start, (b, 1)).astype(float)

    def sums(now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for row in range(table.num_rows):
                    s = SampleBlock.of(table, row)
                    y = s.labels(spec)
                    eta = np.clip(s.x @ now.T, -30, 30)
                    mu = 1 / (1 + np.exp(-eta))
                    v = np.maximum(mu * (1 - mu), 1e-10)
                    cross = (s.x[:, :, None] * s.x[:, None, :]).reshape(len(s.x), -1)
                    info, score = v.T @ cross, (y - mu).T @ s.x
                    loss = -2 * (y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))).sum(axis=0)
                    cells = np.hstack((info, score, loss[:, None])).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["k", "v"])

        total = blocks.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        cells = np.zeros(b * (k * k + k + 1))
        cells[total["k"].to_numpy()] = total["v"].to_numpy()
        cells = cells.reshape(b, -1)
        return cells[:, : k * k].reshape(b, k, k), cells[:, k * k : -1], cells[:, -1]

    def newton(now: np.ndarray, prior: bool) -> np.ndarray:
        scale = np.full(k, 2.5)
        scale[0] = 10.0
        sigma, before = np.tile(scale, (b, 1)), np.full(b, np.inf)
        for _ in range(rounds):
            info, score, loss = sums(now)
            if prior:
                info = info + np.einsum("bi,ij->bij", 1 / sigma**2, np.eye(k))
                score = score - now / sigma**2
            inverse = np.linalg.pinv(info, hermitian=True)
            now = now + np.einsum("bij,bj->bi", inverse, score)
            if prior:
                sigma = np.sqrt((now**2 + np.einsum("bii->bi", inverse) + scale**2) / 2)
            if np.all(np.abs(loss - before) <= tol * (np.abs(loss) + 0.1)):
                break
            before = loss
        return now

    beta = newton(beta, False)
    lost = ~np.isfinite(beta).all(axis=1) | (np.abs(beta) > 1e3).any(axis=1)
    if lost.any():
        beta[lost] = newton(np.where(lost[:, None], 0.0, beta), True)[lost]
    info, _, loss = sums(beta)
    return beta, info, loss


def refit_linear(blocks: DataFrame, spec: Labels, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual sums of squares of the linear null model for each permutation of the traits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for row in range(table.num_rows):
                s = SampleBlock.of(table, row)
                y = s.labels(spec)
                cells = np.concatenate(((s.x.T @ s.x).ravel(), (s.x.T @ y).ravel(), (y * y).sum(axis=0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["k", "v"])

    total = blocks.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
    b = len(spec.perms)
    inverse, xy = np.linalg.pinv(total[: k * k].reshape(k, k), hermitian=True), total[k * k : k * k + k * b].reshape(k, b)
    beta = (inverse @ xy).T
    return beta, np.maximum(total[k * k + k * b :] - np.einsum("bk,kb->b", beta, xy), 0.0)
