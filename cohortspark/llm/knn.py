"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors become integers floor(256 x).  Queries and data are grouped by their nearest pivot.  For a group of queries with
pivot c and radius R the scores of a row x lie within <c, x> - R |x| and <c, x> + R |x| (Cauchy-Schwarz), so that the
(k + 1)-th largest lower bound over all rows is one that each query's neighbours reach.  From the data groups' summaries
(radius, largest length) whole pairs of groups fall away; of the others only rows whose upper bound reaches the group's
are sent.  Groups are solved in blocks of bounded size, with one matrix product for each slice of queries; the blocks' best
rows meet in a ranking window.  Small groups share a block, so that a row is sent once to each block at most, however
little the bounds prune.

Pivots come from a bounded sample (they decide speed, never results).  Vectors that are null or hold null or
non-finite components take no part; shorter vectors are padded with zeros; an empty vector is all zeros.  Rows that
repeat an id are rows of their own: a query leaves out its own row only.  Ties go to the smaller vec_id, a null id is
last and never a query.  Scores are exact while they fit 64 bits (components saturate at 2^62).  Fewer than k
candidates give fewer rows, an empty table none.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import save

MOST_PIVOTS = 1_024  # pivots grow as the root of the rows up to here: each row meets each of them
SAMPLE = 2_000  # rows that pivots are made from
QUERY_BLOCK = 2_048  # queries in a block, on average
DATA_BLOCK = 16_384  # data rows in a block, on average
SLICE = 256  # queries whose scores are held at once
UNIT = 256


def quantized(values: list) -> np.ndarray | None:
    """floor(256 x) as int64, or None if the vector takes no part."""
    if values is None or None in values:
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    return np.clip(np.floor(UNIT * x), -(2.0**62), 2.0**62).astype(np.int64)


def quantize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [quantized(v) for v in batch.column("v").to_pylist()]
        arrays = [
            batch.column("row"),
            batch.column("vec_id"),
            pa.array([None if v is None else v.tobytes() for v in out], pa.binary()),
            pa.array([0 if v is None else len(v) for v in out], pa.int64()),
            pa.array([0 if v is None or not len(v) else float(np.abs(v).max()) for v in out], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "v", "size", "most"])


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    """Vectors as int64 rows of one width."""
    rows = [np.frombuffer(x, kind) for x in column.to_pylist()]
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of Lloyd's algorithm over the sample; neighbours in the result's order lie close together."""
    distinct = np.unique(sample, axis=0)
    pivots = distinct[:: max(1, len(distinct) // n)][:n]
    for _ in range(5):
        cell = distances(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[cell == k].mean(axis=0) if (cell == k).any() else pivots[k] for k in range(len(pivots))])
    order, left = [0], set(range(1, len(pivots)))
    while left:
        near = min(left, key=lambda k: float(((pivots[k] - pivots[order[-1]]) ** 2).sum()))
        order.append(near)
        left.remove(near)
    return pivots[order]


def assigner(shared, width: int, kind: str, every: int):
    """Cell of each row, its distance to the pivot and its length, and whether its id is a query's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            points = matrix(batch.column("v"), width, "i8")
            d = distances(points.astype(np.float64), pivots) if len(points) else np.zeros((0, 1))
            is_query = pa.array([i is not None and i % every == 0 for i in batch.column("vec_id").to_pylist()], pa.bool_())
            columns = [pa.array([x.tobytes() for x in points.astype(kind)], pa.binary()), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1)), pa.array(np.sqrt((points.astype(np.float64) ** 2).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), *columns, is_query], names=["row", "vec_id", "v", "cell", "dist", "length", "is_query"])

    return run


@dataclass
class Groups:
    """Query groups: pivot, radius, the bound that their neighbours' scores reach, and the block that they share."""

    cells: np.ndarray
    pivots: np.ndarray
    reach: np.ndarray
    bound: np.ndarray
    block: np.ndarray
    may: np.ndarray  # groups x data cells: whether any row of the cell can be a neighbour
    query_blocks: np.ndarray  # pieces that the group's block is cut into

    def lower(self, points: np.ndarray, length: np.ndarray) -> np.ndarray:
        return points @ self.pivots.T - np.outer(length, self.reach)

    def needed(self, points: np.ndarray, length: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """rows x groups: whether the row may be a neighbour of a query of the group."""
        return (points @ self.pivots.T + np.outer(length, self.reach) >= self.bound) & self.may[:, cell].T


def bounder(shared, width: int, kind: str, k: int):
    """A task's k + 1 largest lower bounds for each query group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, best = shared.value, None
        for batch in batches:
            points = matrix(batch.column("v"), width, kind).astype(np.float64)
            low = g.lower(points, batch.column("length").to_numpy())
            best = low if best is None else np.vstack((best, low))
            best = -np.sort(-best, axis=0)[: k + 1]
        if best is not None and len(best):
            at, group = np.indices(best.shape)
            yield pa.RecordBatch.from_arrays([pa.array(group.ravel().astype(np.int32)), pa.array(best.ravel())], names=["grp", "low"])

    return run


def sender(shared, width: int, kind: str):
    """Rows for each block of query groups that needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        starts = np.flatnonzero(np.concatenate(([True], g.block[1:] != g.block[:-1])))
        for batch in batches:
            points = matrix(batch.column("v"), width, kind).astype(np.float64)
            needed = g.needed(points, batch.column("length").to_numpy(), batch.column("cell").to_numpy())
            row, block = np.nonzero(np.logical_or.reduceat(needed, starts, axis=1))
            sent = batch.select(["row", "vec_id", "v"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(g.block[starts][block])], names=["row", "vec_id", "v", "grp"])

    return run


def solve(group: pa.Table, width: int, kind: str, k: int) -> pa.Table:
    """The k best data rows for each query of a block."""
    is_query = group.column("is_query").to_numpy()
    ids = np.array([2**63 - 1 if x is None else x for x in group.column("vec_id").to_pylist()], np.int64)
    null = np.array([x is None for x in group.column("vec_id").to_pylist()])
    rows = group.column("row").to_numpy()
    points = matrix(group.column("v"), width, kind)
    most = float(np.abs(points).max(initial=0))
    exact = most * most * width < 2**53
    if exact:
        points = points.astype(np.float64)
    data = np.flatnonzero(~is_query)
    data = data[np.lexsort((rows[data], ids[data], null[data]))]
    asked = np.flatnonzero(is_query)
    d = points[data]
    found: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    backward = np.arange(n - 1, -1, -1)
    for at in range(0, len(asked) if n else 0, SLICE):
        part = asked[at : at + SLICE]
        score = (points[part] @ d.T).astype(np.int64)
        own = rows[part][:, None] == rows[data][None, :]
        if exact and most * most * width * n < 2**62:  # one number that orders by score, then by id
            key = np.where(own, -(2**62), score * n + backward)
            best = np.argpartition(-key, min(k, n - 1), axis=1)[:, : k + 1] if n > k + 1 else np.broadcast_to(np.arange(n), (len(part), n))
        else:
            best = np.array([np.lexsort((np.arange(n), -s))[: k + 1] for s in score])
        for q, b in zip(range(len(part)), best, strict=True):
            b = b[~own[q, b]]
            b = b[np.lexsort((b, -score[q, b]))][:k]
            found.append((np.full(len(b), part[q]), data[b], score[q, b]))
    q, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    return pa.table({
        "query_row": pa.array(rows[q]), "query_id": pa.array(ids[q]), "row": pa.array(rows[b]),
        "vec_id": pa.array(ids[b], mask=null[b]), "score": pa.array(s, pa.int64()),
    })


@dataclass
class Placed:
    """Vectors in their cells: the rows, pivots, components of a vector, kind of their numbers, and how many rows."""

    rows: DataFrame
    centres: np.ndarray
    width: int
    kind: str
    n: int


def place(vectors: DataFrame, every: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> Placed | None:
    """Every row that takes part, in the cell of its nearest pivot; None if there are none."""
    raw = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    ready = save(raw.mapInArrow(quantize_batches, "row long, vec_id long, v binary, size long, most double").where("v is not null"))
    facts = ready.agg(F.count("*").alias("n"), F.max("size").alias("width"), F.max("most").alias("most")).first()
    if not facts.n:
        return None
    width = max(1, facts.width)
    kind = "i2" if facts.most < 2**15 else "i4" if facts.most < 2**31 else "i8"
    count = pivots or max(16, min(MOST_PIVOTS, math.isqrt(facts.n) // 4))
    sample = ready.orderBy(F.xxhash64("row", "vec_id"), "row").limit(SAMPLE).select("v").toArrow()
    centres = choose_pivots(matrix(sample.column("v"), width, "i8").astype(np.float64), count)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    rows = save(ready.mapInArrow(assigner(shared, width, kind, every), "row long, vec_id long, v binary, cell int, dist double, length double, is_query boolean"))
    return Placed(rows, centres, width, kind, facts.n)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row whose id `every` divides."""
    spark = vectors.sparkSession
    placed = place(vectors, every, id_col, vector_col, pivots)
    groups = plan_groups(placed, k) if placed else None
    if groups is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_data = max(1, -(-placed.n // DATA_BLOCK))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_data - 1).cast("long"))).alias("d_block")
    blocks = {int(b): int(n) for b, n in zip(groups.block, groups.query_blocks, strict=True)}
    cells = spark.createDataFrame([(int(c), int(b), blocks[int(b)]) for c, b in zip(groups.cells, groups.block, strict=True)], "cell int, grp int, q_blocks int")
    parts = spark.createDataFrame([(b, q) for b, n in blocks.items() for q in range(n)], "grp int, q_block int")
    # A row for each query group, and for each block of queries: small beside the data by construction.
    data = data_rows(placed, groups).join(F.broadcast(parts), "grp").select("grp", "q_block", F.pmod(F.xxhash64("row"), F.lit(n_data)).alias("d_block"), F.lit(False).alias("is_query"), "row", "vec_id", "v")
    asked = placed.rows.where("is_query").join(F.broadcast(cells), "cell").select(
        "grp", F.pmod(F.xxhash64("row"), F.col("q_blocks")).cast("int").alias("q_block"), spread, F.lit(True).alias("is_query"), "row", "vec_id", "v"
    )
    width, kind = placed.width, placed.kind
    best = data.union(asked).groupBy("grp", "q_block", "d_block").applyInArrow(lambda group: solve(group, width, kind, k), "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return best.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def plan_groups(placed: Placed, k: int) -> Groups | None:
    """The query groups with their bounds, from one pass over the data; None without queries."""
    rows, centres, spark = placed.rows, placed.centres, placed.rows.sparkSession
    asked = rows.where("is_query").groupBy("cell").agg(F.max("dist").alias("reach"), F.count("*").alias("n")).orderBy("cell").collect()
    if not asked:
        return None
    spread = rows.groupBy("cell").agg(F.max("dist").alias("radius"), F.max("length").alias("length")).collect()
    block, size, blocks, last = [], 0, [], 0
    for r in asked:  # pivots are in an order of neighbours: small groups share a block with the next ones
        if size and size + r.n > QUERY_BLOCK:
            last, size = last + 1, 0
        size += r.n
        block.append(last)
        blocks.append(size)
    sizes = {b: max(n for b2, n in zip(block, blocks, strict=True) if b2 == b) for b in set(block)}
    cells = np.array([r.cell for r in asked], np.int32)
    groups = Groups(cells, centres[cells], np.array([r.reach for r in asked]), np.full(len(asked), -np.inf), np.array(block, np.int32), np.ones((len(asked), len(centres)), bool), np.array([-(-sizes[b] // QUERY_BLOCK) for b in block]))
    low = rows.select("v", "length").mapInArrow(bounder(spark.sparkContext.broadcast(groups), placed.width, placed.kind, k), "grp int, low double")
    order = Window.partitionBy("grp").orderBy(F.desc("low"))
    slack = 1e-6 * (1 + float(np.abs(centres).max()) * max(r.length for r in spread))
    for r in low.select("grp", "low", F.row_number().over(order).alias("n")).where(F.col("n") == k + 1).collect():
        groups.bound[r.grp] = r.low - slack  # k more than the own row, which may be among them
    size = np.linalg.norm(groups.pivots, axis=1)
    for r in spread:
        top = groups.pivots @ centres[r.cell] + size * r.radius + groups.reach * r.length
        groups.may[:, r.cell] = top >= groups.bound - slack
    return groups


def data_rows(placed: Placed, groups: Groups) -> DataFrame:
    """(row, vec_id, v, grp): what each block of query groups needs."""
    shared = placed.rows.sparkSession.sparkContext.broadcast(groups)
    return placed.rows.select("row", "vec_id", "v", "cell", "length").mapInArrow(sender(shared, placed.width, placed.kind), "row long, vec_id long, v binary, grp int")
