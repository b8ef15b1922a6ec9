"""Sums over calls of a gene's variants, for many labels or null models at once; cross products of those that share a sample.

A task takes one block of samples and the packed columns of some genes.  It gives each gene's sums and pairs of variants as
arrays, a row for each tile of models, so that neither rows of pairs nor copies of calls travel.  A group's task adds up
what the blocks bring, for its own variants.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.blocks import persist
from .products import KINDS, Layout, SampleBlock, lots, narrow

PAIRS = 1 << 22  # pairs of calls made at a time
ABOUT = 16  # pairs that a variant has in a block, for sizing tasks only


def added_up(keys: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their columns of cells."""
    known, at = np.unique(keys, return_inverse=True)
    return known, np.stack([np.bincount(at, row, len(known)) for row in cells])


def linked(column: np.ndarray, pos: np.ndarray, value: np.ndarray, n: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys one * n + two with one <= two, null models x keys): sums over samples of both values times v, from calls in
    order of their samples.

    Pairs are made and added PAIRS at a time; a sample's own are made together.
    """
    ends = np.searchsorted(pos, pos, side="right")
    counts = ends - np.arange(len(pos))
    upto = np.cumsum(counts)
    keys, cells, low = np.zeros(0, np.int64), np.zeros((v.shape[1], 0)), 0
    while low < len(pos):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, side="right")))
        some = counts[low:high]
        first = np.repeat(np.arange(low, high), some)
        second = first + np.arange(len(first)) - np.repeat(np.cumsum(some) - some, some)
        i, j = column[first], column[second]
        made = value[first] * value[second]
        more = np.minimum(i, j).astype(np.int64) * n + np.maximum(i, j)
        more, sums = added_up(more, np.stack([made * v[pos[first], k] for k in range(v.shape[1])]))
        keys, cells = (more, sums) if not len(keys) else added_up(np.concatenate((keys, more)), np.hstack((cells, sums)))
        low = high
    return keys, cells


def numbered_in_gene(members: DataFrame) -> DataFrame:
    """(gene, variant_id, slot) of members (gene, variant_id, ...)."""
    order = Window.partitionBy("gene").orderBy("variant_id")
    return persist(members.select("gene", "variant_id").distinct().select("gene", "variant_id", (F.row_number().over(order) - 1).cast("int").alias("slot")))


def gene_sums(columns: DataFrame, layout: Layout, sides: Callable[[SampleBlock], tuple[np.ndarray, np.ndarray]], models: int, each: int) -> DataFrame:
    """(gene, tile, slot, sums, one, two, cross as binary) from packed columns (gene, slot, block, pos, value), for each block
    of samples and tile of `each` null models.

    sides(block) gives what scores add up and the samples' variances, samples x models.  sums: models x (score, products
    with the covariates) x variants; cross: models x pairs.
    """
    dealt, count, _ = lots(columns, layout.number, ["gene"], models * ABOUT)
    everywhere = layout.blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    schema = pa.schema([("gene", pa.string()), ("tile", pa.int32()), *((c, pa.binary()) for c in ("slot", "sums", "one", "two", "cross"))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            s = SampleBlock.of(right)
            u, v = sides(s)
            genes = left.column("gene")
            for gene in pc.unique(genes):
                mine = left.filter(pc.equal(genes, gene)).combine_chunks()
                slot, n = mine.column("slot").to_numpy().astype(np.int32), mine.num_rows
                column = np.repeat(np.arange(n), pc.list_value_length(mine.column("pos")).to_numpy())
                pos, value = (pc.list_flatten(mine.column(c)).to_numpy() for c in ("pos", "value"))
                order = np.argsort(pos, kind="stable")
                column, pos, value = column[order], pos[order], value[order]
                for tile, at in enumerate(range(0, models, each)):
                    some = slice(at, min(at + each, models))
                    held, of = v[pos, some], value[:, None]
                    parts = [u[pos, some] * of, *(held * (value * s.x[pos, j])[:, None] for j in range(s.x.shape[1]))]
                    sums = np.array([[np.bincount(column, p[:, k], n) for p in parts] for k in range(held.shape[1])])
                    keys, cells = linked(column, pos, value, n, v[:, some])
                    arrays = slot, sums, slot[keys // n], slot[keys % n], cells
                    rows.append({"gene": gene.as_py(), "tile": tile, **dict(zip(schema.names[2:], (a.tobytes() for a in arrays), strict=True))})
        return pa.Table.from_pylist(rows, schema)

    kinds = "gene string, tile int, slot binary, sums binary, one binary, two binary, cross binary"
    return dealt.groupBy("block", "lot").cogroup(everywhere.groupBy("block", "lot")).applyInArrow(run, kinds)


def group_sums(found: pa.Table, slots: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, models x width x variants, one, two, models x pairs) of a group's variants that have calls, from the rows that
    blocks of samples bring for a gene and tile; pairs by place, one <= two."""
    ints = lambda c, row: np.frombuffer(found.column(c)[row].as_buffer(), np.int32)
    doubles = lambda c, row, wide: np.frombuffer(found.column(c)[row].as_buffer(), np.float64).reshape(-1, *wide)
    order = np.argsort(slots)
    slots, weight = slots[order], weight[order]
    held = np.unique(np.concatenate([ints("slot", row) for row in range(found.num_rows)]))
    kept = np.isin(slots, held)
    slots, weight = slots[kept], weight[kept]
    n = len(slots)
    place = np.full(max(int(held[-1]), int(slots[-1]) if n else 0) + 1, -1, np.int64)
    place[slots] = np.arange(n)
    total, keys, cells = None, [], []
    for row in range(found.num_rows):
        at = place[ints("slot", row)]
        part = doubles("sums", row, (width, len(at)))
        if total is None:
            total = np.zeros((len(part), width, n))
        total[:, :, at[at >= 0]] += part[:, :, at >= 0]
        i, j = place[ints("one", row)], place[ints("two", row)]
        both = (i >= 0) & (j >= 0)
        one, two = np.minimum(i, j)[both], np.maximum(i, j)[both]
        keys.append(one * n + two)
        cells.append(doubles("cross", row, (len(i),))[:, both])
    known, cross = (keys[0], cells[0]) if len(keys) == 1 else added_up(np.concatenate(keys), np.hstack(cells))
    return weight, total, known // max(n, 1), known % max(n, 1), cross


def group_tests(members: DataFrame, sums: DataFrame, tiles: int, work: Callable[[dict, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], width: int, schema: str, spread: Callable[..., DataFrame]) -> DataFrame:
    """What work(group, tile, weights, sums, one, two, cross) makes of each group (gene, transcript) and tile; members (gene,
    transcript, slot, weight) travel packed."""
    keys = ["gene", "transcript", "tile"]
    packed = members.groupBy("gene", "transcript").agg(F.collect_list(F.struct("slot", F.col("weight").cast("double").alias("weight"))).alias("m"))
    packed = persist(packed).select("gene", "transcript", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.col("m.slot").alias("slots"), F.col("m.weight").alias("weights"))
    groups = packed.select(F.col("gene").alias("own"), F.col("transcript").alias("part"))
    each = sums.join(F.broadcast(groups.distinct()), F.col("gene") == F.col("own"))  # a gene's sums serve its transcripts
    each = each.select("gene", F.col("part").alias("transcript"), *(c for c in sums.columns if c != "gene"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table | None:
        if not left.num_rows or not right.num_rows:
            return work({}, 0, *[np.zeros(0)] * 5)
        slots, weight = (left.column(c)[0].values.to_numpy() for c in ("slots", "weights"))
        group = {c: left.column(c)[0].as_py() for c in ("gene", "transcript")}
        return work(group, left.column("tile")[0].as_py(), *group_sums(right, slots, weight, width))

    return spread(packed, *keys).groupBy(*keys).cogroup(spread(each, *keys).groupBy(*keys)).applyInArrow(run, schema)


def gene_counts(columns: DataFrame, layout: Layout, work: Callable[[SampleBlock, pa.Table], dict[str, np.ndarray]], names: list[str], models: int, piece: int, each: int) -> tuple[DataFrame, int]:
    """(gene, piece, tile, slot and names as binary) from packed columns (gene, slot, block, pos, value): what work makes of
    them (columns x models) in each block of samples, a row for each piece of so many slots and tile of `each` models; and the
    number of tasks.

    Slots travel as steps, whole numbers in one or two bytes behind one that tells their kind.
    """
    dealt, count, _ = lots(columns.withColumn("piece", F.floor(F.col("slot") / piece).cast("int")), layout.number, ["gene", "piece"], models * len(names))
    everywhere = layout.blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    schema = pa.schema([("gene", pa.string()), ("piece", pa.int32()), ("tile", pa.int32()), ("slot", pa.binary()), *((c, pa.binary()) for c in names)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            s = SampleBlock.of(right)
            order = left.select(["gene", "piece", "slot"]).append_column("row", pa.array(np.arange(left.num_rows))).sort_by([(c, "ascending") for c in ("gene", "piece", "slot")])
            left = left.take(order.column("row"))
            gene = pc.dictionary_encode(left.column("gene").combine_chunks()).indices.to_numpy()
            part = left.column("piece").to_numpy()
            found = work(s, left)  # once, as it makes the block's labels
            edges = np.flatnonzero(np.concatenate(([True], (gene[1:] != gene[:-1]) | (part[1:] != part[:-1]), [True])))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                mine = left.slice(low, high - low)
                steps = np.diff(mine.column("slot").to_numpy(), prepend=0).astype(np.int32).tobytes()
                head = {"gene": mine.column("gene")[0].as_py(), "piece": int(part[low]), "slot": steps}
                rows += [{**head, "tile": k, **{c: narrow(found[c][low:high, at : at + each].reshape(1, -1))[0].as_py() for c in names}} for k, at in enumerate(range(0, models, each))]
        return pa.Table.from_pylist(rows, schema)

    kinds = ", ".join(["gene string", "piece int", "tile int", "slot binary", *(f"{c} binary" for c in names)])
    return dealt.groupBy("block", "lot").cogroup(everywhere.groupBy("block", "lot")).applyInArrow(run, kinds), layout.number * count


def counts_of(found: pa.Table, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(slots in order, slots x models by name) of rows of gene_counts, added up over blocks; whole numbers stay whole."""
    slots = [np.cumsum(np.frombuffer(x.as_buffer(), np.int32)) for x in found.column("slot")]
    known = np.unique(np.concatenate(slots))
    out = {}
    for c in names:
        cells = [np.frombuffer(x.as_buffer(), KINDS[x.as_buffer()[0]], offset=1) for x in found.column(c)]
        whole = all(x.dtype != np.float64 for x in cells)
        out[c] = np.zeros((len(known), len(cells[0]) // max(1, len(slots[0]))), np.uint32 if whole else np.float64)
        for at, x in zip(slots, cells, strict=True):
            out[c][np.searchsorted(known, at)] += x.reshape(len(at), -1)
    return known, out
