"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are 64-bit SimHashes of word shingles.  Distinct fingerprints form a binary trie.  The top of the trie
is cut at a depth that grows with the logarithm of their number: each node at that depth is joined with itself
(`within`), then with the later nodes whose path differs in few enough bits (`across`); the differing bits so far
count against the Hamming budget of the traversal below (`trie_pairs`), which walks pairs of nodes level by level and
drops a pair when its budget is spent.  Only links between the components found inside nodes leave the second step,
so that a large group of near copies gives few rows.  Components are closed by label propagation with pointer
jumping; documents get theirs through their fingerprint, so that exact copies never meet as pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Null or empty texts have the fingerprint zero; rows with equal
ids or texts keep their rows; a null id never is the smallest id (a group with only null ids has a null component).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import save, slices, space_words, spread_join, texts

SEED = 42
NODE_LEAVES = 512  # fingerprints in a node where the trie is cut, on average
FAN_OUT = 32  # pairs of leaves below which two nodes are compared leaf by leaf
PAIRS_AT_ONCE = 1_000_000


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words than size make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    ends = [e + k for k, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(size, len(words)) - 1 :]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, last, strict=False)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (n rows of 64-bit words) have each bit set."""
    rows = hashes.reshape(len(hashes), -1)
    total = np.zeros(64 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 255 * 256):
        bits = np.unpackbits(rows[at : at + 255 * 256].view(np.uint8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        total += bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.int64)
    return total


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words whose bits are set in over half of the rows."""
    return np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    hashes = shingle_hashes(space_words(text), shingle)
    return int(majority(hashes)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and fingerprint (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def leaf_pairs(na: np.ndarray, a0: np.ndarray, nb: np.ndarray, b0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of leaves of node pairs (sizes and first leaves), in blocks."""
    sizes = na * nb
    reach = np.cumsum(sizes)
    total, at = int(reach[-1]) if len(reach) else 0, 0
    while at < total:
        k = np.arange(at, min(total, at + PAIRS_AT_ONCE))
        node = np.searchsorted(reach, k, "right")
        k -= reach[node] - sizes[node]
        yield a0[node] + k // nb[node], b0[node] + k % nb[node]
        at += PAIRS_AT_ONCE


def trie_pairs(a: np.ndarray, b: np.ndarray, depth: int, spent: np.ndarray | int, budget: int, same: bool) -> Iterator[tuple]:
    """Index pairs (into a and b, both sorted) whose values differ in at most budget bits, in blocks.

    A node is a range of leaves that share the bits above a level; pairs of nodes start at the given depth, one for
    each distinct path in b, with the bits spent so far.  same: a is b, and only pairs i < j are wanted.
    """
    if not len(a) or not len(b):
        return
    top = b >> np.uint64(64 - depth) if depth else np.zeros(len(b), np.uint64)
    b0 = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    b1 = np.append(b0[1:], len(b))
    a0, a1 = np.zeros_like(b0), np.full_like(b0, len(a))
    err = np.broadcast_to(spent, len(b))[b0] if np.ndim(spent) else np.full(len(b0), spent)

    def split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        bit = np.uint64(1 << (63 - level))
        return np.clip(np.searchsorted(v, (v[lo] & ~np.uint64(2 * int(bit) - 1 if level else 2**64 - 1)) | bit), lo, hi)

    for level in range(depth, 65):
        small = (a1 - a0) * (b1 - b0) <= FAN_OUT if level < 64 else np.ones(len(a0), bool)
        for i, j in leaf_pairs((a1 - a0)[small], a0[small], (b1 - b0)[small], b0[small]):
            if same:
                i, j = i[i < j], j[i < j]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            yield i[near], j[near]
        a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            return
        am, bm = split(a, a0, a1, level), split(b, b0, b1, level)
        child = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        crossed = (am, a1, b0, bm, err + 1)
        if same:  # of a node with itself, the crossed pair of children comes once
            other = a0 != b0
            crossed = tuple(x[other] for x in crossed)
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*child, crossed, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (err <= budget)
        a0, a1, b0, b1, err = (x[keep] for x in (a0, a1, b0, b1, err))


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the components of i and j; a label is its component's smallest index."""
    while True:
        li, lj = label[i], label[j]
        apart = li != lj
        if not apart.any():
            return
        i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
        np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def ordered(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(values.to_numpy(zero_copy_only=False)).view(np.uint64)


def within(group: pa.Table, depth: int, budget: int) -> pa.Table:
    """Each fingerprint of one node and the smallest one of its component inside the node."""
    fp = np.sort(ordered(group.column("fp").combine_chunks()))
    label = np.arange(len(fp))
    for i, j in trie_pairs(fp, fp, depth, 0, budget, same=True):
        unite(label, i, j)
    return pa.table({"fp": fp.view(np.int64), "part": fp[label].view(np.int64)})


def across(group: pa.Table, depth: int, budget: int) -> pa.Table:
    """Links between components of one node (its own rows) and components of later nodes."""
    fp, part = (ordered(group.column(c).combine_chunks()) for c in ("fp", "part"))
    spent = group.column("spent").to_numpy()
    order = np.argsort(fp)
    fp, part, spent = fp[order], part[order], spent[order]
    own = spent == 0
    a, pa_, b, pb = fp[own], part[own], fp[~own], part[~own]
    parts, number = np.unique(part, return_inverse=True)
    na, nb = number[own], number[~own]
    label = np.arange(len(parts))
    for i, j in trie_pairs(a, b, depth, spent[~own], budget, same=False):
        unite(label, na[i], nb[j])
    linked = np.flatnonzero(label != np.arange(len(parts)))
    return pa.table({"u": parts[linked].view(np.int64), "v": parts[label[linked]].view(np.int64)})


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected links (u, v): root is the smallest reachable node.

    Each round takes the smallest label of the neighbours, then follows labels of labels; rounds grow with the
    logarithm of the longest path.  Every round is written to shared storage.
    """
    both = save(links.select("u", "v").union(links.select("v", "u")).distinct())
    labels = save(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")))
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("low"))
        step = labels.join(near, labels.node == near.u).select("node", F.least("root", "low").alias("next"), "root")
        step = save(step)
        up = step.select(F.col("node").alias("next"), F.col("next").alias("higher"))
        jumped = spread_join(step, up, "next", "left").select(
            "node", F.coalesce(F.least("next", "higher"), "next").alias("root"), (F.col("root") != F.col("next")).alias("moved")
        )
        jumped = save(jumped)
        labels = jumped.select("node", "root")
        if not jumped.where("moved").head(1):
            return labels


def trie_depth(n: int, leaves: int = NODE_LEAVES) -> int:
    return max(0, min(30, math.ceil(math.log2(max(1, n) / leaves))))


def masks(depth: int, budget: int) -> list[int]:
    """Nonzero differences of two paths of so many bits within the budget (two bits at most)."""
    one = [1 << k for k in range(depth)]
    found = one if budget else []
    return found + [x | y for x in one for y in one if x < y] if budget > 1 else found


def link_fingerprints(fps: DataFrame, budget: int = 2) -> DataFrame:
    """(fp, part, root) of distinct fingerprints: fps that links of at most budget (0 to 2) bits connect share a root."""
    spark = fps.sparkSession
    depth = trie_depth(fps.count())
    node = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    parts = save(
        fps.select("fp", node.alias("node"))
        .groupBy("node")
        .applyInArrow(lambda group: within(group, depth, budget), "fp long, part long")
    )
    differ = masks(depth, budget)
    if not differ:
        return parts.withColumn("root", F.col("part"))
    own = parts.select(node.alias("home"), "fp", "part", F.lit(0).alias("spent"))
    away = (
        parts.select("fp", "part", node.alias("node"), F.explode(F.array(*map(F.lit, differ))).alias("mask"))
        .select(F.col("node").bitwiseXOR(F.col("mask").cast("long")).alias("home"), "fp", "part", F.bit_count("mask").alias("spent"), "node")
        .where("home < node")
        .drop("node")
    )
    links = save(own.union(away).groupBy("home").applyInArrow(lambda group: across(group, depth, budget), "u long, v long").distinct())
    if not links.head(1):
        return parts.withColumn("root", F.col("part"))
    found = components(links)
    return parts.join(found, parts.part == found.node, "left").select("fp", "part", F.coalesce("root", "part").alias("root"))


def near_fingerprints(docs: DataFrame, shingle: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint in hexadecimal, and the smallest id reachable over links of at most budget bits."""
    each = save(fingerprints(docs, shingle, id_col, text_col))
    distinct = each.groupBy("fp").agg(F.min("id").alias("first"))
    linked = save(link_fingerprints(distinct.select("fp"), budget))
    rooted = save(distinct.join(linked.select("fp", "root"), "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = spread_join(rooted.select("fp", "root"), least, "root").select("fp", "component_id")
    return spread_join(each, save(of_fp), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
