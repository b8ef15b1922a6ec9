"""Merkle manifest of a dataset as a postorder append log.

A leaf is the digest of a document's fields.  Per tree (a language) leaves are numbered by doc_id; while several nodes remain,
each run of eight consecutive ones is hashed into its parent, the last run whatever its size.  The trees' subroots, in the
order of their languages, are the leaves of one more tree, whose root stands for the dataset.

The nodes of a tree are kept in a log in the order in which they complete (postorder).  Builders take aligned chunks of
8^LEVELS nodes; the nodes of a chunk complete one after the other, so that a builder writes one consecutive segment: rounds of
builders, each on the tops of the last, make all levels.  A node's place in its segment follows from the sizes of the subtrees
before it (`place_in`), and its place in the log likewise (`position`), so that siblings are addressed without an index: a
proof reads a leaf's siblings from its chunk's segment, then those of the chunk's top from the segment above, up to the root.

Leaves are numbered by sorted ranges whose rows are counted (`numbered`); the numbers are saved once with the digests.  No task
sees more than a range or a chunk, hot languages are cut like others, and only tree sizes by range are broadcast, behind a check.

Nulls: a field's digest input is `-` (a null language is a tree of its own, before all others; a null doc_id comes first and is
never tampered).  Rows that repeat a doc_id stand by their digests; equal rows are equal leaves, each with its own result.  A
lone leaf is its tree's subroot, a lone subroot the root.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import few, save

ARITY = 8
LEVELS = 3  # levels that a builder makes: a chunk has ARITY ** LEVELS nodes
CHUNK = ARITY**LEVELS
CHUNKS_AT_ONCE = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALL = ""  # the tree of subroots; languages are "-" for null and "=" with the language else, in their order
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few chunks, which bound what a task's Python objects take."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNKS_AT_ONCE):
            yield batch.slice(at, CHUNKS_AT_ONCE)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Shapes of trees.


def widths(size: int) -> list[int]:
    """Nodes of each level, from the leaves to the one on top."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def position(size: int, level: int, index: int) -> int:
    """The postorder place of a node of a tree with `size` leaves, in closed form.

    When the node completes, all nodes up to its level over the leaves so far have, and those above that end before it starts.
    """
    leaves = min((index + 1) * ARITY**level, size)
    below = sum(-(-leaves // ARITY**k) for k in range(level + 1))
    above = sum(index // ARITY**k for k in range(1, len(widths(size)) - level))
    return below + above - 1


def place_in(count: int, level: int, index: int, base: int) -> int:
    """A node's place in the segment of a chunk of `count` nodes, whose own nodes the segment has if base is 0, else not."""
    leaves = min((index + 1) * ARITY**level, count)
    above = sum(index // ARITY**k for k in range(1, LEVELS - level + 1))
    return sum(-(-leaves // ARITY**k) for k in range(min(base, 1), level + 1)) + above - 1


def climbed(size: int, base: int) -> int:
    """How many levels a builder at level `base` makes."""
    return min(LEVELS, len(widths(size)) - 1 - base)


def segment(hashes: list[str], levels: int, base: int) -> list[str]:
    """The nodes of a chunk in the order in which they complete: its own too at the bottom, above only those that are new."""
    out: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(level: int, h: str, last: bool) -> None:
        if level or not base:
            out.append(h)
        runs[level].append(h)
        if level < levels and (len(runs[level]) == ARITY or last):
            run, runs[level] = runs[level], []
            add(level + 1, digest(run), last)

    for k, h in enumerate(hashes):
        add(0, h, k == len(hashes) - 1)
    return out


# Numbers of leaves.


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, h, ...) saved with index and size: the row's number in its tree, by `order`, and the tree's rows.

    Ranges are sorted apart; a row's number is its place in the range and the rows of the tree in the ranges before.
    """
    spark = rows.sparkSession
    # The last key parts rows that are alike, which may be many.
    keyed = rows.withColumn("alike_", F.monotonically_increasing_id())
    ranges = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", *order, "alike_")
    # In one job: the number of a range's row is its range and its place there.
    placed = save(ranges.sortWithinPartitions("tree", *order, "alike_").drop("alike_").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = save(parts.select("tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(tree).alias("size")))
    met = placed.withColumn("part", part).join(few(starts), ["tree", "part"])
    return met.withColumn("index", F.col("at") - F.col("first") + F.col("start")).drop("at", "part", "first", "start")


# The log.


@dataclass
class Log:
    """Rounds of segments (tree, chunk, size, count, nodes), the lowest first, and tops (tree, h) of the trees."""

    rounds: list[DataFrame]
    tops: DataFrame


def build(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        chunks = batch.column("hashes").to_pylist()
        nodes = [segment(hashes, climbed(size, base), base) for hashes, size in zip(chunks, batch.column("size").to_pylist(), strict=True)]
        tops = [n[-1] for n in nodes]  # the node that completes last
        counts = pa.array([len(hashes) for hashes in chunks], pa.int32())
        columns = [batch.column("tree"), batch.column("chunk"), batch.column("size"), counts, pa.array(nodes, pa.list_(pa.string())), pa.array(tops, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "chunk", "size", "count", "nodes", "top"])


def append_log(leaves: DataFrame) -> Log:
    """The log of all trees of saved leaves (tree, index, size, h); each round is written before the next starts."""
    rounds, units, base = [], leaves.select("tree", "index", "size", "h"), 0
    levels = len(widths(leaves.agg(F.max("size")).first()[0] or 0)) - 1
    tops = units.where("size = 1").select("tree", "h")
    while not rounds or base < levels:
        chunk = F.floor(F.col("index") / CHUNK).cast("long")
        chunks = units.groupBy("tree", chunk.alias("chunk"), "size").agg(F.array_sort(F.collect_list(F.struct("index", "h"))).alias("x"))
        source = chunks.select("tree", "chunk", "size", F.col("x.h").alias("hashes"))
        made = save(source.mapInArrow(lambda b, base=base: build(b, base), "tree string, chunk long, size long, count int, nodes array<string>, top string"))
        rounds.append(made)
        base += LEVELS
        # A tree is done when one node is left.
        left = F.ceil(F.col("size") / F.pow(F.lit(ARITY), F.lit(base)))
        done = (F.col("chunk") == 0) & (left <= 1) & (F.col("size") > ARITY ** (base - LEVELS))
        tops = tops.unionByName(made.where(done).select("tree", F.col("top").alias("h")))
        units = made.where(left > 1).select("tree", F.col("chunk").alias("index"), "size", F.col("top").alias("h"))
    return Log(rounds, save(tops))


def log_nodes(log: Log) -> DataFrame:
    """(tree, position, h): the log node by node."""
    parts = []
    for r, made in enumerate(log.rounds):
        base = r * LEVELS

        def places(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                for row in batch.to_pylist():
                    levels = climbed(row["size"], base)
                    found = {}
                    for level in range(min(base, 1), levels + 1):
                        for k in range(-(-row["count"] // ARITY**level)):
                            at = place_in(row["count"], level, k, base)
                            found[at] = position(row["size"], base + level, row["chunk"] * CHUNK // ARITY**level + k)
                    order = [found[k] for k in range(len(row["nodes"]))]
                    yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(order), pa.string()), pa.array(order, pa.int64()), pa.array(row["nodes"], pa.string())], names=["tree", "position", "h"])

        parts.append(made.mapInArrow(places, "tree string, position long, h string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Proofs: level by level from the leaf, the place in the run and the run's other digests.

PATH = "array<struct<place:int,others:array<string>>>"
PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def siblings(nodes: list[str], own: list[str], count: int, levels: int, base: int, index: int) -> list[dict]:
    """The path of a chunk's node up to its top, read from the segment by closed-form places."""
    path = []
    for level in range(levels):
        first = index // ARITY * ARITY
        width = -(-count // ARITY**level)
        run = range(first, min(first + ARITY, width))
        hashes = own if level == 0 and base else None
        found = [hashes[k] if hashes else nodes[place_in(count, level, k, base)] for k in run if k != index]
        path.append({"place": index - first, "others": found})
        index //= ARITY
    return path


def fold(h: str, path: list[dict]) -> str:
    """The root that a digest leads to beside the siblings of its path."""
    for step in path:
        others = step["others"]
        h = digest([*others[: step["place"]], h, *others[step["place"] :]])
    return h


def proof_digest(path: list[dict]) -> str:
    return digest([h for step in path for h in step["others"]])


def paths_below(log: Log, above: DataFrame) -> DataFrame:
    """(tree, chunk, path): the path of the top of each lowest chunk, from those of the trees' tops (tree, path)."""
    paths = above.select("tree", F.lit(0).cast("long").alias("chunk"), "path")
    for r in range(len(log.rounds) - 1, 0, -1):
        base = r * LEVELS
        below = log.rounds[r - 1].select("tree", "chunk", "top")
        own = below.groupBy("tree", F.floor(F.col("chunk") / CHUNK).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("chunk", "top"))).alias("x"))
        # Trees that end below this round bring their path along.
        here = log.rounds[r].select("tree", "chunk", "size", "count", "nodes").join(paths, ["tree", "chunk"])
        met = here.join(own.select("tree", F.col("up").alias("chunk"), F.col("x.chunk").alias("chunks"), F.col("x.top").alias("own")), ["tree", "chunk"])

        def descend(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                for row in batch.to_pylist():
                    levels = climbed(row["size"], base)
                    made = [siblings(row["nodes"], row["own"], row["count"], levels, base, k) + row["path"] for k in range(row["count"])]
                    yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * row["count"], pa.string()), pa.array(row["chunks"], pa.int64()), pa.array(made, PATH_TYPE)], names=["tree", "chunk", "path"])

        lower = met.mapInArrow(descend, f"tree string, chunk long, path {PATH}")
        # These trees have one chunk below, and none here.
        ended = paths.join(few(log.rounds[r].select("tree").distinct()), "tree", "left_anti")
        paths = save(lower.unionByName(ended))
    return paths


def prove(batches: Iterator[pa.RecordBatch], with_paths: bool) -> Iterator[pa.RecordBatch]:
    """Per leaf of a chunk: the digest of its proof, the root that its digest as found leads to, and the siblings if wanted."""
    for batch in pieces(batches):
        for row in batch.to_pylist():
            levels = climbed(row["size"], 0)
            rows = row["rows"]
            paths = [siblings(row["nodes"], [], row["count"], levels, 0, k) + row["path"] for k in range(row["count"])]
            columns = [
                pa.array([x["extra"] for x in rows], batch.schema.field("rows").type.value_type.field("extra").type),
                pa.array([row["tree"]] * len(rows), pa.string()),
                pa.array([x["h"] for x in rows], pa.string()),
                pa.array([proof_digest(p) for p in paths], pa.string()),
                pa.array([fold(x["seen"], p) for x, p in zip(rows, paths, strict=True)], pa.string()),
            ]
            names = ["extra", "tree", "h", "proof_sha256", "folded_root"]
            if with_paths:
                columns, names = [*columns, pa.array(paths, PATH_TYPE)], [*names, "path"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def proofs(leaves: DataFrame, log: Log, above: DataFrame, with_paths: bool = False) -> DataFrame:
    """(extra, tree, h, proof_sha256, folded_root, path if wanted) of each of the leaves (tree, index, size, h, seen, extra).

    folded_root is what `seen`, the digest of the leaf as it is found, leads to; path lists the siblings up to the root.
    """
    paths = paths_below(log, above)
    chunk = F.floor(F.col("index") / CHUNK).cast("long").alias("chunk")
    rows = leaves.groupBy("tree", chunk).agg(F.array_sort(F.collect_list(F.struct("index", "h", "seen", "extra"))).alias("rows"))
    met = log.rounds[0].select("tree", "chunk", "size", "count", "nodes").join(paths, ["tree", "chunk"]).join(rows, ["tree", "chunk"])
    extra = leaves.schema["extra"].dataType.simpleString()
    schema = f"extra {extra}, tree string, h string, proof_sha256 string, folded_root string" + f", path {PATH}" * with_paths
    return met.mapInArrow(lambda batches: prove(batches, with_paths), schema)


# Documents.


def encoded(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, text: Column) -> Column:
    return F.sha2(F.concat(*(encoded(text if f == "text" else docs[f]) for f in FIELDS)), 256)


@dataclass
class Manifest:
    """Numbered leaves, the log of the languages' trees, that of their subroots, and the root (null if there are no rows)."""

    leaves: DataFrame
    log: Log
    subroots: DataFrame
    upper: Log
    root: str | None


def build_manifest(docs: DataFrame, seen: Column | None = None) -> Manifest:
    """The manifest of docs; `seen` is the text as a verifier finds it (the text itself if not given)."""
    tree = F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit("-")).alias("tree")
    found = leaf_digest(docs, docs["text"] if seen is None else seen)
    rows = docs.select(tree, leaf_digest(docs, docs["text"]).alias("h"), found.alias("seen"), docs["doc_id"].alias("extra"))
    leaves = save(numbered(rows, "extra", "h"))
    log = append_log(leaves)
    tops = log.tops.select(F.lit(ALL).alias("tree"), F.col("tree").alias("extra"), "h", F.col("h").alias("seen"))
    subroots = save(numbered(tops, "extra"))
    upper = append_log(subroots)
    root = upper.tops.first()
    return Manifest(leaves, log, subroots, upper, root.h if root else None)


def manifest_proofs(manifest: Manifest, with_paths: bool = False) -> DataFrame:
    """Per document: leaf, subroot, root, proof and what the document as it is found leads to."""
    spark = manifest.leaves.sparkSession
    none = spark.createDataFrame([(ALL, [])], f"tree string, path {PATH}")
    above = save(proofs(manifest.subroots, manifest.upper, none, True).select(F.col("extra").alias("tree"), F.col("h").alias("subroot"), "path"))
    made = proofs(manifest.leaves, manifest.log, above.select("tree", "path"), with_paths)
    met = made.join(few(above.select("tree", "subroot")), "tree")
    root = F.lit(manifest.root).cast("string")
    return met.select(
        F.col("extra").alias("doc_id"), F.col("h").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"), *(["path"] if with_paths else []),
    )


def tampered(docs: DataFrame, every: int = 3) -> Column:
    """The text with A-Z lower-cased where `every` divides the crc32 of the decimal doc_id."""
    hit = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(every)) == 0
    return F.when(hit, F.translate(docs["text"], UPPER, LOWER)).otherwise(docs["text"])


def audit(docs: DataFrame) -> DataFrame:
    """The manifest's verdict on documents of which some were tampered with."""
    return manifest_proofs(build_manifest(docs, tampered(docs)))
