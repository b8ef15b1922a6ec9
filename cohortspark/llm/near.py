"""Groups of near duplicates: texts whose sets of word shingles are similar (Jaccard), found whole.

Texts with equal words are one class.  Every class gets a SimHash; the trie self-join links fingerprints within the Hamming
budget, and what it links is verified against the centre of its component, so that large families of copies become few
components at little cost.  Then every other link is found exactly:

* Coverage.  A set similar to another one by t shares at least t of its own shingles.  Shingles of a single text cannot be
  shared, so that a text with fewer than t shared shingles has no partner: most of a corpus leaves here, first by a part of
  its shingles alone.
* Prefixes.  With shingles in order of their frequency, the rarest first, two similar sets of n and more shingles share one
  of the first n - ceil(t n) + 1 of each.  A text is compared with the centre of each such shingle's texts first (a star:
  linear in the family), then texts of different components are compared in pairs: those of a shingle's largest component
  with the others, and the others with each other.
* Pairs are ruled out where they meet: by their sizes, by the shingle's places, and by the Hamming distance of parity sketches,
  which never exceeds the number of shingles that only one of both sets has.  What is left is verified on the sets themselves.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than a shingle make one shingle, none make none.  All texts
without words are one class.  Rows of a group stand behind the one with the smallest doc_id (nulls last, then any one row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import few, placed, save, slices, space_words, spread_join, texts
from .simhash import components, link_fingerprints, majority, shingle_hashes

SKETCH_WORDS = 8  # 64-bit words of a parity sketch
TRIE_BUDGET = 2
STARS = 2
LOOKED = 4  # one shingle in so many (a power of two) is looked at first, when most texts leave
SKETCH = [f"b{k}" for k in range(SKETCH_WORDS)]
HEAD = ("row", "root", "n", "place", *SKETCH)  # what a text brings to each shingle where it meets others


def class_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys = [xxhash.xxh128_digest(b" ".join(space_words(t))) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary())], names=["row", "doc_id", "key"])


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether each of the sketch's cells holds an odd number of the set's hashes."""
    cells = np.bincount((shingles % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def some_shingles(size: int) -> Callable:
    """Per text: its number of shingles, and those among them that the first look takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(space_words(t), size)) for t in texts(batch, "text")]
            some = [s[s & np.uint64(LOOKED - 1) == 0] for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in some]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*some, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(s) for s in sets], pa.int32()), lists], names=["row", "n", "shingles"])

    return run


def shingle_sets(size: int) -> Callable:
    """Per text: its number of shingles, SimHash, parity sketch and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(space_words(t), size)) for t in texts(batch, "text")]
            sizes = np.array([len(s) for s in sets], np.int32)
            prints = np.array([majority(s)[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            bits = np.array([parity_sketch(s) for s in sets], np.int64).reshape(-1, SKETCH_WORDS)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
            columns = [batch.column("row"), pa.array(sizes), pa.array(prints), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH_WORDS)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "fp", *SKETCH, "shingles"])

    return run


def similar_sizes(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def near_sketches(similarity: float) -> Column:
    """Whether two sets (u_n, v_n) can be similar: no more cells of their parity sketches differ than shingles may."""
    apart = sum(F.bit_count(F.col(f"u_{b}").bitwiseXOR(F.col(f"v_{b}"))) for b in SKETCH)
    return apart * (1 + similarity) <= (1 - similarity) * (F.col("u_n") + F.col("v_n")) + 1e-6


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough: by size and sketch first, then by the sets."""

    def of(side: str, *columns: str) -> DataFrame:
        return sets.select(F.col("row").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))

    met = spread_join(spread_join(pairs, of("u", "n", *SKETCH), "u"), of("v", "n", *SKETCH), "v")
    likely = save(met.where(similar_sizes(F.col("u_n"), F.col("v_n"), similarity) & near_sketches(similarity)).select("u", "v"))
    whole = spread_join(spread_join(likely, of("u", "shingles"), "u"), of("v", "shingles"), "v")
    both = F.size(F.array_intersect("u_shingles", "v_shingles"))
    n = F.size("u_shingles") + F.size("v_shingles")
    return save(whole.where(both * (1 + similarity) >= similarity * n - 1e-9).select("u", "v"))


def found_elsewhere(each: DataFrame) -> DataFrame:
    """(row, found): how many of a text's shingles (row, shingle) another row has too.  each is shuffled once."""
    dealt = each.repartition("shingle")
    again = dealt.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1").select("shingle")
    return dealt.join(again, "shingle", "left_semi").groupBy("row").agg(F.count("*").alias("found"))


def missing(similarity: float) -> Column:
    """How many of a text's n shingles a similar text may lack."""
    return F.col("n") - F.ceil(similarity * F.col("n") - 1e-9)


def may_have_partners(some: DataFrame, similarity: float) -> DataFrame:
    """The rows of some (row, n, shingles: a part of each text's) of whose shingles not too many are in one text only."""
    counts = found_elsewhere(some.select("row", F.explode("shingles").alias("shingle")))
    known = some.select("row", "n", F.size("shingles").alias("seen")).where("n > 0").join(counts, "row", "left")
    return save(known.where(F.col("seen") - F.coalesce("found", F.lit(0)) <= missing(similarity)).select("row"))


def covered(sets: DataFrame, similarity: float) -> DataFrame:
    """(row, n) of the texts that share enough shingles with other texts left, until hardly any more leave."""
    left = sets.select("row", "n").where("n > 0")
    before, size = 0, left.count()
    while size and size != before:
        counts = found_elsewhere(few(left).join(sets.select("row", "shingles"), "row").select("row", F.explode("shingles").alias("shingle")))
        left = save(left.join(counts, "row").where(F.col("n") - F.col("found") <= missing(similarity)).select("row", "n"))
        before, size = size, left.count()
        if size > 0.9 * before:
            break
    return left


def prefixes(sets: DataFrame, left: DataFrame, similarity: float) -> DataFrame:
    """(shingle, row, n, place): the shared shingles among the first of each text left, the rarest first."""
    each = few(left).join(sets.select("row", "shingles"), "row").select("row", "n", F.explode("shingles").alias("shingle")).repartition("shingle")
    shared = each.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    met = each.join(shared, "shingle").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("known"))
    # What is in one text only comes first, and is not listed.
    first = F.col("n") - F.size("known")
    listed = met.select("row", "n", first.alias("first"), F.posexplode(F.slice("known", F.lit(1), F.greatest(missing(similarity) + 1 - first, F.lit(0)).cast("int"))))
    return save(listed.select(F.col("col.shingle").alias("shingle"), "row", "n", (F.col("first") + F.col("pos")).alias("place")))


def near_places(similarity: float) -> Column:
    """Whether two sets with a shingle at such places (u_place, v_place) can be similar: what comes before and after it, at most."""
    n, m, i, j = (F.col(c) for c in ("u_n", "v_n", "u_place", "v_place"))
    most = F.least(i, j) + F.least(n - i, m - j)
    return similar_sizes(n, m, similarity) & (most * (1 + similarity) >= similarity * (n + m) - 1e-6)


def pairs_of(many: DataFrame, others: DataFrame, similarity: float, once: bool = False) -> DataFrame:
    """Pairs of rows with a shingle in common, in different components, that sizes, places and sketches leave possible.

    once: both sides are the same rows, of which each pair meets in one order.
    """
    side = lambda df, s: df.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in HEAD))
    possible = (F.col("u_root") != F.col("v_root")) & near_places(similarity) & near_sketches(similarity)
    if once:
        possible &= F.col("u_row") < F.col("v_row")
    met = spread_join(side(many, "u"), side(others, "v"), "shingle").where(possible)
    return met.select(F.least("u_row", "v_row").alias("u"), F.greatest("u_row", "v_row").alias("v")).distinct()


def with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with root: the smallest row that links reach."""
    if not links.head(1):
        return rows.withColumn("root", F.col("row"))
    found = components(links)
    return save(rows.join(few(found), rows.row == found.node, "left").drop("node").withColumn("root", F.coalesce("root", "row")))


def mixed(heads: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of shingles that are found in several components, with the sketches of their sets."""
    several = heads.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    return save(heads.join(several, "shingle", "left_semi").join(sets.select("row", *SKETCH), "row"))


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of rows with at least the similarity."""
    linked = link_fingerprints(sets.where("n > 0").select("fp").distinct(), TRIE_BUDGET)
    member = save(spread_join(sets.where("n > 0").select("row", "fp"), linked.select("fp", F.col("root").alias("top")), "fp").select("row", "top"))
    centre = member.groupBy("top").agg(F.min("row").alias("v"), F.count("*").alias("size")).where("size > 1").select("top", "v")
    links = verified(save(spread_join(member, centre, "top").where("row <> v").select(F.col("row").alias("u"), "v")), sets, similarity)
    heads = prefixes(sets, covered(sets, similarity), similarity)
    for star in range(STARS):
        left = mixed(with_roots(heads, links), sets)
        if not left.head(1):
            return links
        pick = F.min(F.struct(*HEAD)) if star % 2 == 0 else F.max(F.struct(*HEAD))
        centres = left.groupBy("shingle").agg(pick.alias("c")).select("shingle", "c.*")
        links = links.unionByName(verified(save(pairs_of(left, centres, similarity)), sets, similarity))
    left = mixed(with_roots(heads, links), sets)
    largest = left.groupBy("shingle", "root").agg(F.count("*").alias("size")).groupBy("shingle").agg(F.max_by("root", "size").alias("main"))
    tagged = save(spread_join(left, largest, "shingle"))
    most, others = tagged.where("root = main").drop("main"), tagged.where("root <> main").drop("main")
    pairs = pairs_of(most, others, similarity).unionByName(pairs_of(others, others, similarity, once=True)).distinct()
    return links.unionByName(verified(save(pairs), sets, similarity))


def duplicate_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(file, at, row, kept_row) of the rows that a kept row of their group stands for; docs has file, at, doc_id and text.

    Rows are numbered in one job, which saves the numbers; later jobs find rows by file and place.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("file", "at", "doc_id").alias("doc_id"), "text")
    keyed = known.mapInArrow(class_keys, f"row long, doc_id struct<file:long,at:long,doc_id:{kind}>, key binary")
    each = save(keyed.select("row", "doc_id.*", "key"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "file", "at")
    classes = save(each.groupBy("key").agg(F.min(first).alias("first")).select("key", "first", F.col("first.row").alias("row")))
    node = few(classes.select("row", F.col("first.file").alias("file"), F.col("first.at").alias("at")))
    chosen = docs.join(node, ["file", "at"]).select("row", "text")
    some = save(chosen.mapInArrow(some_shingles(shingle), "row long, n int, shingles array<bigint>"))
    left = may_have_partners(some, similarity)
    schema = "row long, n int, fp long, " + ", ".join(f"{b} long" for b in SKETCH) + ", shingles array<bigint>"
    sets = save(chosen.join(few(left), "row").mapInArrow(shingle_sets(shingle), schema))
    rooted = with_roots(classes, similar_links(sets, similarity))
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    of_key = save(spread_join(rooted.select("key", "root"), kept, "root").select("key", F.col("kept.row").alias("kept_row")))
    return spread_join(each.select("row", "file", "at", "key"), of_key, "key").where("row <> kept_row").select("file", "at", "row", "kept_row")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows that another row of their group of near duplicates stands for; all columns kept.

    Null and empty texts are one group; repeated rows and rows without an id count as copies; an empty table stays empty.
    """
    known = placed(docs)
    gone = save(duplicate_rows(known.select("file", "at", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), shingle, similarity).select("file", "at"))
    return known.join(few(gone), ["file", "at"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
