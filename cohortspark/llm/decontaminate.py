"""Benchmark decontamination with suffix arrays of the training text.

A slice of a record batch of documents is a shard.  Its words become integers in the benchmark's vocabulary (0 for any
other word and between documents), and its suffix array holds the start of each run that can match at all,
sorted by the words that follow.  All suffixes of the benchmark items of at least a window's length are
binary-searched
in it; each range found is a list of verbatim places.  Places one after another that lie along one item are one verbatim
match: all places of a window in the benchmark are followed, so that passages that items share lose nothing.  No shuffle:
the benchmark is small beside the training text, and goes to the tasks in blocks of bounded size.  A large one takes a
narrow pass for each block; passes are saved, so that the driver holds one block at a time.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is ``window`` consecutive words
of an item; an item of fewer words, but at least one, is one window.  Null or empty texts have no words and are
clean; an empty benchmark leaves all clean; repeated items and rows count one by one, as (item_id) and as rows;
words of items with a null id are hit, but such items are neither counted nor listed.  Only id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import alnum_words, save, slices, texts

BLOCK_BYTES = 16 << 20  # of benchmark text in one block
SHARD_WORDS = 500_000  # words of documents in one suffix array, but always whole documents

SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, longest_item string"


@dataclass
class Suffixes:
    """Benchmark suffixes cut to one window length, sorted and distinct."""

    length: int
    keys: np.ndarray  # fixed-width byte strings, one for each distinct window
    place_at: np.ndarray  # where each window's places start in place_of
    place_of: np.ndarray  # places in the benchmark: words of all items one behind the other, with a gap between items


@dataclass
class Block:
    vocabulary: dict[bytes, int]
    item_ids: list[str | None]
    item_starts: np.ndarray  # place of each item's first word
    suffixes: list[Suffixes]


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def build_block(items: list[tuple[str | None, bytes]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    starts, start = [], 0
    for _, text in items:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)]
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if words else 0):
            by_length.setdefault(length, []).append((tuple(words[at : at + length]), start + at))
        starts.append(start)
        start += len(words) + 1
    suffixes = []
    for length, found in sorted(by_length.items()):
        found.sort()
        first = [k for k, (w, _) in enumerate(found) if not k or found[k - 1][0] != w]
        keys = as_keys(np.array([found[k][0] for k in first], dtype=np.int64))
        suffixes.append(Suffixes(length, keys, np.array([*first, len(found)]), np.array([p for _, p in found], dtype=np.int64)))
    return Block(vocabulary, [i for i, _ in items], np.array(starts, dtype=np.int64), suffixes)


def occurrences(ids: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows in a shard, in order, and the window at each."""
    size = len(ids) - s.length + 1
    if size <= 0 or not len(s.keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A suffix can match only if its first words all belong to the benchmark's vocabulary.
    other = np.concatenate(([0], np.cumsum(ids == 0)))
    starts = np.flatnonzero(other[s.length :] == other[:size])
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = as_keys(ids[starts[:, None] + np.arange(s.length)])
    order = np.argsort(keys, kind="stable")  # the shard's suffix array, to the depth of a window
    array, keys = starts[order], keys[order]
    low, high = np.searchsorted(keys, s.keys, "left"), np.searchsorted(keys, s.keys, "right")
    count = high - low
    which = np.repeat(np.arange(len(s.keys)), count)
    ends = np.cumsum(count)
    places = array[np.arange(ends[-1]) + np.repeat(low - (ends - count), count)]
    order = np.argsort(places, kind="stable")
    return places[order], which[order]


@dataclass
class Found:
    """What a document holds of a block: hit spans (from, to), numbers of items, and its longest match: words, place, item."""

    spans: list[tuple[int, int]]
    items: set[int]
    longest: tuple[int, int, int] = (0, -1, -1)


def scan_shard(docs: list[list[bytes]], block: Block) -> list[Found]:
    get = block.vocabulary.get
    flat: list[int] = []
    starts = []
    for words in docs:
        starts.append(len(flat))
        flat += [get(w, 0) for w in words]
        flat.append(0)
    ids = np.array(flat, dtype=np.int64)
    starts_of = np.array(starts, dtype=np.int64)
    found = [Found([], set()) for _ in docs]
    for s in block.suffixes:
        places, which = occurrences(ids, s)
        if not len(places):
            continue
        doc = np.searchsorted(starts_of, places, "right") - 1
        # Runs of places one after another are one span.
        joined = np.concatenate(([False], (doc[1:] == doc[:-1]) & (places[1:] <= places[:-1] + s.length)))
        at = np.flatnonzero(~joined)
        for a, b in zip(at, [*at[1:], len(places)], strict=True):
            found[doc[a]].spans.append((int(places[a] - starts_of[doc[a]]), int(places[b - 1] - starts_of[doc[a]] + s.length)))
        # Each place meets all of its window's places in the benchmark; along one diagonal they are one match.
        count = np.diff(s.place_at)[which]
        ends = np.cumsum(count)
        theirs = s.place_of[np.arange(ends[-1]) + np.repeat(s.place_at[which] - (ends - count), count)]
        ours, doc = np.repeat(places, count), np.repeat(doc, count)
        item = np.searchsorted(block.item_starts, theirs, "right") - 1
        for pair in np.unique(doc * len(block.item_starts) + item).tolist():
            d, i = divmod(pair, len(block.item_starts))
            found[d].items.add(i)
        order = np.lexsort((ours, ours - theirs))
        ours, theirs, doc, item = ours[order], theirs[order], doc[order], item[order]
        first = np.flatnonzero(np.concatenate(([True], (ours[1:] != ours[:-1] + 1) | (theirs[1:] != theirs[:-1] + 1))))
        size = np.diff([*first, len(ours)]) + s.length - 1
        for k in np.lexsort((-item[first], -ours[first], size)).tolist():  # the longest last; of these the earliest
            a = first[k]
            if size[k] >= found[doc[a]].longest[0]:
                found[doc[a]].longest = (int(size[k]), int(ours[a] - starts_of[doc[a]]), int(item[a]))
    return found


def shards(words: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    shard, size = [], 0
    for w in words:
        shard.append(w)
        size += len(w)
        if size >= SHARD_WORDS:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str | None, bytes]]]]:
    """How many blocks of about BLOCK_BYTES the items with words make, and the blocks; repeated rows count once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = items.select(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))

    def each() -> Iterator[list[tuple[str | None, bytes]]]:
        for k in range(n):
            part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).distinct() if n > 1 else items.distinct()
            yield sorted(((r.i, r.t.encode()) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))

    return n, each()


PARTIAL = "spans array<long>, items array<string>, longest long, place long, item string"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Per document: words, words inside occurrences of benchmark windows, the items that occur, and the longest verbatim
    match: its words, its place in the document (-1: none) and an item that holds it."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    now = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    number, blocks = benchmark_blocks(benchmark, item_col, "text")
    for k, items in enumerate(blocks):
        shared = spark.sparkContext.broadcast(items)
        if k == number - 1:
            return now.mapInArrow(scanner(shared, window, k, True, id_col), f"`{id_col}` {kind}, {SCHEMA}")
        now = save(now.mapInArrow(scanner(shared, window, k, False, id_col), f"id {kind}, text string, {PARTIAL}"))
        shared.destroy()
    raise AssertionError("there is a last block")


def scanner(shared, window: int, k: int, last: bool, id_col: str):
    """The pass over block k: adds its spans, items and longest matches to those of the blocks before; the last one sums up."""
    known = [c.split()[0] for c in PARTIAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = build_block(shared.value, window)
        for batch in slices(batches):
            before = [*zip(*(batch.column(c).to_pylist() for c in known), strict=True)] if k else []
            n_words, rows = [], []
            for shard in shards(map(alnum_words, texts(batch, "text"))):
                n_words += map(len, shard)
                rows += scan_shard(shard, block)
            out = []
            for n, row in enumerate(rows):
                spans, names = row.spans, {block.item_ids[i] for i in row.items} - {None}
                size, at, item = row.longest
                best = (size, at, block.item_ids[item] if item >= 0 else None)
                if k:
                    flat, old_names, *old = before[n]
                    spans = [*zip(flat[::2], flat[1::2], strict=True), *spans]
                    names |= set(old_names)
                    best = min(tuple(old), best, key=lambda m: (-m[0], m[1], m[2] is None, m[2] or ""))
                out.append((spans, sorted(names), *best))
            sizes = [pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64()), pa.array([r[4] for r in out], pa.string())]
            if not last:
                columns = [batch.column(0), batch.column(1), pa.array([[x for s in r[0] for x in s] for r in out], pa.list_(pa.int64())), pa.array([r[1] for r in out], pa.list_(pa.string())), *sizes]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", *known])
                continue
            n_hit = [covered(r[0]) for r in out]
            columns = [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(r[1]) for r in out], pa.int64()),
                pa.array([hashlib.sha256(",".join(r[1]).encode()).hexdigest() for r in out], pa.string()),
                pa.array([n > 0 for n in n_hit], pa.bool_()),
                *sizes,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(c.split()[0] for c in SCHEMA.split(", "))])

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, without those that hold a benchmark window; no shuffle.

    Null and empty texts stay; repeated rows are judged one by one; an empty benchmark or table changes nothing.
    """
    spark = docs.sparkSession
    now = docs
    number, blocks = benchmark_blocks(benchmark, "item_id", "text")
    for k, items in enumerate(blocks):
        shared = spark.sparkContext.broadcast(items)
        now = now.mapInArrow(keeper(shared, window, text_col), docs.schema)
        if k < number - 1:
            now = save(now)
            shared.destroy()
    return now


def keeper(shared, window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = build_block(shared.value, window)
        for batch in slices(batches):
            clean = [not row.spans for shard in shards(map(alnum_words, texts(batch, text_col))) for row in scan_shard(shard, block)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
