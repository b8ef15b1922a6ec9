"""Quality rules by the frequency of lines across the documents of a host.

One pass over the texts takes each document's counts and, for every distinct normalised line, a hash and the words that
the line takes up.  A host's lines are then counted by distinct documents: rows of a host with equal texts are one document,
so that copies of an article don't make its lines common.  A line of more than ``max(least, share * documents of the host)``
documents is removed wherever it stands on that host; a document is rejected if its own counts fail (`base_failed`), or if
fewer than ``min_words`` words or less than ``min_left`` of its words are left.

Normalised: A-Z lower-cased, digits 0, everything but letters, digits and bytes above 127 a space, spaces squeezed and trimmed;
a line with nothing left is no line.  Words are ``[^\\x20\\x09-\\x0D]+``.

A null text has no words and fails; a null host is a host of its own; repeated rows each get their own result; an empty table
gives an empty result; ties can't occur (limits are compared with >); extra columns are ignored by `line_rules` and kept by
`remove_common_lines`, whatever their names.

Hot hosts and lines: counts by (host, text, line) and then by (host, line) are combined on the map side; the join that finds
a document's common lines deals hot lines to several tasks, or broadcasts the common lines where they are few; verdicts come
back to rows by the digest of host and text, so that no row needs a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, WORD_BYTES, save, slices, spread_join, texts

LEAST_DOCS = 10
SHARE = 0.1
MIN_WORDS = 50
MIN_LEFT = 0.3

SPACES = b" \t\n\v\f\r"
NOT_CODE_POINTS = SPACES + bytes(range(0x80, 0xC0))  # spaces, and bytes that continue a character
SYMBOLS = b"#*$%&|<>"
NORMAL_BYTES = bytes(48 if 48 <= c <= 57 else c for c in WORD_BYTES)

FACTS = "doc_id {id}, host string, content binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<bigint>, line_words array<int>"


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """How many words stand in windows of `size` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    codes = ids
    for k in range(1, size):  # codes stay below rows of the text times its distinct words
        codes = codes[: len(words) - k] * len(known) + ids[k:]
        codes, counts = np.unique(codes, return_inverse=True, return_counts=True)[1:]
    edges = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(counts[codes] > 1)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(NORMAL_BYTES).split())


def line_table(lines: list[bytes]) -> dict[int, int]:
    """Words of each distinct normalised line, all its places together, by its hash (as a signed long)."""
    table: dict[int, int] = {}
    for line in lines:
        if normal := normal_line(line):
            key = xxhash.xxh64_intdigest(normal)
            key -= (key >> 63) << 64
            table[key] = table.get(key, 0) + len(line.split())
    return table


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: list[tuple] = []
        keys, words_of, ends = [], [], [0]
        for text in texts(batch, "text"):
            words = text.split()
            lines = [x for x in text.split(b"\n") if x.strip()]
            table = line_table(lines)
            keys.extend(table.keys())
            words_of.extend(table.values())
            ends.append(len(keys))
            counts.append(
                (len(words), len(text.translate(None, NOT_CODE_POINTS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))
            )
        offsets = pa.array(ends, pa.int32())
        columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 5
        columns += [pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(words_of, pa.int32()))]
        names = ["doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("content"), *columns], names=names)


def content_key(host: Column, text: Column) -> Column:
    """A digest of host and text: rows that share it share their verdict."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), host), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit(""))), 256))


def meet(many: DataFrame, one: DataFrame, key: str, how: str) -> DataFrame:
    """many joined with one: by broadcast where one is small, else with hot keys of many dealt to several tasks."""
    if one.limit(BROADCAST_ROWS).count() < BROADCAST_ROWS:
        return many.join(F.broadcast(one), key, how)
    return spread_join(many, one, key, how)


def facts_of(docs: DataFrame, host: str) -> DataFrame:
    source = docs.select(docs["doc_id"].alias("doc_id"), docs[host].cast("string").alias("host"), docs["text"].alias("text"))
    source = source.select("doc_id", "host", content_key(F.col("host"), F.col("text")).alias("content"), "text")
    return save(source.mapInArrow(scan, FACTS.format(id=docs.schema["doc_id"].dataType.simpleString())))


def common_lines(facts: DataFrame, least: int, share: float) -> DataFrame:
    """(key of host and line, host, line, docs): the lines above the limit of their host."""
    sizes = facts.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    each = facts.select("host", "content", F.explode("lines").alias("line")).distinct()
    counts = each.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > least)
    sizes = save(sizes.withColumnRenamed("host", "of_host"))
    sizes = F.broadcast(sizes) if sizes.limit(BROADCAST_ROWS).count() < BROADCAST_ROWS else sizes
    met = counts.join(sizes, F.col("host").eqNullSafe(F.col("of_host")))
    return save(met.where(F.col("docs") > share * F.col("host_docs")).select(line_key().alias("key"), "host", "line", "docs", "host_docs"))


def line_key() -> Column:
    """One column for host and line: 128 bits, so that no two meet by chance."""
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit("-"))
    return F.concat(F.hex(F.xxhash64(host)), F.hex("line"))


def lost_words(facts: DataFrame, common: DataFrame) -> DataFrame:
    """(content, lost, lost_lines): the words that common lines take up in each distinct document that has any."""
    pairs = facts.select("host", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    each = pairs.select("content", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"), "host").withColumn("key", line_key())
    found = meet(each.select("content", "key", "line", "words"), common.select("key"), "key", "inner")
    once = found.groupBy("content", "line").agg(F.max("words").alias("words"))
    return save(once.groupBy("content").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("lost_lines")))


def line_rules(
    docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT
) -> DataFrame:
    """Per row its counts, whether they fail, the words that common lines take up, and the verdict."""
    facts = facts_of(docs, host)
    lost = lost_words(facts, common_lines(facts, least, share)).select("content", "lost")
    left = F.col("n_words") - F.col("n_common_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = meet(facts.drop("lines", "line_words"), lost, "content", "left").withColumn("n_common_words", F.coalesce("lost", F.lit(0)).cast("long"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hashes are listed; other lines stay as they are."""
    for batch in slices(batches):
        out = []
        for text, lost in zip(texts(batch, "text"), batch.column("lost_lines").to_pylist(), strict=True):
            if lost:
                gone = set(lost)
                text = b"\n".join(x for x in text.split(b"\n") if not gone.intersection(line_table([x])))
            out.append(text)
        at = batch.schema.get_field_index("text")
        null = batch.column("text").is_null()
        clean = pa.array(out, pa.binary()).cast(pa.string())
        yield batch.set_column(at, "text", pc.if_else(null, None, clean)).select([n for n in batch.schema.names if n != "lost_lines"])


def remove_common_lines(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """The documents with common lines taken out of their texts (a null text stays null); all columns stay, none is added."""
    facts = facts_of(docs, host)
    lost = lost_words(facts, common_lines(facts, least, share)).select("content", "lost_lines")
    # Helper columns live inside structs, so that no column of docs can clash with them.
    keyed = docs.select(content_key(docs[host].cast("string"), docs["text"]).alias("content"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    met = meet(keyed, lost, "content", "left")
    cleaned = met.select("doc", F.col("doc.text").alias("text"), "lost_lines").mapInArrow(without_lines, f"doc {keyed.schema['doc'].dataType.simpleString()}, text string")
    return cleaned.select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))

