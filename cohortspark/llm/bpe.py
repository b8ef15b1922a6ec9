"""BPE encoding and decoding: backtracking over longest matches, decoding by an offset table.

An Aho-Corasick automaton over all tokens gives, in one pass over a word, the longest token that starts at
each position.  The encoder takes longest matches from the left and keeps a token only if it is compatible
with the one before it, that is if merging by rank would leave exactly this pair; else it falls back to the
token's longest proper prefix, or takes back the last token and marks the position as dead.  Each position
dies at most once, so the work is linear, and the result equals that of merging by rank.  Decoding gathers
token strings out of one flat byte table through an array of offsets.

Texts are whole rows of any length; a null text is an empty one; repeated rows are encoded one by one; extra
columns are ignored.  The tokenizer file is a parameter and is read on the executors.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .runtime import slices

END = ""  # stands for the suffix that marks a word's end
MARKS = ".,;:!?%$#&*|-()\""
CACHE_WORDS = 400_000  # words whose ids a task remembers; all are forgotten when it is full
DECODE_IDS = 200_000  # ids decoded at once
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


# Ranges of letters that came with Unicode 17.
UNICODE_17_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


@functools.cache
def newer_lower_case() -> dict[int, int]:
    """Lower case of letters that Python's own Unicode tables do not know yet."""
    # Fixed values of Unicode 16 and 17: capitals and their small letters.
    table = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
    table |= {0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
    table |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
    return {c: low for c, low in table.items() if unicodedata.category(chr(c)) == "Cn"}


class WordBpe:
    """Encoder and decoder for one tokenizer file (BPE with a word-end suffix over a byte alphabet)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        own = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) and s != suffix else s
        vocab: dict[str, int] = model["vocab"]
        self.ids = {own(s): i for s, i in vocab.items()}
        self.sizes = {i: len(s) for s, i in self.ids.items()}
        self.strings = {i: s for s, i in self.ids.items()}
        self.rank = dict.fromkeys(self.strings, -1)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = (rank, whole)
            self.parts.setdefault(whole, (a, b))
            self.rank[whole] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # The library's white space is Unicode White_Space; U+001C to U+001F do not belong to it.  Its letters are
        # those of Unicode 16.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        newer = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in UNICODE_17_LETTERS)
        pattern = pattern.replace(r"[\p{L}]+", rf"(?:(?![{newer}])\p{{L}})+")
        pattern = pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]+", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{newer}])+")
        self.piece = regex.compile(pattern)
        self.alphabet = byte_alphabet()
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        by_id = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.special.items()}}
        raw = [(by_id.get(i, "") + " ").encode() for i in range(max(by_id) + 1)]
        self.offsets = np.cumsum([0, *map(len, raw)])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.chunks = Chunks(self)

    def pair_compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves this pair as it is.

        Walks back in time: undoes whichever of the two tokens at the seam was merged last, and looks for a
        merge across the seam that would have come before it (of equal ranks the left place merges first).
        """
        before = float("inf")
        while True:
            if (across := self.merged.get((left, right))) and across[0] < before:
                return False
            if self.rank[left] > self.rank[right]:
                before = self.rank[left]
                left = self.parts[left][1]
            elif self.rank[right] >= 0:
                before = self.rank[right] + 0.5
                right = self.parts[right][0]
            else:
                return True

    def prefix_of(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            s = self.strings[token]
            self.shorter[token] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)
        return self.shorter[token]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, written in the byte alphabet."""
        text = word + END
        if text in self.ids and self.rank[self.ids[text]] < 0:
            return [self.ids[text]]
        size = len(text)
        longest: list[int | None] = [None] * size
        lengths = [0] * size
        for end, (n, token) in self.automaton.iter(text):
            if n > lengths[end + 1 - n]:
                lengths[end + 1 - n], longest[end + 1 - n] = n, token
        dead = bytearray(size + 1)
        dead[size - 1] = 1  # the end mark never stands alone
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            if token is None:
                if not tokens:
                    raise ValueError(f"no encoding for {word!r}")
                dead[at] = 1
                token = tokens.pop()
                at -= self.sizes[token]
            end = at + self.sizes[token]
            if not dead[end] and (not tokens or self.fits(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at] if at < size else None
            else:
                token = self.prefix_of(token)
        return tokens

    def fits(self, left: int, right: int) -> bool:
        """pair_compatible, remembered."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self.pair_compatible(left, right)
        return known

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer, as native (little-endian) unsigned 32-bit integers."""
        plain = piece.isascii() and piece.isprintable()
        return array("I", self.encode_word(piece if plain else "".join([self.alphabet[b] for b in piece.encode()]))).tobytes()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces; most chunks are a word, with a mark at the end or without."""
        if text.isalpha():
            return [text]
        if text[:-1].isalpha() and text[-1] in MARKS:
            return [text[:-1], text[-1]]
        if not text.isascii():
            text = text.translate(newer_lower_case())
        return self.piece.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; strings of special tokens become those tokens, as by default in the library."""
        if "<|" not in text:
            return self.encode_plain(text)
        return b"".join(
            np.array([self.special[s]], "<u4").tobytes() if s in self.special else self.encode_plain(s)
            for s in self.split_special.split(text)
        )

    def encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            # Each capital has its own lower case; str.lower alone would turn a last sigma into another letter.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split only
            return b"".join(map(self.encode_piece, self.pieces(text)))
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        chunks = self.chunks
        return b"".join([chunks[w] for w in text.split()])

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """Blocks of the decoded text in UTF-8: token strings, one space between them."""
        all_ids = np.frombuffer(ids, "<u4")
        for at in range(0, len(all_ids), DECODE_IDS):
            part = all_ids[at : at + DECODE_IDS]
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            places = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
            block = self.flat[places].tobytes()
            yield block[:-1] if at + DECODE_IDS >= len(all_ids) else block


class Chunks(dict):
    """Ids of white-space separated chunks, encoded when first asked for; no piece crosses white space."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        pieces = self.bpe.pieces(chunk)
        if len(chunk) > 200:
            return b"".join(map(self.bpe.encode_piece, pieces))
        # A piece by itself is cut no further, so that it is remembered like a chunk.
        ids = self[chunk] = self.bpe.encode_piece(chunk) if pieces == [chunk] else b"".join([self[p] for p in pieces])
        return ids


@functools.cache
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def digests(bpe: WordBpe, text: str) -> tuple[int, str, str, bytes]:
    ids = bpe.encode(text)
    decoded = hashlib.sha256()
    for block in bpe.decode(ids):
        decoded.update(block)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), ids


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: number of ids and digests of the ids and of the text decoded from them; with_ids also the ids (token_ids).

    Null and empty texts have no ids; repeated rows and rows without an id are encoded one by one; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in slices(batches):
            rows = [digests(bpe, t or "") for t in batch.column("text").to_pylist()]
            n, ids, decoded, packed = zip(*rows, strict=True) if rows else ((), (), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                ends = pa.array(np.concatenate(([0], np.cumsum(n, dtype=np.int64))).astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<u4").astype("i4"))))
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if with_ids else [])])

    source = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}" + ", token_ids array<int>" * with_ids)


def encode_ids(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """All columns of docs and the ids of its texts as an array of integers; a column of that name is replaced."""
    docs = docs.drop(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in slices(batches):
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype("i4") for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, ids_col]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{ids_col}` array<int>")


def decode_ids(frame: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the text decoded from an array of ids (null: empty); a column of that name is replaced."""
    frame = frame.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in slices(batches):
            out = [
                b"".join(bpe.decode(np.array(x or [], "<u4").tobytes())).decode() for x in batch.column(ids_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{fields}, `{text_col}` string")
