"""License scans: Aho-Corasick over words and tags, shunting-yard for licence expressions.

One pass over each whole text, no shuffle.  Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z.  An automaton over the space-joined words finds notice phrases; a second one over the
lower-cased raw text finds identifier tags, whose and/or/with expression is parsed by a shunting-yard
parser.  Null and empty texts give no words, null first/last positions, empty labels and score 0; repeated
rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import alnum_words, texts

# Base phrases of the scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases (as words), their label and how strongly one place speaks for a licence.
NOTICES = {
    "mit license": ("mit", 0.9),
    "apache license": ("apache", 0.8),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "gnu general public license": ("gpl", 0.9),
    "general public license version 2": ("gpl-2.0", 0.95),
    "general public license version 3": ("gpl-3.0", 0.95),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "creative commons": ("cc", 0.7),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc 4 0": ("cc-by-nc-4.0", 0.95),
    "cc by sa 4 0": ("cc-by-sa-4.0", 0.95),
    "cc by 4 0": ("cc-by-4.0", 0.95),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.4),
    "attribution sharealike": ("cc-by-sa", 0.7),
    "attribution noncommercial": ("cc-by-nc", 0.7),
    "gplv2": ("gpl-2.0", 0.9),
    "gplv3": ("gpl-3.0", 0.9),
    "lgplv2": ("lgpl-2.0", 0.9),
    "lgplv3": ("lgpl-3.0", 0.9),
    "agplv3": ("agpl-3.0", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
    "boost software license": ("bsl-1.0", 0.95),
    "eclipse public license": ("epl", 0.9),
    "european union public licence": ("eupl", 0.95),
    "european union public license": ("eupl", 0.95),
    "common development and distribution license": ("cddl", 0.95),
    "isc license": ("isc", 0.9),
    "zlib license": ("zlib", 0.9),
    "artistic license": ("artistic", 0.9),
    "python software foundation license": ("psf", 0.9),
    "microsoft public license": ("ms-pl", 0.9),
    "sil open font license": ("ofl", 0.95),
    "open database license": ("odbl", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
}
BASE_STRENGTH = {"cc-by": 0.8, "gpl": 0.8, "reserved": 0.5}
# Tags before an expression, and whether they stand for one by themselves: behind the others every name must be a known one.
TAGS = {"spdx-license-identifier:": True, "license-expression:": True, "license:": False, "licence:": False, '"license":': False, "licenses:": False, "license =": False}
# Public short identifiers of licences that need no rule.
KNOWN = frozenset(
    "0bsd afl-3.0 beerware bsl-1.0 cc-pddc curl fsfap ftl hpnd icu ijg imagemagick isc json libpng libtiff mit mit-0 mit-cmu ms-pl ms-rl "
    "mulanpsl-2.0 naist-2003 ncsa openssl osl-3.0 postgresql python-2.0 qpl-1.0 ruby sleepycat tcl unlicense upl-1.0 vim w3c wtfpl "
    "x11 xnet zlib blueoak-1.0.0 psf-2.0 rpl-1.5 sissl sspl-1.0 busl-1.1".split()
)
# Families of identifiers with versions.
FAMILY = re.compile(
    r"(?:a|l)?gpl-[0-9.]+(?:-only|-or-later)?\+?|gfdl-[0-9.]+(?:-(?:no-)?invariants)?(?:-only|-or-later)?|cc-by(?:-nc)?(?:-nd|-sa)?-[0-9.]+(?:-[a-z]{2,3})?|cc0-[0-9.]+|"
    r"apache-[0-9.]+\+?|bsd-[0-4]-clause(?:-[a-z-]+)?|(?:mpl|epl|eupl|cddl|cpl|lppl|artistic|afl|osl|ofl|odbl|ecl|cecill|zpl|nosl|apsl|php|ipl)-[0-9.]+(?:-[a-z-]+)?\+?|"
    r"(?:documentref-[a-z0-9.-]+:)?(?:licenseref|additionref)-[a-z0-9.-]+"
)
PERMISSIVE = frozenset(
    "mit apache apache-2.0 bsd bsd-2-clause bsd-3-clause isc zlib unlicense cc0 cc0-1.0 cc-by-4.0 public-domain".split()
)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9.+:\-]*[a-z0-9+]")
GAP = re.compile(rb"[ \t\"']*")
LINE = re.compile(rb"[ \t]*\r?\n[ \t]*(?:[#*;%]+|//+|--+)?[ \t]*")  # to the next line, behind a comment's mark
WORD = re.compile(rb"[()]|[a-z0-9.+:\-]*[a-z0-9+]")

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions string, permissive boolean"
)


def to_rpn(expression: str) -> list[str]:
    """Shunting-yard: the longest well-formed prefix of a licence expression, in reverse Polish notation.

    The empty list means that no licence stands at the start.  ``with`` binds tighter than ``and``, ``and``
    tighter than ``or``; all three are left-associative.
    """
    best: list[str] = []
    out: list[str] = []
    stack: list[str] = []
    operand_next, depth = True, 0
    for token in TOKEN.findall(expression):
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif token in PRECEDENCE:
            if operand_next:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
            continue
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = False
        if not operand_next and not depth:
            best = out + stack[::-1]
    return best


def evaluate(rpn: list[str], allowed: frozenset[str]) -> bool:
    """Whether the expression can be satisfied by allowed licences; an exception (with) never narrows a licence."""
    stack: list[bool] = []
    for token in rpn:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append({"or": left or right, "and": left and right, "with": left}[token])
        else:
            stack.append(token.removesuffix("+") in allowed)
    return bool(stack and stack[-1])


def identifiers(rpn: list[str]) -> list[str]:
    """Licence ids of an expression: its operands but the exceptions that follow ``with``."""
    stack: list[list[str]] = []
    for token in rpn:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left + right)
        else:
            stack.append([token])
    return stack[-1] if stack else []


def known(identifier: str) -> bool:
    return identifier in KNOWN or FAMILY.fullmatch(identifier) is not None


def expression_at(lowered: bytes, at: int) -> str:
    """The words of an expression behind a tag.  It goes on in the next line behind an operator or an open bracket, and
    before an operator."""
    words: list[str] = []
    while True:
        at = GAP.match(lowered, at).end()
        found = WORD.match(lowered, at)
        if found is None:
            line = LINE.match(lowered, at)
            after = line and WORD.match(lowered, line.end())
            if after is None or not (words and (words[-1] in PRECEDENCE or words[-1] == "(") or after[0].decode() in PRECEDENCE):
                return " ".join(words)
            found = after
        words.append(found[0].decode())
        at = found.end()


@functools.cache
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE_PHRASES}:
        base = BASE_PHRASES.get(phrase)
        own = NOTICES.get(phrase, (None, 0.0))
        phrases.add_word(f" {phrase} ", (len(phrase) + 1, base, *own))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for tag, sure in TAGS.items():
        tags.add_word(tag, sure)
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes) -> tuple:
    """One document's row (see SCHEMA)."""
    phrases, tags = automata()
    words = alnum_words(text)
    joined = b" " + b" ".join(words) + b" "
    n_base, first, last, word, seen = 0, None, None, 0, 0
    base_labels: set[str] = set()
    labels: set[str] = set()
    doubt = 1.0
    found = [(end - size, base, own, weight) for end, (size, base, own, weight) in phrases.iter(joined.decode("latin-1"))]
    for start, base, own, weight in sorted(found, key=lambda place: place[0]):
        word += joined.count(b" ", seen, start)
        seen = start
        if base:
            n_base += 1
            first = word if first is None else first
            last = word
            if base not in base_labels:
                doubt *= 1 - BASE_STRENGTH[base]
            base_labels.add(base)
            labels.add(base)
        if own:
            if own not in labels:
                doubt *= 1 - weight
            labels.add(own)
    expressions: set[str] = set()
    granted = bool(labels & PERMISSIVE)
    lowered = text.lower()
    for end, sure in tags.iter(lowered.decode("latin-1")) if lowered else ():
        rpn = to_rpn(expression_at(lowered, end + 1))
        if rpn and (sure or all(map(known, identifiers(rpn)))):
            expressions.add(" ".join(rpn))
            ids = identifiers(rpn)
            granted |= evaluate(rpn, PERMISSIVE)
            doubt *= 0.02 if not set(ids) <= labels else 1
            labels.update(ids)
    return (
        len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
        1.0 - doubt, ";".join(sorted(expressions)), granted,
    )


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t) for t in texts(batch, "text")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * 9
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence places, labels and evaluated expressions of every text."""
    source = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(scan_batches, f"`{id_col}` {kind}, {SCHEMA}")
