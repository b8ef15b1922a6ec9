"""Line rules against plain loops over small documents."""

import random
import re
from collections import Counter, defaultdict

from cohortspark.llm import line_rules as rules
from cohortspark.llm import runtime

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    line = re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))


def plain(rows, least, share, min_words, min_left):
    """(doc_id, counts, base_failed, kept, text left) of rows (doc_id, text, host)."""
    docs, seen = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        docs[host].add(text or "")
        for line in (text or "").split("\n"):
            if normal(line):
                seen[host, normal(line)].add(text)
    out = []
    for i, text, host in rows:
        t = text or ""
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeat = len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        common = [x for x in t.split("\n") if normal(x) and len(seen[host, normal(x)]) > max(least, share * len(docs[host]))]
        lost = sum(len(WORD.findall(x)) for x in common)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        left = len(words) - lost
        kept = not failed and left >= min_words and left >= min_left * len(words)
        rest = None if text is None else "\n".join(x for x in t.split("\n") if x not in common)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, lost, failed, kept, rest))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{k}é" for k in range(400)]
    menu = ["Home | About 12 &", "home about  34", "Impressum #1", "\t ", " ".join(f"m{k}x" * 2 + chr(97 + k % 26) for k in range(60)).replace("1", "i").replace("0", "o")]
    rows = []
    for i in range(120):
        body = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        host = rng.choice(["a", "a", "a", "b", None])
        if host == "a" and rng.random() < 0.7:
            body += menu
        if i % 10 == 0:
            body += ["same old words again"] * 9
        rows.append((rng.choice([i, i, i, 7, None]), "\n".join(body), host))
    rows += [(500 + k, rows[3][1], rows[3][2]) for k in range(30)]  # copies count once
    rows += [(900, None, "a"), (901, "", None), (902, " \n\n\t", "b"), (903, "x " * 50_000, "a"), (904, "one two", "c"), (905, "\r\n\x0b\x85   x", "b")]
    return rows


def test_against_loops(spark, monkeypatch):
    rows = cases()
    frame = spark.createDataFrame([(i, t, h, "extra") for i, t, h in rows], "doc_id long, text string, source string, content string").repartition(5)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept"]
    want = plain(rows, 3, 0.1, 30, 0.5)
    assert sum(w[6] > 0 for w in want) > 20 and any(w[8] for w in want) and any(w[6] and not w[7] and not w[8] for w in want)
    for broadcast in (1_000_000, 0):
        monkeypatch.setattr(rules, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(runtime, "HOT_ROWS", 4)
        got = rules.line_rules(frame, least=3, share=0.1, min_words=30, min_left=0.5)
        assert got.columns == names
        assert Counter(map(tuple, got.collect())) == Counter(w[:9] for w in want)
        clean = rules.remove_common_lines(frame, least=3, share=0.1)
        assert clean.columns == frame.columns
        assert Counter((r.doc_id, r.text, r.content) for r in clean.collect()) == Counter((w[0], w[9], "extra") for w in want)


def test_empty_and_all_null(spark):
    schema = "doc_id long, text string, source string"
    assert rules.line_rules(spark.createDataFrame([], schema)).count() == 0
    assert rules.remove_common_lines(spark.createDataFrame([], schema)).count() == 0
    row = rules.line_rules(spark.createDataFrame([(None, None, None)] * 2, schema)).collect()
    assert [tuple(r) for r in row] == [(None, 0, 0, 0, 0, 0, 0, True, False)] * 2


def test_repeat_words():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 5, 30, 3000):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)]
        windows = [tuple(words[k : k + 3]) for k in range(n - 2)]
        often = Counter(windows)
        assert rules.repeat_words(words) == len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)})
