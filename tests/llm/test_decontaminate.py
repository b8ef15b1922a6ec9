"""Against a brute-force search for every window."""

import hashlib
import random
import re

from cohortspark.llm import decontaminate
from cohortspark.llm.decontaminate import find_leaks, remove_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        for at in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[at : at + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "cé", "d1", "e", "x-y"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 6, 12, 25]))) for i in range(12)] + [(3, "a B"), (20, None), (5, "...")]
    docs = [(i, text(rng.randrange(60)), "s") for i in range(60)]
    docs += [(90, None, "s"), (90, None, "s"), (91, "", "s"), (92, items[7][1] + " zz " + items[8][1], "s"), (None, "q " * 50000, "s")]
    return docs, items


def check(spark):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(frame, bench, window=6).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert have == sorted((str(d), *brute(t, items, 6)) for d, t, _ in docs)
    kept = remove_leaks(frame, bench, window=6).count()
    assert kept == sum(not r.contaminated for r in got)


def test_against_brute_force(spark):
    check(spark)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    check(spark)


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x " + " ".join(item.split()[3:30]) + " y"), (2, "w1 w2")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.longest_match for r in find_leaks(docs, bench).collect()} == {1: 27, 2: 0}


def longest_brute(text, items):
    w, best = words(text), 0
    for _, body in items:
        b = words(body)
        size = [[0] * (len(b) + 1) for _ in range(len(w) + 1)]
        for i in range(len(w)):
            for j in range(len(b)):
                if w[i] == b[j]:
                    size[i + 1][j + 1] = size[i][j] + 1
                    if size[i + 1][j + 1] >= min(6, len(b)):
                        best = max(best, size[i + 1][j + 1])
    return best


def test_longest_matches_of_shared_windows(spark, monkeypatch):
    docs, items = cases()
    docs = docs[:-1]
    opening = " ".join(f"s{i}" for i in range(10))
    items += [(50, opening + " " + " ".join(f"p{i}" for i in range(20))), (51, opening + " " + " ".join(f"q{i}" for i in range(20))), (None, "lone words of an item that has no id")]
    docs += [(200, "x " + items[-2][1] + " y", "s"), (201, "so " + items[-1][1], "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 24, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = find_leaks(frame, bench, window=6).collect()
        assert sorted((str(r.doc_id), r.longest_match) for r in got) == sorted((str(d), longest_brute(t, items)) for d, t, _ in docs)
        by_id = {r.doc_id: r for r in got}
        assert (by_id[200].longest_match, by_id[200].longest_at, by_id[200].longest_item) == (30, 1, "51")
        assert (by_id[201].n_hit, by_id[201].n_items) == (9, 0) and by_id[201].contaminated


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in find_leaks(docs, none).collect()] == [False]
    assert find_leaks(docs.limit(0), none).count() == 0


def test_tasks_hold_slices(spark):
    """A batch is read in slices, so that the words of few texts are Python objects at once."""
    import pyarrow as pa

    class Shared:
        value = [("1", b"a b c")]

    sizes, scan = [], decontaminate.scan_shard
    decontaminate.scan_shard = lambda docs, block: sizes.append(len(docs)) or scan(docs, block)
    try:
        texts = ["x a b c", "x"] * 2500
        batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(texts)], names=["id", "text"])
        kept = sum(b.num_rows for b in decontaminate.keeper(Shared, 3, "text")(iter([batch])))
        rows = pa.Table.from_batches(decontaminate.scanner(Shared, 3, 0, True, "id")(iter([batch])))
    finally:
        decontaminate.scan_shard = scan
    assert kept == 2500 and rows.column("contaminated").to_pylist() == [True, False] * 2500
    assert max(sizes) <= 1000
