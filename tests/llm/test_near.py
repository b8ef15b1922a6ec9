"""Near duplicates against a brute-force search over all pairs."""

import random

import numpy as np

from cohortspark.llm import near, runtime
from cohortspark.llm.runtime import save


def near_brute(rows, similarity=0.8):
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                union = len(sets[i] | sets[j])
                if (len(sets[i] & sets[j]) >= similarity * union if union else True) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    groups = {}
    for n, root in enumerate(label):
        groups.setdefault(root, []).append(n)
    return sorted(str(min((rows[n][0] is None, rows[n][0]) for n in g)[1]) for g in groups.values())


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = [word() if rng.random() < rng.choice([0, 0.004, 0.01, 0.05]) else w for w in base]
            rows.append((len(rows), " ".join(copy), "x"))
    return rows + [(900, None, "x"), (901, "", "x"), (902, " one  Two", "x"), (903, "one two", "x"), (None, rows[0][1], "x"), (3, rows[3][1], "x")]


def kept(docs):
    return sorted(str(r.doc_id) for r in near.drop_near_duplicates(docs).collect())


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 3)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 1)
    rows = near_rows(3)
    docs = save(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3))
    got = near.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == near_brute(rows)
    assert near.drop_near_duplicates(docs.limit(0)).count() == 0


def test_cluster_that_changes(spark, monkeypatch):
    """Files are cut into other tasks from job to job, as when executors come or go; helper names clash with columns."""
    rows = near_rows(3)
    docs = save(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, file string, lot_ int").repartition(7))
    jobs = iter(range(10**6))

    def changing(df):
        out = runtime.save(df)
        spark.conf.set("spark.sql.files.openCostInBytes", str((1, 10**9, 2_000)[next(jobs) % 3]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str((10**9, 10**9, 4_000)[next(jobs) % 3]))
        return out

    monkeypatch.setattr(near, "save", changing)
    try:
        got = near.drop_near_duplicates(docs)
        assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == near_brute(rows)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_block_edits_and_shared_passages(spark, monkeypatch):
    rng = random.Random(12)
    words = [[f"w{rng.randrange(10**9)}" for _ in range(249)] for _ in range(60)]
    # 196 of 245 shingles, exactly 0.8, or one fewer; passages that all share without being similar; one family that holds
    # most rows; texts made of shared passages only.
    rows = [(2 * k, " ".join(w[:200])) for k, w in enumerate(words)] + [(2 * k + 1, " ".join(w if k % 3 else w + ["more"])) for k, w in enumerate(words)]
    rows += [(1000 + k, " ".join(words[0][:60] + [f"x{k}y{j}" for j in range(60)])) for k in range(20)]
    rows += [(2000 + k, " ".join(words[1][:100] + [f"z{k}"] + words[1][100:200])) for k in range(150)]
    rows += [(3000 + k, " ".join(w for p in rng.sample(range(2, 12), 4) for w in words[p][:50])) for k in range(60)]
    rows = [(i, t, "x") for i, t in rows]
    docs = save(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    want = near_brute(rows)
    monkeypatch.setattr(runtime, "HOT_ROWS", 40)
    assert kept(docs) == want
    monkeypatch.setattr(near, "TRIE_BUDGET", 0)
    monkeypatch.setattr(near, "STARS", 0)
    assert kept(docs) == want


def test_sketch_bound():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    for _ in range(50):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        apart = sum(int(x).bit_count() for x in (near.parity_sketch(a) ^ near.parity_sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_sketches_rule_pairs_out_where_they_meet(spark):
    """Ten unlike sets of one size that share a shingle at one place: no pair is made; two like ones make one pair, once."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, 40, np.uint64) for _ in range(10)]
    sets.append(sets[0].copy())
    sets[10][39] += np.uint64(1)
    bits = [[int(b) for b in near.parity_sketch(s)] for s in sets]
    heads = save(spark.createDataFrame([(7, k, k, 40, 0, *b) for k, b in enumerate(bits)], "shingle long, row long, root long, n int, place int, " + ", ".join(f"{b} long" for b in near.SKETCH)))
    assert [(r.u, r.v) for r in near.pairs_of(heads, heads, 0.8, once=True).collect()] == [(0, 10)]
