"""The manifest against a plain recursive tree, and log places against a plain postorder walk."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from cohortspark.llm.merkle import Log, append_log, audit, build_manifest, fold, log_nodes, manifest_proofs, numbered, position, widths

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, h string"


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    path = []
    for level in levels[:-1]:
        first = i // 8 * 8
        path.append((i - first, level[first : first + 8][: i - first] + level[first : first + 8][i - first + 1 :]))
        i //= 8
    return path


def folded(h, path):
    for place, others in path:
        h = H(*others[:place], h, *others[place:])
    return h


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain(rows):
    trees = defaultdict(list)
    for k, row in enumerate(rows):
        trees[(row[2] is not None, (row[2] or "").encode())].append(((row[0] is not None, row[0] or 0), leaf(*row), k))
    order = sorted(trees)
    built = {t: levels_of([h for _, h, _ in sorted(trees[t])]) for t in order}
    top = levels_of([built[t][-1][0] for t in order])
    out = []
    for at, t in enumerate(order):
        for i, (_, h, k) in enumerate(sorted(trees[t])):
            doc_id, text, *rest = rows[k]
            path = way(built[t], i) + way(top, at)
            seen = h
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                seen = leaf(doc_id, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), *rest)
            root = folded(seen, path)
            out.append((doc_id, h, built[t][-1][0], top[-1][0], H(*(o for _, others in path for o in others)), root, root == top[-1][0]))
    return out


def cases(sizes):
    rng = random.Random(2)
    rows = []
    for lang, n in sizes.items():
        for k in range(n):
            text = rng.choice([None, "", "Éa B\n" * rng.randint(1, 4), f"Text {rng.random()}"])
            rows.append((rng.choice([k, k, k, 3, None, -k]), text, lang, rng.choice([None, "s", "S é"]), rng.choice([None, 7])))
    rows += [rows[0]] * 40
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 700, None: 9, "": 64, "é": 1, "z": 8}, {f"l{k}": 1 for k in range(70)}])
def test_against_plain_trees(spark, sizes):
    rows = cases(sizes)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert Counter(map(tuple, audit(frame).collect())) == Counter(plain(rows))


def test_places_and_paths(spark):
    for size in (1, 2, 8, 9, 64, 65, 512, 513, 600, 4097):
        order = {}
        counts = widths(size)

        def visit(level, index, counts=counts, order=order):
            if level:
                for k in range(8 * index, min(8 * index + 8, counts[level - 1])):
                    visit(level - 1, k)
            order[level, index] = len(order)

        visit(len(counts) - 1, 0)
        assert all(position(size, *node) == at for node, at in order.items()), size
    hashes = {n: [H(f"{n} {k}") for k in range(n)] for n in (1, 8, 530, 4100)}
    rows = [(str(n), k, h) for n, hs in hashes.items() for k, h in enumerate(hs)]
    random.Random(1).shuffle(rows)
    leaves = numbered(spark.createDataFrame(rows, "tree string, k long, h string").repartition(5), "k").cache()
    assert all(r["index"] == r.k and r["size"] == int(r.tree) for r in leaves.collect())
    log = append_log(leaves)
    assert isinstance(log, Log) and len(log.rounds) == 2
    want = {(str(n), position(n, level, k)): h for n, hs in hashes.items() for level, row in enumerate(levels_of(hs)) for k, h in enumerate(row)}
    got = log_nodes(log).collect()
    assert len(got) == len(want) and {(r.tree, r.position): r.h for r in got} == want
    assert {r.tree: r.h for r in log.tops.collect()} == {str(n): levels_of(hs)[-1][0] for n, hs in hashes.items()}


def test_proofs_verify_alone(spark):
    rows = cases({"a": 30, "b": 20})
    manifest = build_manifest(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    for r in manifest_proofs(manifest, with_paths=True).collect():
        assert fold(r.leaf, [p.asDict() for p in r.path]) == r.root == manifest.root and r.verified


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert audit(frame).collect() == []
    one = audit(spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(None, H("-----"), H("-----"), H("-----"), H(), H("-----"), True)]
