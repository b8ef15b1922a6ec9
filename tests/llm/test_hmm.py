"""Scores against plain recursions; likelihood rises; probabilities sum to one."""

import math
import random
from collections import Counter

import numpy as np

from cohortspark.llm import hmm


def corpus(n, seed):
    rng = random.Random(seed)
    kinds = [["the", "a", "of", "in"], ["der", "die", "und"]]
    out = []
    for i in range(n):
        k = rng.randrange(2)
        words = [rng.choice(kinds[k]) if rng.random() < 0.6 else f"{'xy'[k]}{rng.randrange(300)}" for _ in range(rng.randrange(40))]
        out.append((i, " ".join(words).title(), "c"))
    return out + [(None, None, "c"), (5000, "", "c"), (5001, "the " * 3000, "c"), (0, out[0][1], "c")]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "EMITTED", 12)
    rows = corpus(300, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, c string")
    docs = docs.withColumn("training", hmm.crc_mod(hmm.F.col("doc_id"), 10) != 0)
    counts = hmm.save(hmm.word_counts(docs.where("training")))
    lex = hmm.lexicon(counts, emitted=12, known=40)
    ids = hmm.tokenized(docs, lex)
    model = hmm.train(ids.where("training"), lex, states=3)
    got = {(r.doc_id, r.n_tokens): r for r in hmm.score_documents(ids, model, lex, counts).collect()}
    import zlib

    tokens = lambda t: (t or "").lower().split() + ["\n"]
    c = Counter()
    for d, t, _ in rows:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    number = {w.decode(): k for k, w in enumerate(lex.words[:12])}
    assert lex.n == n and lex.v == v
    for d, t, _ in rows:
        r, toks = got[d, len(tokens(t))], tokens(t)
        assert r.n_known == sum(c[w] > 0 for w in toks) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks), rel_tol=1e-9)
        alpha, score = model.start, 0.0
        for k, w in enumerate(toks):
            alpha = (alpha @ model.move if k else alpha) * model.emit[number.get(w, 12)]
            score += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w not in number:
                score += float(lex.member(np.array([c[w]]))[0])
        assert math.isclose(r.score, score, rel_tol=1e-9)
    rare = [c[w] for w in c if w not in number]
    assert math.isclose(sum(10 ** lex.member(np.array([*rare, 0]))), 1.0, rel_tol=1e-6)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_counts(model, sequences):
    """Expected counts of Baum-Welch, one text and one token at a time, unscaled."""
    states = len(model.start)
    emit, move, start, total = np.zeros_like(model.emit), np.zeros((states, states)), np.zeros(states), 0.0
    for ids in sequences:
        alpha = [model.start * model.emit[ids[0]]]
        for k in ids[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[k])
        beta = [np.ones(states)]
        for k in ids[:0:-1]:
            beta.append(model.move @ (model.emit[k] * beta[-1]))
        beta = beta[::-1]
        p = alpha[-1].sum()
        total += math.log(p)
        for t, k in enumerate(ids):
            emit[k] += alpha[t] * beta[t] / p
            if t:
                move += np.outer(alpha[t - 1], model.emit[k] * beta[t]) * model.move / p
        start += alpha[0] * beta[0] / p
    return emit, move, start, total


def test_expected_counts_and_rise(spark, monkeypatch):
    """Counts against a plain Baum-Welch, with lots of any size; what the passes maximize never falls."""
    docs = spark.createDataFrame(corpus(60, 2)[:61], "doc_id long, text string, c string").withColumn("training", hmm.F.lit(True)).repartition(3)
    lex = hmm.lexicon(hmm.save(hmm.word_counts(docs)), emitted=20, known=50)
    tokens = hmm.tokenized(docs, lex)
    model = hmm.first_model(lex, 3)
    sequences = [x for b in tokens.select("ids").toArrow().to_batches() for x in hmm.emitted_ids(b, 20)]
    for lot in (400_000, 30):
        monkeypatch.setattr(hmm, "STEP_TOKENS", lot)
        after, likelihood = hmm.baum_welch(tokens, model, lex)
        emit, move, start, total = plain_counts(model, sequences)
        want = hmm.maximized(emit, move, start, lex)
        assert math.isclose(likelihood, total, rel_tol=1e-9)
        for name in ("emit", "move", "start"):
            assert np.allclose(getattr(after, name), getattr(want, name), rtol=1e-9)
    before = -math.inf
    for _ in range(8):
        prior = (hmm.PRIOR * hmm.overall_share(lex)[:, None] * np.log(model.emit)).sum() + (np.log(model.move).sum() + np.log(model.start).sum()) / 3
        model, likelihood = hmm.baum_welch(tokens, model, lex)
        assert likelihood + prior >= before
        before = likelihood + prior


def test_empty(spark):
    assert hmm.train_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
