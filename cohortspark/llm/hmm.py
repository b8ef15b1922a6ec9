"""Hidden Markov language model: Baum-Welch over partitions, exact scaled forward scores.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z, then one end token.  Word counts of all
training texts are summed over partitions.  The `emitted` most frequent tokens have emissions of their own in each
state; all other words share one class, whose members follow one discounted distribution that keeps mass for the
single outcome "unknown word", so that the model is a probability over the same V + 1 outcomes as the base score.

Every text is tokenized once, to numbers of its words.  Baum-Welch: every task runs scaled forward and backward recursions over
whole texts, many of like length in step, and emits expected counts, which Spark sums by token; the driver only
normalizes tables of a bounded size (`emitted` x states).  Every pass takes in every training text; a task holds about
100 bytes for each token of the texts in step, and at least one whole text.  Scoring runs the forward recursion alone.

Counts of the `known` most frequent words are broadcast (a bounded number); counts of all others come from a join on
the words, of which each text sends every distinct one once.

A null or empty text is the end token alone.  An empty training set gives uniform states over nothing but the shared
class.  Repeated rows count and are scored one by one; rows with a null id are training rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import crc_mod, save, space_words, texts

END = b"\n"  # no word holds white space
STATES = 8
EMITTED = 1 << 15
KNOWN = 1 << 18
PASSES = 4  # over all training texts
COUNT_BINS = 20_000  # counts from here on fall into one bin when the most frequent words are sought
STEP_TOKENS = 400_000  # tokens of the texts that go in step
FLUSH_WORDS = 100_000  # distinct words a task counts before it sends them on
PRIOR = 20.0  # tokens of overall frequencies that smooth a state's emissions


@dataclass
class Lexicon:
    """Counts and the shares of tokens outside the most frequent ones."""

    words: list[bytes]  # the most frequent ones, in order
    counts: np.ndarray
    n: int  # N, all training tokens
    v: int  # V, distinct training tokens
    emitted: int
    other_tokens: int  # training tokens outside the emitted ones
    other_words: int
    discount: float

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def member(self, counts: np.ndarray) -> np.ndarray:
        """log10 share inside the shared class of words with these counts (0: unknown)."""
        total = self.other_tokens + 0.1
        unknown = (self.discount * self.other_words + 0.1) / total
        return np.log10(np.where(counts > 0, np.maximum(counts - self.discount, 1e-9) / total, unknown))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # tokens x states; the last row is the shared class


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        items = list(seen.items())
        seen.clear()
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in texts(batch, "text"):
            seen.update(space_words(text))
            seen[END] += 1
            if len(seen) > FLUSH_WORDS:
                yield from flushed()
    yield from flushed()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end token included."""
    return docs.select("text").mapInArrow(count_batches, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, emitted: int = EMITTED, known: int = KNOWN) -> Lexicon:
    total = counts.agg(
        F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))
    ).first()
    n, v, once, twice = (int(x or 0) for x in total)
    # The least count that at most `known` words reach, from a histogram of bounded size: so the most frequent words
    # are found by a filter, and no task or driver sorts the vocabulary.
    reached, cutoff = 0, COUNT_BINS + 1
    for r in counts.groupBy(F.least("c", F.lit(COUNT_BINS)).alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).toLocalIterator():
        if reached + r.words > known:
            break
        reached, cutoff = reached + r.words, r.bin
    frequent = counts.where(F.col("c") >= cutoff)
    if cutoff > COUNT_BINS:  # more words than that in the last bin
        frequent = counts.orderBy(F.desc("c"), "word").limit(known)
    top = frequent.toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, number = [bytes(w) for w in top["word"]], top["c"].to_numpy(np.int64)
    emitted = min(emitted, len(words))
    return Lexicon(words, number, n, v, emitted, n - int(number[:emitted].sum()), v - emitted, once / (once + 2 * twice) if once and twice else 0.5)


def first_model(lex: Lexicon, states: int = STATES, seed: int = 11) -> Hmm:
    rng = np.random.default_rng(seed)
    overall = overall_share(lex)
    emit = overall[:, None] * rng.gamma(2.0, 0.5, (len(overall), states))
    move = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1))
    return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def overall_share(lex: Lexicon) -> np.ndarray:
    counts = np.append(lex.counts[: lex.emitted].astype(float), lex.other_tokens + 0.1)
    return counts / counts.sum()


def numbered(text: bytes, number: dict[bytes, int]) -> list[int]:
    """Numbers of a text's tokens, -1 for words outside the dictionary."""
    get = number.get
    ids = [get(w, -1) for w in space_words(text)]
    ids.append(get(END, -1))
    return ids


class Steps:
    """Sequences in step: longest first, so that at each time the running ones are the first few; tokens by time."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        ascending = self.sizes[::-1]
        active = len(sizes) - np.searchsorted(ascending, np.arange(self.sizes[0]), "right")
        self.reach = np.concatenate(([0], np.cumsum(active)))
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        time = np.arange(self.reach[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.tokens = np.empty(self.reach[-1], np.int64)
        self.tokens[self.reach[time] + np.repeat(rank, sizes)] = np.concatenate(sequences)

    def __len__(self) -> int:
        return len(self.reach) - 1

    def at(self, t: int) -> slice:
        return slice(self.reach[t], self.reach[t + 1])


def forward(model: Hmm, steps: Steps, start: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Natural log likelihoods in the order of steps; with keep also the scaled alphas and scales by token place."""
    total = np.zeros(len(steps.sizes))
    alphas = np.empty((len(steps.tokens), len(model.start))) if keep else None
    scales = np.empty(len(steps.tokens)) if keep else None
    alpha = start
    for t in range(len(steps)):
        at = steps.at(t)
        n = at.stop - at.start
        if t:
            alpha = alpha[:n] @ model.move
        alpha = alpha * model.emit[steps.tokens[at]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
        if keep:
            alphas[at], scales[at] = alpha, scale
    return total, alphas, scales


def expect(model: Hmm, sequences: list[np.ndarray], counts: dict[str, np.ndarray]) -> None:
    """Add the expected counts of the sequences (Baum-Welch) to counts."""
    steps = Steps(sequences)
    start = np.broadcast_to(model.start, (len(sequences), len(model.start)))
    total, alphas, scales = forward(model, steps, start, keep=True)
    counts["likelihood"] += total.sum()
    # Ends of sequences count 1; before them, what lies ahead, scaled.
    beta = np.ones((0, len(model.start)))
    for t in range(len(steps) - 1, -1, -1):
        at = steps.at(t)
        grown = np.ones((at.stop - at.start, len(model.start)))
        if len(beta):
            after, n = steps.at(t + 1), len(beta)
            ahead = beta * model.emit[steps.tokens[after]]
            ahead /= scales[after][:, None]
            counts["move"] += (alphas[at][:n].T @ ahead) * model.move
            np.matmul(ahead, model.move.T, out=grown[:n])
        beta = grown
        alphas[at] *= beta
    counts["start"] += alphas[steps.at(0)].sum(axis=0)
    for k in range(len(model.start)):
        counts["emit"][:, k] += np.bincount(steps.tokens, alphas[:, k], len(counts["emit"]))


def in_step(numbers: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(place, tokens) of texts in lots of about STEP_TOKENS; lengths in a lot differ by a factor of four at most."""
    waiting: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    sizes: dict[int, int] = {}
    for place, ids in numbers:
        kind = len(ids).bit_length() // 2
        places, texts_ = waiting.setdefault(kind, ([], []))
        places.append(place)
        texts_.append(ids)
        sizes[kind] = sizes.get(kind, 0) + len(ids)
        if sizes[kind] >= STEP_TOKENS:
            yield waiting.pop(kind)
            sizes[kind] = 0
    yield from waiting.values()


def emitted_ids(batch: pa.RecordBatch, other: int) -> Iterator[np.ndarray]:
    """Tokens of each text; those without an emission of their own are the shared class."""
    for x in batch.column("ids").to_pylist():
        ids = np.frombuffer(x, np.int32).astype(np.int64)
        yield np.where((ids < 0) | (ids > other), other, ids)


def expectation_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        other, states = len(m.emit) - 1, len(m.start)
        counts = {"emit": np.zeros(m.emit.shape), "move": np.zeros((states, states)), "start": np.zeros(states), "likelihood": np.zeros(1)}
        for _, lot in in_step((0, ids) for batch in batches for ids in emitted_ids(batch, other)):
            expect(m, lot, counts)
        rows = np.vstack((counts["emit"], counts["move"], counts["start"], np.full((1, states), counts["likelihood"][0])))
        used = np.flatnonzero(rows.any(axis=1))
        for part in np.array_split(used, 8):
            arrays = [pa.array(part.astype(np.int64)), *(pa.array(rows[part, k]) for k in range(states))]
            yield pa.RecordBatch.from_arrays(arrays, names=["place", *(f"k{k}" for k in range(states))])

    return run


def baum_welch(tokens: DataFrame, model: Hmm, lex: Lexicon) -> tuple[Hmm, float]:
    """One pass over the ids of tokens: the new model and the log likelihood under the old one."""
    spark, states = tokens.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    names = [f"k{k}" for k in range(states)]
    sums = (
        tokens.select("ids")
        .mapInArrow(expectation_batches(shared), "place long, " + ", ".join(f"{k} double" for k in names))
        .groupBy("place")
        .agg(*(F.sum(k).alias(k) for k in names))
        .toPandas()
    )
    size = len(model.emit)
    table = np.zeros((size + states + 2, states))
    table[sums["place"].to_numpy()] = sums[names].to_numpy()
    return maximized(table[:size], table[size : size + states], table[size + states], lex), float(table[-1, 0])


def maximized(emit: np.ndarray, move: np.ndarray, start: np.ndarray, lex: Lexicon) -> Hmm:
    """The model of expected counts and a prior: PRIOR tokens of the overall frequencies in each state, one move and start."""
    emit = emit + PRIOR * overall_share(lex)[:, None]
    move, start = move + 1.0 / len(start), start + 1.0 / len(start)
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(tokens: DataFrame, lex: Lexicon, states: int = STATES, passes: int = PASSES) -> Hmm:
    """Passes over all training texts."""
    model = first_model(lex, states)
    for _ in range(passes):
        model, _ = baum_welch(tokens, model, lex)
    return model


def number_batches(shared):
    """Per text: the numbers of its tokens (-1 beyond the dictionary), and its other words with their numbers of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(shared.value.words)}
        for batch in batches:
            packed, rare, places = [], [], []
            for text in texts(batch, "text"):
                words = [*space_words(text), END]
                ids = np.array(numbered(text, number), np.int32)
                others = Counter(words[k] for k in np.flatnonzero(ids < 0))
                packed.append(ids.tobytes())
                rare.append(list(others))
                places.append(list(others.values()))
            kinds = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            columns = [pa.array(c, kind) for c, kind in zip((packed, rare, places), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "training")), *columns], names=["row", "doc_id", "training", "ids", "rare", "places"])

    return run


def tokenized(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """row, doc_id, training, ids, rare and places of every row of docs (doc_id, text, training)."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "training", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    return save(source.mapInArrow(number_batches(shared), f"row long, doc_id {kind}, training boolean, ids binary, rare array<binary>, places array<long>"))


def score_batches(model, shared):
    """Per text all but what its rarer words add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Hmm = model.value
        lex: Lexicon = shared.value
        base, member = lex.base(lex.counts), lex.member(lex.counts)
        for batch in batches:
            numbers = [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]
            known = [ids[ids >= 0] for ids in numbers]
            score = np.array([float(member[k[k >= lex.emitted]].sum()) for k in known])
            for where, lot in in_step(enumerate(emitted_ids(batch, lex.emitted))):
                steps = Steps(lot)
                total, _, _ = forward(m, steps, np.broadcast_to(m.start, (len(lot), len(m.start))), keep=False)
                score[np.array(where)[steps.order]] += total / np.log(10)
            columns = [score, np.array([float(base[k].sum()) for k in known]), np.array([len(x) for x in numbers], np.int64), np.array([len(k) for k in known], np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, columns)], names=["row", "doc_id", "score", "base_score", "n_tokens", "n_known"])

    return run


def score_documents(tokens: DataFrame, model: Hmm, lex: Lexicon, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of tokens."""
    context = tokens.sparkSession.sparkContext
    kind = tokens.schema["doc_id"].dataType.simpleString()
    part = tokens.select("row", "doc_id", "ids").mapInArrow(
        score_batches(context.broadcast(model), context.broadcast(lex)), f"row long, doc_id {kind}, score double, base_score double, n_tokens long, n_known long"
    )
    rare = tokens.select("row", F.explode(F.arrays_zip("rare", "places")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.places").alias("places"))
    c = F.coalesce("c", F.lit(0))
    total = lex.other_tokens + 0.1
    member = F.when(c > 0, F.greatest(c - F.lit(lex.discount), F.lit(1e-9)) / total).otherwise((lex.discount * lex.other_words + 0.1) / total)
    added = (
        rare.join(counts.where(F.col("c") <= int(lex.counts[-1]) if len(lex.counts) else F.lit(True)), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("places") * F.log10((c + 0.1) / (lex.n + 0.1 * (lex.v + 1)))).alias("more_base"),
            F.sum(F.col("places") * F.log10(member)).alias("more"),
            F.sum(F.when(c > 0, F.col("places")).otherwise(0)).alias("more_known"),
        )
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return part.join(added, "row", "left").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens",
        plus("n_known", "more_known").alias("n_known"),
        F.lit(lex.n).cast("long").alias("train_tokens"),
        plus("base_score", "more_base").alias("base_score"),
        plus("score", "more").alias("score"),
    )


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 10 is not 0, and score all rows."""
    docs = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) != 0).alias("training"))
    counts = save(word_counts(docs.where("training")))
    lex = lexicon(counts)
    tokens = tokenized(docs, lex)
    return score_documents(tokens, train(tokens.where("training"), lex), lex, counts)
