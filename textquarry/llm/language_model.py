"""Hidden Markov language model (operator 4).

Words are emitted in two steps: a latent state emits a class, and the class emits
the word. Each of the most frequent words (a fixed number) is a class of its own;
all other words share classes by a checksum of their last two letters, within
which a word has its smoothed share of the training counts, with one share kept
for all unknown words. Baum-Welch trains the states: each pass sends expected
counts from every partition of all training documents, cut into segments, and
sums them up; the scaled forward recursion then gives each whole text's exact
log-likelihood under the model.

Counts of all words stay distributed: rare words' counts are joined to the texts'
rare words, and the driver sees the most frequent words, sums by class and the
expected counts by class alone, all of fixed size.

Defined cases: null or empty text is the end token alone; rows without an id are
training rows; repeated rows count and are scored each on its own; very long texts
are read and scored whole; words of equal counts are ordered by themselves; without any
training row all words are unknown; an empty table gives no rows; other columns
are not used.
"""

from __future__ import annotations

import collections
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.bpe import Kept
from textquarry.llm.common import ascii_lower, firsts, hash_firsts, slices, staged, table, text_or_empty

#: Words with a class of their own; classes of the rest; latent states; tokens of a training segment.
FREQUENT, SHARED, STATES, SEGMENT = 16_384, 512, 8, 32
SMOOTH = 0.1
#: Different words that a task counts before it hands their counts on.
COUNTED = 400_000


@dataclass
class Vocabulary:
    """frequent: word -> (class, count); total: training tokens; distinct: different ones; ends: training documents; mass, kinds: counts and distinct words of each shared class."""

    frequent: dict[bytes, tuple[int, int]]
    total: int
    distinct: int
    ends: int
    mass: np.ndarray
    kinds: np.ndarray

    @property
    def classes(self) -> int:
        return FREQUENT + SHARED + 1

    @property
    def end(self) -> int:
        return FREQUENT + SHARED

    @property
    def norm(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)


def shared_class(last: str) -> int:
    """By a word's last two letters."""
    return zlib.crc32(last.encode()) % SHARED


def rows_of(docs: DataFrame, held_out_tenth: bool = True) -> DataFrame:
    """doc_id, _row, held_out and whole lower-cased text."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), (held if held_out_tenth else F.lit(False)).alias("held_out"), ascii_lower(text_or_empty()).alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """Counts of all words of the training rows, with each word's shared class; counted within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: collections.Counter = collections.Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(text.encode().split())
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    words = rows.filter(~F.col("held_out")).select("text").mapInArrow(count, "word string, c bigint")
    own = F.pmod(F.crc32(F.right("word", F.lit(2)).cast("binary")), F.lit(SHARED)).cast("int")
    return words.groupBy("word").agg(F.sum("c").alias("c")).withColumn("class", own)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The most frequent words one by one, ties by a hash of the word, and what the others' classes add up to; besides, only sums reach the driver."""
    least = firsts(counts, -F.col("c"), [F.desc("c")], FREQUENT).agg(F.min("c")).first()[0] or 0
    above = counts.filter(F.col("c") > least)
    n = above.count()
    last = hash_firsts(counts.filter(F.col("c") == least), ["word"], FREQUENT - n)
    top = [r for part in (above, last) for r in part.withColumn("_hash", F.xxhash64("word")).collect()]
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    rest = counts.filter(F.col("c") < least)
    if len(top) > n:  # of the words as frequent as the last one, those with a greater hash are not in
        edge = max((r["_hash"], r["word"]) for r in top[n:])
        drawn = F.xxhash64("word")
        rest = counts.filter((F.col("c") < least) | (F.col("c") == least) & ((drawn > edge[0]) | (drawn == edge[0]) & (F.col("word") > edge[1])))
    top.sort(key=lambda r: (-r["c"], r["word"]))
    mass, kinds = np.zeros(SHARED), np.zeros(SHARED)
    for r in rest.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        mass[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    return Vocabulary({r["word"].encode(): (k, r["c"]) for k, r in enumerate(top)}, sums["n"] + ends, sums["v"] + (ends > 0), ends, mass, kinds)


ENCODED = "struct<classes:binary,n_tokens:bigint,base:double,known:bigint,rare:array<string>>"


def encoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text as its sequence of classes, with what its frequent words give to the base score and its rare words."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)
    kind = pa.struct([("classes", pa.binary()), ("n_tokens", pa.int64()), ("base", pa.float64()), ("known", pa.int64()), ("rare", pa.list_(pa.string()))])

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = shared.value
        ends = Kept(lambda last: FREQUENT + shared_class(last), 400_000)
        frequent = {w: k for w, (k, _) in v.frequent.items()}
        logs = np.log10(np.array([c for _, c in v.frequent.values()] or [0.0]) + SMOOTH) - np.log10(max(v.norm, SMOOTH))
        end = np.log10(v.ends + SMOOTH) - np.log10(v.norm)
        for batch in slices(batches):
            out = []
            for x in batch.to_pylist():
                words = x.encode().split()
                own = np.fromiter(map(frequent.get, words, itertools.repeat(-1)), np.int64, len(words))
                gone = np.flatnonzero(own < 0).tolist()
                rare, known = [words[k].decode() for k in gone], own[own >= 0]
                if gone:
                    own[gone] = [ends[w[-2:]] for w in rare]
                ids = np.append(own, v.end).astype("<u2")
                out.append({"classes": ids.tobytes(), "n_tokens": len(ids), "base": float(logs[known].sum() + end), "known": len(known) + (v.ends > 0), "rare": rare})
            yield pa.array(out, kind)

    return rows.select("doc_id", "_row", "held_out", F.arrow_udf(encode, ENCODED)(F.col("text")).alias("_e")).select("doc_id", "_row", "held_out", "_e.*")


@dataclass
class Model:
    """start: P(state) of a document's first token; later: of a training segment's; move: P(next | state); emit: P(class | state), by class."""

    start: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def segments(docs: list[bytes], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Matrices of classes (padded with the end class), lengths, and which segments begin a document."""
    group, size = [], 0
    for k, x in enumerate(docs):
        ids = np.frombuffer(x, "<u2")
        group.append(ids)
        size += len(ids)
        if size > 150_000 or k == len(docs) - 1:
            counts = np.array([-(-len(i) // SEGMENT) for i in group])
            table = np.full((int(counts.sum()), SEGMENT), end, np.int64)
            length = np.full(len(table), SEGMENT)
            firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            flat = table.reshape(-1)
            for at, ids in zip(firsts * SEGMENT, group, strict=True):
                flat[at : at + len(ids)] = ids
            length[firsts + counts - 1] = [len(i) - (n - 1) * SEGMENT for i, n in zip(group, counts, strict=True)]
            begins = np.zeros(len(table), bool)
            begins[firsts] = True
            yield table, length, begins
            group, size = [], 0


def expected_counts(model: Model, table: np.ndarray, length: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One forward and backward pass: each token's state probabilities, expected moves, those of the first tokens, and the log-likelihood."""
    n, t = table.shape
    seen = model.emit[table]
    alpha, scale = np.empty((t, n, len(model.start))), np.ones((t, n))
    now = np.where(begins[:, None], model.start, model.later) * seen[:, 0]
    for k in range(t):
        if k:
            now = (alpha[k - 1] @ model.move) * seen[:, k]
        scale[k] = now.sum(1)
        alpha[k] = now / scale[k][:, None]
    scale[np.arange(t)[:, None] >= length] = 1.0
    beta, moves = np.ones((n, len(model.start))), np.zeros_like(model.move)
    for k in range(t - 1, -1, -1):
        if k < t - 1:
            live = k + 1 < length
            ahead = np.where(live[:, None], seen[:, k + 1] * beta / scale[k + 1][:, None], 0.0)
            moves += alpha[k].T @ ahead
            beta = np.where(live[:, None], ahead @ model.move.T, 1.0)
        alpha[k] *= beta
    state = alpha.transpose(1, 0, 2)
    state /= state.sum(2, keepdims=True)
    state[np.arange(t) >= length[:, None]] = 0.0
    return state, moves * model.move, np.stack([state[begins, 0].sum(0), state[~begins, 0].sum(0)]), float(np.log(scale).sum())


MOVES, STARTS, LIKELIHOOD = -1, -100, -200


def one_pass(training: DataFrame, model: Model, vocab: Vocabulary) -> tuple[Model, float]:
    """A pass of Baum-Welch over all training rows; returns the new model and the old one's log-likelihood of the segments."""
    shared = training.sparkSession.sparkContext.broadcast((model, vocab.end, vocab.classes))
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end, classes = shared.value
        emit, moves, starts, likelihood = np.zeros((classes, states)), np.zeros((states, states)), np.zeros((2, states)), 0.0
        for batch in slices(batches):
            for table, length, begins in segments(batch.column(0).to_pylist(), end):
                state, m, s, p = expected_counts(model, table, length, begins)
                flat = table.reshape(-1)
                for k in range(states):
                    emit[:, k] += np.bincount(flat, state[:, :, k].reshape(-1), classes)
                moves += m
                starts += s
                likelihood += p
        own = np.flatnonzero(emit.sum(1) > 0)
        if len(own):
            keys = [*own.tolist(), *(MOVES - k for k in range(states)), STARTS, STARTS - 1, LIKELIHOOD]
            rows = np.concatenate([emit[own], moves, starts, np.full((1, states), likelihood)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(rows[:, k]) for k in range(states))], ["key", *names])

    got = training.select("classes").mapInArrow(count, "key int, " + ", ".join(f"{x} double" for x in names)).groupBy("key").agg(*[F.sum(x).alias(x) for x in names]).collect()
    sums = {r["key"]: np.array(r[1:]) for r in got}
    emit = np.zeros((vocab.classes, states))
    for k, v in sums.items():
        if k >= 0:
            emit[k] = v
    share = (emit.sum(1) + 0.01) / (emit.sum() + 0.01 * len(emit))
    emit += 20 * share[:, None]  # each state leans a little on all classes' shares, so that none is impossible
    moves = np.array([sums[MOVES - k] for k in range(states)]) + 0.1
    starts = [sums[STARTS - k] + 0.1 for k in (0, 1)]
    return Model(starts[0] / starts[0].sum(), starts[1] / starts[1].sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0)), float(sums[LIKELIHOOD][0])


def first_model(sample: list[bytes], vocab: Vocabulary, states: int, seed: int = 3) -> Model:
    """Where training begins: states from a mixture of unigram models of a small sample of documents."""
    rng = np.random.default_rng(seed)
    x = np.zeros((max(1, len(sample)), vocab.classes), np.float32)  # whole texts, as counts by class
    for row, ids in zip(x, sample, strict=False):
        np.add.at(row, np.frombuffer(ids, "<u2").astype(np.int64), 1)
    share = (x.sum(0) + 0.1) / (x.sum() + 0.1 * x.shape[1])
    unit = np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))
    centres = [unit[rng.integers(len(x))]]
    for _ in range(states - 1):  # documents far from those chosen
        far = 1 - np.max(unit @ np.array(centres).T, 1)
        centres.append(unit[int(np.argmax(far * (x.sum(1) >= 30)))])
    member = np.argmax(unit @ np.array(centres).T, 1)
    emit = np.tile(share[:, None], (1, states)).astype(float)
    weight = np.full(states, 1 / states)
    for _ in range(8):
        for k in range(states):
            own = x[member == k].sum(0)
            emit[:, k] = (own + 50 * share) / (own.sum() + 50)
        weight = (np.bincount(member, minlength=states) + 1) / (len(x) + states)
        member = np.argmax(x @ np.log(emit).astype(np.float32) + np.log(weight), 1)
    noise = rng.uniform(0.9, 1.1, emit.shape)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(weight, weight, move, emit * noise / (emit * noise).sum(0))


def train(training: DataFrame, vocab: Vocabulary, states: int = STATES, passes: int = 3, start_rows: int = 500) -> Model:
    """Baum-Welch from a start on at most start_rows documents; every pass covers all training rows."""
    chosen = hash_firsts(training.select("doc_id", "_row"), ["doc_id", "_row"], start_rows)
    sample = training.join(F.broadcast(chosen.select("_row")), "_row", "left_semi").orderBy(F.xxhash64("doc_id", "_row")).select("classes").collect()
    model = first_model([bytes(r["classes"]) for r in sample], vocab, states)
    for _ in range(passes if sample else 0):
        model, _ = one_pass(training, model, vocab)
    return model


def forward(model: Model, docs: list[bytes]) -> np.ndarray:
    """log10 likelihood of whole class sequences, documents side by side, longest first."""
    ids = [np.frombuffer(x, "<u2") for x in docs]
    order = np.argsort([-len(i) for i in ids], kind="stable")
    lengths = np.array([len(ids[k]) for k in order])
    flat = np.concatenate([ids[k] for k in order]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
    out, now, live = np.zeros(len(ids)), None, len(ids)
    for t in range(lengths[0] if len(ids) else 0):
        while live and lengths[live - 1] <= t:
            live -= 1
        now = (model.start if now is None else now[:live] @ model.move) * model.emit[flat[at[:live] + t]]
        scale = now.sum(1)
        out[:live] += np.log10(scale)
        now = now / scale[:, None]
    result = np.empty(len(ids))
    result[order] = out
    return result


def score(docs: DataFrame, states: int = STATES, passes: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; scores are log10 probabilities."""
    rows = rows_of(docs)
    counts = staged(word_counts(rows))
    vocab = vocabulary(counts, rows.filter(~F.col("held_out")).count())
    texts = staged(encoded(rows, vocab))
    model = train(texts.filter(~F.col("held_out")), vocab, states, passes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def likelihood(classes: pa.Array) -> pa.Array:
        return pa.array(forward(shared.value, classes.to_pylist()), pa.float64())

    scored = texts.select("doc_id", "_row", "held_out", "n_tokens", "base", "known", likelihood("classes").alias("_p"))
    rare = texts.select("_row", F.explode("rare").alias("word")).join(counts.drop("class"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    own = (F.pmod(F.crc32(F.right("word", F.lit(2)).cast("binary")), F.lit(SHARED)) + 1).cast("int")
    norm = F.element_at(F.lit([float(x) for x in np.log10(vocab.mass + SMOOTH * (vocab.kinds + 1))]), own)
    within = F.log10(F.col("c") + SMOOTH)
    sums = rare.groupBy("_row").agg(F.sum(within - float(np.log10(max(vocab.norm, SMOOTH)))).alias("_base"), F.sum(within - norm).alias("_within"), F.sum((F.col("c") > 0).cast("long")).alias("_known"))
    joined = scored.join(sums, "_row", "left")
    zero = F.lit(0.0)
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(vocab.total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", zero)).alias("base_score"), (F.col("_p") + F.coalesce("_within", zero)).alias("score"))


def op4_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
