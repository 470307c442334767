"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact scores by the scaled forward recursion.

A state emits a token class, the class emits the token: frequent words and the end of a text are classes of their own,
all other words share one class per shape (length, first and last byte), in which a word has probability
(c + 1) / (sum of c + 1 over its class + 1), c its training count; the last 1 is for words not seen. So the model is a
distribution over texts of any words, and its tables stay bounded however large the vocabulary grows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .common import blank_words, need, small_batches
from .vocabulary import frequent, token_counts

#: Words that tasks look up directly (others are joined), words with a class of their own, states, rounds of training.
DICTIONARY, OWN_CLASS, STATES, ROUNDS = 300_000, 2048, 8, 3
SHAPES, STAY = 64, 10
#: Tokens of one recursion block, and tokens whose texts are sorted by length together.
BLOCK, BUFFER = 200_000, 4_000_000
#: Expected counts are summed as whole numbers of this fraction, so that sums do not depend on order.
UNIT = 1 << 20
LN10 = math.log(10.0)


def shape(word: bytes) -> int:
    return min(len(word), 16) - 1 + 16 * (97 <= word[0] <= 122) + 32 * (97 <= word[-1] <= 122)


def shape_column(word: Column) -> Column:
    inside = lambda b: ((b >= F.lit(b"a")) & (b <= F.lit(b"z"))).cast("int")
    return F.least(F.octet_length(word), F.lit(16)) - 1 + 16 * inside(F.substring(word, 1, 1)) + 32 * inside(F.substring(word, -1, 1))


class Lexicon(NamedTuple):
    """Of frequent words: text, count, class. Of classes: log10 of the total that a shape shares; ``end`` is the last class."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    classes: np.ndarray
    shape_total: np.ndarray
    own: int
    tokens: int
    distinct: int
    texts: int

    @property
    def n_classes(self) -> int:
        return self.own + SHAPES + 1


class Model(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def lexicon(counts: DataFrame, texts: int, dictionary: int, own: int) -> Lexicon:
    """``counts``: (token, n) of the training words; each of the ``texts`` adds one end."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    table = frequent(counts, dictionary).toArrow()
    order = sorted(zip(table.column("n").to_pylist(), table.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    words, n = tuple(w for _, w in order), np.array([c for c, _ in order], np.int64)
    own = min(own, len(words))
    classes = np.array([i if i < own else own + shape(w) for i, w in enumerate(words)], np.int32)
    shared = np.ones(SHAPES, np.int64)
    for r in counts.groupBy(shape_column(F.col("token")).alias("s")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        shared[r["s"]] += r["n"]
    for c, w in order[:own]:
        shared[shape(w)] -= c + 1
    return Lexicon(words, n, classes, np.log10(shared.astype(np.float64)), own, sums["n"] + texts, sums["v"] + (texts > 0), texts)


CODED = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, count_log double, shared_log double, "
         "classes binary, rare array<struct<word: binary, n: bigint>>")
_INDEX: dict = {}


def _index(shared) -> tuple[Lexicon, dict]:
    """The word index of a broadcast lexicon, built once per worker."""
    lex = shared.value
    if _INDEX.get("of") is not lex:
        _INDEX.update(of=lex, index={w: i for i, w in enumerate(lex.words)})
    return lex, _INDEX["index"]


def code_texts(rows: DataFrame, shared) -> DataFrame:
    """Texts as class numbers, with what is known of their counts; words outside the lexicon are listed in ``rare``."""
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, index = _index(shared)
        log_count = np.log10(np.append(lex.counts, 0) + 1.0)
        log_share = np.append(np.where(lex.classes >= lex.own, lex.shape_total[np.maximum(lex.classes - lex.own, 0)], log_count[:-1]), 0.0)
        classes_of = np.append(lex.classes, 0)
        end = lex.own + SHAPES
        end_log = math.log10(lex.texts + 1.0)
        for batch in batches:
            out: list[tuple] = []
            for body in batch.column("body"):
                words = blank_words(body.as_py())
                codes = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                classes = np.append(classes_of[codes], end).astype(np.uint16)
                unknown = np.nonzero(codes < 0)[0]
                rare: dict[bytes, int] = {}
                share = log_share[codes].sum()
                if len(unknown):
                    shapes = [shape(words[i]) for i in unknown]
                    classes[unknown] = np.array(shapes, np.int64) + lex.own
                    share += lex.shape_total[shapes].sum()
                    for i in unknown:
                        rare[words[i]] = rare.get(words[i], 0) + 1
                out.append((len(words) + 1, len(words) - len(unknown) + (lex.texts > 0), float(log_count[codes].sum()) + end_log,
                            float(share) + end_log, classes.tobytes(), [{"word": w, "n": k} for w, k in rare.items()]))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "held_out")] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "count_log", "shared_log", "classes", "rare"])

    return rows.mapInArrow(run, CODED)


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, classes, active) of texts of like length: classes run by place, then by text from the longest; ``active``
    has the number of texts that reach each place."""
    lengths = np.array([len(x) // 2 for x in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    total = np.cumsum(lengths[order])
    start = 0
    while start < len(order):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + BLOCK, "right")))
        part = order[start:stop]
        size = lengths[part]
        seq = np.frombuffer(b"".join(texts[i] for i in part), np.uint16)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(size) - size, size)
        by_place = np.argsort(place, kind="stable")
        yield part, seq[by_place].astype(np.int64), np.bincount(place)
        start = stop


def forward(model: Model, seq: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables, scales and emissions of a block, all by place."""
    emissions = model.emit[seq]
    alpha, scale = np.empty_like(emissions), np.empty(len(seq))
    a, at = None, 0
    for n in active.tolist():
        a = (np.broadcast_to(model.start, (n, len(model.start))) if a is None else a[:n] @ model.move) * emissions[at:at + n]
        c = a.sum(axis=1)
        a = a / c[:, None]
        alpha[at:at + n], scale[at:at + n] = a, c
        at += n
    return alpha, scale, emissions


def log_likelihoods(model: Model, texts: list[bytes]) -> np.ndarray:
    """Natural log of the probability of each class sequence."""
    out = np.zeros(len(texts))
    for part, seq, active in blocks(texts):
        _, scale, _ = forward(model, seq, active)
        logs, at, total = np.log(scale), 0, np.zeros(len(part))
        for n in active.tolist():
            total[:n] += logs[at:at + n]
            at += n
        out[part] = total
    return out


def expected_counts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (starts, moves, emissions) of the sequences."""
    states, classes = len(model.start), len(model.emit)
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    for _, seq, active in blocks(texts):
        alpha, scale, emissions = forward(model, seq, active)
        emissions /= scale[:, None]
        gamma = np.empty_like(alpha)
        back = model.move.T.copy()
        beta, stop = np.ones((active[-1], states)), len(seq)
        for k in range(len(active) - 1, -1, -1):
            n = active[k]
            at = stop - n
            gamma[at:stop] = alpha[at:stop] * beta
            if k:
                onward = emissions[at:stop] * beta
                wide = active[k - 1]
                moves += alpha[at - wide:at - wide + n].T @ onward
                beta = np.ones((wide, states))
                beta[:n] = onward @ back
            stop = at
        starts += gamma[:active[0]].sum(axis=0)
        for s in range(states):
            emits[:, s] += np.bincount(seq, gamma[:, s], classes)
    return starts, moves * model.move, emits


def _buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[bytes]]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(len(x) for x in batch.column("classes").to_pylist()) // 2
        if size >= BUFFER:
            yield (t := pa.Table.from_batches(held)), t.column("classes").to_pylist()
            held, size = [], 0
    if held:
        yield (t := pa.Table.from_batches(held)), t.column("classes").to_pylist()


def first_model(unigram: np.ndarray, states: int) -> Model:
    """A fixed start: class frequencies, tilted differently in each state, and states that tend to stay.

    Staying lets a whole text settle in few states, so that texts of a kind (a language, say) part soon.
    """
    rng = np.random.default_rng(20)
    emit = (unigram[:, None] + 1.0) * rng.uniform(0.2, 2.0, (len(unigram), states))
    move = np.ones((states, states)) + STAY * states * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(coded: DataFrame, n_classes: int, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``coded`` (``classes``): per round the tasks return their expected counts cell by cell,
    Spark sums them, and only the bounded table of sums comes back."""
    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_classes, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(x, np.uint16), minlength=n_classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_classes)), pa.array(counts)], names=["cell", "n"])

    def summed(run, size: int) -> np.ndarray:
        rows = coded.select("classes").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size, np.int64)
        out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
        return out

    unigram = summed(unigrams, n_classes).astype(np.float64)
    model = first_model(unigram, states)
    prior = (unigram + 1.0) / (unigram.sum() + n_classes)
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for _, texts in _buffered(batches):
                found = np.concatenate([x.ravel() for x in expected_counts(shared.value, texts)])
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.rint(total * UNIT).astype(np.int64))], names=["cell", "n"])

        found = summed(run, states + states * states + n_classes * states) / UNIT
        starts, moves, emits = found[:states], found[states:states + states**2].reshape(states, states), found[states + states**2:].reshape(n_classes, states)
        starts, moves, emits = starts + 1.0, moves + 1.0, emits + 10.0 * prior[:, None]
        model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return model


def forward_scores(coded: DataFrame, model: Model) -> DataFrame:
    """(row, forward): log10 of the probability of the class sequence."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _buffered(batches):
            yield pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), pa.array(log_likelihoods(shared.value, texts) / LN10)], names=["row", "forward"])

    return coded.select("row", "classes").mapInArrow(run, "row bigint, forward double")


def score_documents(docs: DataFrame, dictionary: int = DICTIONARY, own: int = OWN_CLASS, states: int = STATES, rounds: int = ROUNDS,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by a model trained on those whose crc32(key as text) mod 7 is not 2 (a null key trains).

    ``base_score`` is the add-one unigram score, ``score`` the model's log10 probability of the text and its end. A null
    text is empty (one token, its end). Words outside the dictionary get their counts by a join, once per text and word;
    each of them is rarer than any dictionary word, so none is a hot key.
    """
    need(docs, key, text)
    small_batches(docs)
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("doc_id"), held.alias("held_out"),
                       F.col(text).cast("binary").alias("body"))
    training = rows.filter(~F.col("held_out"))
    counts = token_counts(training.select("body"), lambda column: (blank_words(x.as_py()) for x in column), "word-counts")
    lex = lexicon(counts, training.count(), dictionary, own)
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    coded = written(code_texts(rows, shared), "coded-texts")
    model = train(coded.filter(~F.col("held_out")), lex.n_classes, states, rounds)
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("token"), F.col("r.n").alias("times"))
    looked = rare.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"),
        F.sum((F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).cast("decimal(38,15)")).cast("double").alias("rare_log"))
    joined = coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "count_log", "shared_log").join(
        looked, "row", "left").join(forward_scores(coded, model), "row")
    logs = F.col("count_log") + F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(lex.tokens + lex.distinct + 1))).alias("base_score"),
        (F.col("forward") + logs - F.col("shared_log")).alias("score"))
