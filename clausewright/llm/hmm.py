"""A hidden Markov language model over words.

Latent states emit word classes, and a class emits its words: log P(word | state) = log P(class | state) + log P(word |
class). Classes are the most frequent training words, one each, and for all others the hash of their last letters; so the
model that Baum-Welch trains has a bounded size, while word counts are exact for every word of the corpus. Expected
counts are made by each task for its documents by the scaled forward and backward recursions, and Spark adds them
up; a first guess comes from a bounded sample, then every training document takes part in every round, until a round
gains little. Scoring runs the
scaled forward recursion over the whole text, so the likelihood is exact.

Counts reach the scorer by blocks: documents lie in blocks of about ``block_bytes`` bytes of text; a block asks for its
distinct words, the join with the counts answers, and both meet in the block. No task holds the vocabulary. Words are 64-bit hashes.

The class of words that the training never saw has one pseudo word for them, as the base score has: (c + 1) / (n of the class +
words of the class + 1).

Defined results: null and empty texts have one token, the end; no training documents give counts of 0; repeated rows are
scored alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import array_pieces, checkpointed, drawn, in_small_batches, most_frequent, pieces
from clausewright.llm._words import Words, mix

#: The hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


class Tokens:
    """Hashes and last letters of the tokens of texts, an end after each text."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        ends = words.first[1:] + np.arange(len(words.counts))
        n = len(words.starts) + len(words.counts)
        inside = np.ones(n, bool)
        inside[ends] = False
        self.counts = words.counts + 1
        self.hashes = np.full(n, END, np.uint64)
        self.hashes[inside] = words.hashes()
        tail = np.zeros(len(words.starts), np.uint64)
        for back in (1, 2, 3):
            at = words.ends - back
            letter = np.where(at >= words.starts, words.data[np.maximum(at, 0)], 0).astype(np.uint64)
            tail = tail * np.uint64(257) + np.where((back == 1) & (letter < 64), np.uint64(1), letter)
        self.tails = np.zeros(n, np.uint64)
        self.tails[inside] = mix(tail)


@dataclass
class Classes:
    """``frequent``: sorted hashes of the words that are classes of their own; others share ``tails`` classes."""

    frequent: np.ndarray
    tails: int

    @property
    def n(self) -> int:
        return len(self.frequent) + self.tails

    @property
    def kind(self) -> type:
        return np.uint16 if self.n <= 1 << 16 else np.uint32

    def of(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        out = len(self.frequent) + (tails % np.uint64(self.tails)).astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == hashes, at, out)
        return out


@dataclass
class HiddenMarkov:
    """``first`` (states), ``move`` (states x states), ``emit`` (classes x states): probabilities."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def guess(cls, states: int, classes: int, seed: int) -> HiddenMarkov:
        rng = np.random.default_rng(seed)
        emit = rng.dirichlet(np.full(states, 2.0), classes)
        return cls(np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), emit / emit.sum(0))

    @classmethod
    def of_counts(cls, counts: np.ndarray, states: int, classes: int) -> HiddenMarkov:
        """From expected counts of first states, moves and emissions in one array, smoothed; what follows them is not used."""
        first, move, emit, _ = np.split(counts, (states, states + states * states, states + states * states + classes * states))
        first, move, emit = first + 1, move.reshape(states, states) + 1, emit.reshape(classes, states) + 0.01
        return cls(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def _steps(self, classes: np.ndarray, lengths: np.ndarray, keep: bool, kind: type):
        """The scaled forward recursion. Sequences lie one after another in ``classes``; all go a step at a time, the longest first,
        and what belongs to a step lies together, so each step works on one run of rows."""
        order = np.argsort(-lengths, kind="stable")
        live = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
        ends = np.cumsum(live)
        which = np.arange(len(classes)) - np.repeat(ends - live, live)  # the sequence, by falling length
        at = (np.cumsum(lengths) - lengths)[order][which] + np.repeat(np.arange(len(live)), live)
        classes = classes[at]
        emit, move = self.emit.astype(kind), self.move.astype(kind)
        scales, alpha = np.empty(len(classes), kind), np.empty((len(classes), len(self.first)), kind) if keep else None
        now, rows = None, emit[classes] if keep else None
        low = 0
        for n, high in zip(live.tolist(), ends.tolist(), strict=True):
            here = rows[low:high] if keep else emit[classes[low:high]]
            now = here * self.first.astype(kind) if now is None else (now[:n] @ move) * here
            scale = now.sum(1)
            now /= scale[:, None]
            scales[low:high] = scale
            if keep:
                alpha[low:high] = now
            low = high
        total = np.empty(len(lengths))
        total[order] = np.bincount(which, np.log(scales), len(lengths))
        return total, classes, alpha, scales, rows, live

    def forward(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact log likelihoods (natural) of the sequences."""
        return self._steps(classes, lengths, False, np.float64)[0]

    def expected(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of first states, moves and emissions, and then the log likelihood of all; recursions in single precision."""
        total, classes, alpha, scales, rows, live = self._steps(classes, lengths, True, np.float32)
        states = len(self.first)
        rows /= scales[:, None]
        beta = np.ones_like(alpha)
        move = np.zeros((states, states))
        back = np.ascontiguousarray(self.move.T, np.float32)
        high = len(classes)
        for n, before in zip(live[:0:-1].tolist(), live[-2::-1].tolist(), strict=True):
            low = high - n
            ahead = rows[low:high] * beta[low:high]
            move += alpha[low - before : low - before + n].T @ ahead
            beta[low - before : low - before + n] = ahead @ back
            high = low
        alpha *= beta
        emit = np.stack([np.bincount(classes, alpha[:, s], len(self.emit)) for s in range(states)], axis=1)
        return np.concatenate((alpha[: live[0] if len(live) else 0].sum(0), (self.move * move).reshape(-1), emit.reshape(-1), [total.sum()]))


def _word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n, of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most=1 << 22):
                tokens = Tokens(part.column("text"))
                words, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(tokens.tails[first].view(np.int64)), pa.array(n)], ["word", "tail", "n"])

    return docs.select("text").mapInArrow(run, "word long, tail long, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


def _class_rows(docs: DataFrame, classes: Classes) -> DataFrame:
    """seen (the classes of a text's tokens, packed): what the rounds read instead of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    @F.arrow_udf("binary")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            for part in array_pieces(array):
                tokens = Tokens(part)
                own = shared.value.of(tokens.hashes, tokens.tails).astype(shared.value.kind)
                ends = (np.append(0, np.cumsum(tokens.counts)) * own.itemsize).astype(np.int32)
                yield pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(own)])

    return docs.select(of(F.coalesce("text", F.lit(""))).alias("seen"))


def _expected_counts(seen: DataFrame, model: HiddenMarkov, classes: Classes) -> np.ndarray:
    """Expected counts over all documents, and the log likelihood: each task adds up its own, Spark adds up the cells."""
    spark = seen.sparkSession
    shared = spark.sparkContext.broadcast((model, classes.kind))  # (states + 1) * classes numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kind = shared.value
        total = None
        for batch in batches:
            for part in pieces(batch, "seen", 1 << 20):
                rows = part.column("seen")
                got = model.expected(np.frombuffer(b"".join(x.as_buffer() for x in rows), kind).astype(np.int64), np.array([len(x.as_buffer()) for x in rows]) // np.dtype(kind).itemsize)
                total = got if total is None else total + got
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "x"])

    cells = seen.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    states = len(model.first)
    out = np.zeros(states + states * states + classes.n * states + 1)
    for r in cells:
        out[r["cell"]] = r["x"]
    return out


@dataclass
class LanguageModel:
    counts: DataFrame
    tokens: int
    words: int
    classes: Classes
    class_tokens: np.ndarray
    class_words: np.ndarray
    model: HiddenMarkov


def train(docs: DataFrame, states: int = 6, frequent: int = 4096, tails: int = 2048, least_gain: float = 0.003, most_rounds: int = 8, sample_rows: int = 1000, sample_letters: int = 2048, sample_rounds: int = 15, seed: int = 3) -> LanguageModel:
    """A model of all ``docs``.

    The first guess is fitted to a sample: of ``sample_rows`` documents of any length, the first by a hash, a slice of
    ``sample_letters`` letters from the middle. Then all documents, whole, take part in each round of Baum-Welch; rounds
    end as soon as one has gained less than ``least_gain`` of natural log likelihood a token over the one before, or after
    ``most_rounds``.
    """
    docs = in_small_batches(docs).select("doc_id", "text")
    counts = checkpointed(_word_counts(docs))
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    top = most_frequent(counts, frequent).select("word", "n").collect()  # at most ``frequent`` rows
    classes = Classes(np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64)), tails)
    known = [int(np.int64(x)) for x in classes.frequent.view(np.int64)]
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(x,) for x in known], "word long")), "word", "left_anti")  # at most ``frequent`` rows
    by_tail = rest.groupBy(_unsigned_mod("tail", tails).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("w")).collect()
    class_tokens, class_words = np.zeros(classes.n), np.zeros(classes.n)
    for r in top:
        at = int(np.searchsorted(classes.frequent, np.int64(r["word"]).view(np.uint64)))
        class_tokens[at], class_words[at] = r["n"], 1
    for r in by_tail:
        class_tokens[len(classes.frequent) + r["c"]], class_words[len(classes.frequent) + r["c"]] = r["n"], r["w"]
    model = HiddenMarkov.guess(states, classes.n, seed)
    if tokens:
        middle = F.greatest(F.lit(1), F.floor(F.length("text") / 2) - sample_letters // 2).cast("int")
        sample = drawn(docs.where("text IS NOT NULL").select(F.substring("text", middle, F.lit(sample_letters)).alias("text"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw")), sample_rows, F.col("draw")).collect()
        held = Tokens(pa.array([r["text"] for r in sample] or [""], pa.string()))
        own = classes.of(held.hashes, held.tails)
        for _ in range(sample_rounds):
            model = HiddenMarkov.of_counts(model.expected(own, held.counts), states, classes.n)
        seen = checkpointed(_class_rows(docs, classes))
        last = -np.inf
        for _ in range(most_rounds):
            found = _expected_counts(seen, model, classes)
            model = HiddenMarkov.of_counts(found, states, classes.n)
            if found[-1] - last < least_gain * tokens:
                break
            last = found[-1]
    return LanguageModel(counts, int(tokens), int(words), classes, class_tokens, class_words, model)


def _unsigned_mod(column: str, n: int) -> Column:
    """The remainder of a 64-bit integer taken as unsigned."""
    high = (2**64) % n
    return F.pmod(F.pmod(F.col(column), F.lit(n)) + F.when(F.col(column) < 0, high).otherwise(0), F.lit(n)).cast("int")


def score(docs: DataFrame, lm: LanguageModel, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    docs = in_small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).head()
    blocks = max(1, -(-(size["n"] + 16 * size["rows"]) // block_bytes))
    # By the row's place in its file, so that repeated rows and rows without doc_id are dealt evenly too.
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def ask(block: pa.Table) -> pa.Table:
        words = [np.zeros(0, np.uint64)]
        for batch in block.to_batches():
            words += [np.unique(Tokens(part.column("text")).hashes) for part in pieces(batch)]
        words = np.unique(np.concatenate(words))
        return pa.table({"word": pa.array(words.view(np.int64)), "block": pa.array(np.full(len(words), block.column("block")[0].as_py(), np.int32))})

    # Both groupings of the same rows: the texts are shuffled once.
    asked = docs.groupBy("block").applyInArrow(ask, "word long, block int")
    answers = asked.join(lm.counts.select("word", "n"), "word").select("block", "word", "n")
    shared = docs.sparkSession.sparkContext.broadcast((lm.model, lm.classes, lm.class_tokens, lm.class_words))
    tokens_n, words_n = lm.tokens, lm.words

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        model, classes, class_tokens, class_words = shared.value
        order = np.argsort(known := right.column("word").to_numpy().view(np.uint64))
        known, counts = known[order], right.column("n").to_numpy()[order]
        out = []
        for batch in left.to_batches():
            # As many texts as a batch has: a step of the recursion takes all of them along.
            for part in pieces(batch, most=1 << 22):
                tokens = Tokens(part.column("text"))
                c = np.zeros(len(tokens.hashes))
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens.hashes), len(known) - 1)
                    c = np.where(known[at] == tokens.hashes, counts[at], 0)
                own = classes.of(tokens.hashes, tokens.tails)
                starts = np.cumsum(tokens.counts) - tokens.counts
                base = np.add.reduceat(np.log10((c + 1) / (tokens_n + words_n + 1)), starts)
                word = np.add.reduceat(np.log10((c + 1) / (class_tokens[own] + class_words[own] + 1)), starts)
                chain = model.forward(own, tokens.counts) / np.log(10)
                seen = np.add.reduceat((c > 0).astype(np.int64), starts)
                out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens.counts), pa.array(seen), pa.array(np.full(len(seen), tokens_n)), pa.array(base), pa.array(word + chain)], _SCORED))
        return pa.Table.from_batches(out, _SCORED_SCHEMA)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORED = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_SCORED_SCHEMA = pa.schema([(n, pa.float64() if n.endswith("score") else pa.int64()) for n in _SCORED])
