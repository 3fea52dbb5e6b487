"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Words outside the model's vocabulary are one entry of it, and share its
probability by their smoothed counts, so every token has a normalised
probability.  Counts cover all training documents.  Training covers all of
them too: every task runs stochastic gradient steps over its own documents from
the same start, and the parameters are averaged, weighted by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import stable
from .words import blocks, signed, texts, words

VOCABULARY = 1000
HEAD = 100_000
"""Counts of so many words are sent to every task; counts of all others are joined."""

SIZE = 16
CONTEXT = 2
NOISE = 64
BATCH = 8192
END = np.int64(-1)
"""The entry that stands for the end of a text."""

_FLUSH = 1 << 22


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7 (a NULL id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row in lower case with END after each, and where each row begins (plus the end)."""
    found = words(raw, at, lower=True)
    h = signed(found.hashes())
    h[h == END] = 0
    n = len(found.first) - 1
    out = np.full(len(h) + n, END, np.int64)
    out[np.arange(len(h)) + found.row()] = h
    return out, found.first + np.arange(n + 1)


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs in ``text`` of all rows; words are 64-bit hashes."""

    def merged(parts):
        key = np.concatenate([p[0] for p in parts])
        weight = np.concatenate([p[1] for p in parts])
        key, where = np.unique(key, return_inverse=True)
        return key, np.bincount(where, weights=weight, minlength=len(key)).astype(np.int64)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            raw, at = texts(batch.column(0))
            for lo, hi in blocks(at):
                key, count = np.unique(_tokens(raw, at[lo : hi + 1])[0], return_counts=True)
                parts.append((key, count))
                held += len(key)
                if held > _FLUSH:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > _FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["word", "c"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["word", "c"])

    rows = docs.select("text").mapInArrow(run, "word long, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Parameters; entry ``len(vocab)`` stands for all other words, the one after for what precedes a text."""

    vocab: np.ndarray  # sorted hashes
    noise: np.ndarray  # probability of each entry in the training documents
    context: np.ndarray
    target: np.ndarray
    mixing: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, vocab: np.ndarray, counts: np.ndarray, total: int, size: int = SIZE) -> Model:
        n = len(vocab)
        share = np.append(counts, max(total - counts.sum(), 0)).astype(float) + 0.5
        share /= share.sum()
        rng = np.random.default_rng(11)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        mixing = np.stack([np.eye(size, dtype=np.float32) / (k + 1) for k in range(CONTEXT)])
        return cls(vocab, share, draw(n + 2, size), draw(n + 1, size), mixing, np.log(share).astype(np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.mixing, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()]).astype(float)

    def with_flat(self, values: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parameters():
            out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(self.vocab, self.noise, *out)

    def entries(self, tokens: np.ndarray) -> np.ndarray:
        n = len(self.vocab)
        if not n:
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, tokens), n - 1)
        return np.where(self.vocab[at] == tokens, at, n)

    def contexts(self, entries: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The entries one, two, ... places before each token of its own text."""
        begin, out = len(self.vocab) + 1, []
        size = np.diff(first)
        place = np.arange(len(entries)) - np.repeat(first[:-1], size)
        for k in range(1, CONTEXT + 1):
            before = np.full(len(entries), begin, np.int64)
            before[k:] = entries[:-k] if k < len(entries) else before[k:]
            out.append(np.where(place >= k, before, begin))
        return out

    def predicted(self, contexts: list[np.ndarray]) -> np.ndarray:
        return sum(self.context[c] @ m for c, m in zip(contexts, self.mixing))

    def log_normaliser(self, contexts: list[np.ndarray], rows: int = 4096) -> np.ndarray:
        out = np.empty(len(contexts[0]))
        for at in range(0, len(out), rows):
            score = self.predicted([c[at : at + rows] for c in contexts]) @ self.target.T + self.bias
            top = score.max(1, keepdims=True)
            out[at : at + rows] = np.log(np.exp(score - top).sum(1, dtype=float)) + top[:, 0]
        return out


class _Trainer:
    """Adagrad steps on the noise-contrastive objective, noise words shared within a batch."""

    def __init__(self, model: Model, seed: int, rate: float = 0.1):
        self.model, self.rate = model, rate
        self.squares = [np.full(p.shape, 1e-4, np.float32) for p in model.parameters()]
        self.rng = np.random.default_rng(seed)
        self.edges = np.cumsum(model.noise)
        self.log_noise = (np.log(model.noise) + np.log(NOISE)).astype(np.float32)

    def _scatter(self, rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((n, values.shape[1]), np.float32)
        for k in range(values.shape[1]):
            out[:, k] = np.bincount(rows, weights=values[:, k], minlength=n)
        return out

    def step(self, entries: np.ndarray, contexts: list[np.ndarray]) -> None:
        m, b = self.model, len(entries)
        hat = m.predicted(contexts)
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(m.noise) - 1)
        own = (hat * m.target[entries]).sum(1) + m.bias[entries] - self.log_noise[entries]
        false = hat @ m.target[noise].T + m.bias[noise] - self.log_noise[noise]
        g_own = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        g_false = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        n = len(m.noise)
        g_target = self._scatter(entries, g_own[:, None] * hat, n)
        np.add.at(g_target, noise, g_false.T @ hat)
        g_bias = np.bincount(entries, weights=g_own, minlength=n).astype(np.float32)
        np.add.at(g_bias, noise, g_false.sum(0))
        g_hat = g_own[:, None] * m.target[entries] + g_false @ m.target[noise]
        g_context, g_mixing = np.zeros_like(m.context), np.empty_like(m.mixing)
        for k, c in enumerate(contexts):
            g_mixing[k] = m.context[c].T @ g_hat
            g_context += self._scatter(c, g_hat @ m.mixing[k].T, len(m.context))
        for p, s, g in zip(m.parameters(), self.squares, (g_context, g_target, g_mixing, g_bias)):
            g = g / b
            s += g * g
            p += self.rate * g / np.sqrt(s)


def _training_rows(model: Model):
    """One task's trained parameters, as (place, value times tokens, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]):
        mine = model.with_flat(model.flat())
        trainer, seen = _Trainer(mine, 17), 0
        for batch in batches:
            raw, at = texts(batch.column(0))
            for lo, hi in blocks(at):
                tokens, first = _tokens(raw, at[lo : hi + 1])
                entries = mine.entries(tokens)
                contexts = mine.contexts(entries, first)
                order = np.random.default_rng(len(tokens)).permutation(len(tokens))
                for cut in range(0, len(order), BATCH):
                    pick = order[cut : cut + BATCH]
                    trainer.step(entries[pick], [c[pick] for c in contexts])
                seen += len(tokens)
        if seen:
            flat = mine.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))],
                names=["place", "value", "weight"],
            )

    return run


def train(docs: DataFrame, counts: DataFrame, total: int, vocabulary: int = VOCABULARY, rounds: int = 1) -> Model:
    """A model of ``text`` of all rows; its vocabulary are the ``vocabulary`` most frequent tokens.

    Ties go to the smaller hash.  The driver sees the vocabulary and one set of
    averaged parameters.  No rows or no tokens: a model with one entry.
    """
    top = counts.orderBy(F.desc("c"), "word").limit(vocabulary).toArrow()  # at most ``vocabulary`` rows
    word, c = top.column("word").to_numpy().astype(np.int64), top.column("c").to_numpy().astype(np.int64)
    order = np.argsort(word)
    model = Model.start(word[order], c[order], total)
    for _ in range(rounds):
        rows = docs.select("text").mapInArrow(_training_rows(model), "place long, value double, weight long")
        mean = rows.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()  # one set of parameters
        if mean.num_rows:
            values = np.empty(mean.num_rows)
            values[mean.column("place").to_numpy()] = mean.column("value").to_numpy()
            model = model.with_flat(values)
    return model


@dataclass
class Counts:
    """Counts that every task gets: the ``HEAD`` most frequent tokens, and the totals."""

    word: np.ndarray
    c: np.ndarray
    total: int
    distinct: int

    @property
    def divisor(self) -> int:
        return self.total + self.distinct + 1


def _scored(model: Model, known: Counts):
    """Per row what the task can tell; ``tail`` lists the words whose counts must be joined."""
    small = np.array([0], np.int64)
    word, c = (known.word, known.c) if len(known.word) else (small, np.array([-1], np.int64))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "lbl", "n_rest", "rest_logs", "tail"]

    def run(batches):
        width = len(model.vocab) + 2
        memo = np.full(width * width, np.nan)
        for batch in batches:
            raw, at = texts(batch.column("text"))
            for lo, hi in blocks(at):
                tokens, first = _tokens(raw, at[lo : hi + 1])
                n, row = np.diff(first), np.repeat(np.arange(hi - lo), np.diff(first))
                place = np.minimum(np.searchsorted(word, tokens), len(word) - 1)
                head = (word[place] == tokens) & (c[place] > 0)
                log = np.where(head, np.log10(np.maximum(c[place], 0) + 1.0), 0.0)
                entries = model.entries(tokens)
                contexts = model.contexts(entries, first)
                key = contexts[0] * width + contexts[1]
                new = np.unique(key[np.isnan(memo[key])])
                if len(new):
                    memo[new] = model.log_normaliser([new // width, new % width])
                score = (model.predicted(contexts) * model.target[entries]).sum(1, dtype=float) + model.bias[entries] - memo[key]
                rest = entries == len(model.vocab)
                total = lambda v: pa.array(np.bincount(row, weights=v, minlength=hi - lo))
                whole = lambda v: pa.array(np.bincount(row, weights=v, minlength=hi - lo).astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=~head, minlength=hi - lo))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[~head]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(n),
                     whole(head), total(log), total(score / np.log(10)), whole(rest), total(log * rest), tail],
                    names=names,
                )

    return run


def lbl_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: int = VOCABULARY, head: int = HEAD, rounds: int = 1,
) -> DataFrame:
    """Base and model scores of every row, learned from the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (both log10 probabilities of the whole text and its end).  NULL and
    empty texts have one token, the end; repeated rows are scored one by one;
    without training rows the base is that of an empty count table.  Other
    columns are left out, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).withColumn("held_out", held_out("doc_id"))
    training = docs.where(~F.col("held_out"))
    counts = stable(token_counts(training))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = train(training, counts, totals[0], vocabulary, rounds)
    top = counts.orderBy(F.desc("c"), "word").limit(max(head, vocabulary)).toArrow()  # at most ``head`` rows
    word, c = top.column("word").to_numpy().astype(np.int64), top.column("c").to_numpy().astype(np.int64)
    order = np.argsort(word)
    known = Counts(word[order], c[order], totals[0], totals[1])
    kinds = ("doc_id long, held_out boolean, n_tokens long, n_known long, logs double, lbl double, n_rest long, "
             "rest_logs double, tail array<long>")
    rows = stable(docs.mapInArrow(_scored(model, known), kinds).withColumn("row", F.monotonically_increasing_id()))
    tails = rows.select("row", F.explode("tail").alias("word")).join(counts, "word")
    joined = tails.groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("tail_logs"))
    share = int(c[: len(model.vocab)].sum()) + len(model.vocab)  # smoothed counts of the model's own entries
    rest = max(known.divisor - share, 1)
    tail_known, tail_logs = (F.coalesce(x, F.lit(0)) for x in ("tail_known", "tail_logs"))
    return rows.join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + tail_known).alias("n_known"),
        F.lit(totals[0]).cast("long").alias("train_tokens"),
        (F.col("logs") + tail_logs - F.col("n_tokens") * float(np.log10(known.divisor))).alias("base_score"),
        (F.col("lbl") + F.col("rest_logs") + tail_logs - F.col("n_rest") * float(np.log10(rest))).alias("score"),
    )
