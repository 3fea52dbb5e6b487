"""Packing tokenised documents into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths reaches the driver (one count per length up
to the capacity).  Patterns of two or three lengths that fill a sequence
exactly are fitted to it, their repeat counts rounded down, and what is left is
packed best-fit on the histogram.  Pieces find their sequence from their rank
among the pieces of their length, so no task sees more than its own pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import stable
from .words import each_batch

CAPACITY = 2048
ROUNDS = 200
BLOCK = 4096

_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
_TOKENIZERS: dict[str, Callable] = {}


def byte_bpe_paths() -> tuple[str, str]:
    """The two files of the public byte-level vocabulary: of ``tokenizers`` and of ``tiktoken``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_bpe(paths: tuple[str, str]) -> Callable[[str], np.ndarray]:
    """text -> ids of ``tokenizers`` without special tokens added.

    Texts of plain Latin characters go through the same vocabulary's faster
    encoder, which gives the same ids there; others, and texts that spell a
    special token, through ``tokenizers`` itself.  One instance per worker.
    """
    if paths not in _TOKENIZERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(paths[1], "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list = []

        def encode(text: str) -> np.ndarray:
            if "<|" not in text and not _PLAIN.search(text):
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), "<u4")
            if not slow:
                slow.append(Tokenizer.from_file(paths[0]))
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

        _TOKENIZERS[paths] = encode
    return _TOKENIZERS[paths]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of ``n`` ids; only the first may be shorter than the capacity."""
    whole, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * whole


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """Written table of doc_id, piece, start, length, ids_crc32, part and the rank of each piece among its part's of that length."""
    paths = paths or byte_bpe_paths()

    def run(batches):
        encode, seen, part = byte_bpe(paths), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            doc, rows = batch.column("doc_id").to_pylist(), []
            for d, text in zip(doc, batch.column("_text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                start = 0
                for k, length in enumerate(cut(len(ids), capacity)):
                    rows.append((d, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
                    start += length
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return stable(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, at long"))


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All sets of two or three of ``lengths`` that fill the capacity exactly, one row each (0: no third)."""
    have = np.zeros(capacity + 1, bool)
    have[lengths[lengths < capacity]] = True
    one = np.flatnonzero(have)
    two = one[(one <= capacity - one) & have[capacity - one]]
    found = [np.stack([two, capacity - two, np.zeros_like(two)], 1)]
    for a in one[3 * one <= capacity]:
        b = one[(one >= a) & (2 * one <= capacity - a)]
        c = capacity - a - b
        b = b[have[c]]
        found.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(found)


def fit(rows: np.ndarray, count: np.ndarray, power: float = 0.0, rounds: int = ROUNDS, block: int = BLOCK) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' total use of each length near ``count``.

    Least squares, where a length counts by its share of the longest to the
    given power.  Block coordinate descent: each round takes the patterns with
    the steepest gain that have no length in common and moves each to its own
    minimum.
    """
    weight = (np.arange(len(count)) / max(len(count) - 1, 1)) ** power
    weight[0] = 0.0
    x, left = np.zeros(len(rows)), count.astype(float)
    times = np.stack([(rows == rows[:, [k]]).sum(1) for k in range(3)], 1)
    norm = (weight[rows] * times).sum(1)
    for _ in range(rounds):
        step = np.maximum((weight[rows] * left[rows]).sum(1) / norm, -x)
        worth = np.abs(step) * norm
        top = np.argpartition(-worth, block)[:block] if len(worth) > block else np.arange(len(worth))
        top = top[np.argsort(-worth[top], kind="stable")]
        if not len(top) or abs(step[top[0]]) < 0.5:
            break
        used, chosen = set(), []
        for p, lengths in zip(top.tolist(), rows[top].tolist()):
            mine = {v for v in lengths if v}
            if used.isdisjoint(mine):
                used |= mine
                chosen.append(p)
        x[chosen] += step[chosen]
        np.subtract.at(left, rows[chosen].ravel(), np.repeat(step[chosen], 3))
    return x


def best_fit(count: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing on a histogram: {lengths of a sequence: how many such sequences}."""
    free: dict[int, Counter] = {}
    rooms: list[int] = []

    def add(room: int, content: tuple, n: int) -> None:
        if room not in free:
            bisect.insort(rooms, room)
            free[room] = Counter()
        free[room][content] += n

    for length in np.flatnonzero(count)[::-1].tolist():
        todo = int(count[length])
        while todo:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = min(capacity // length, todo)
                n = todo // each
                add(capacity - each * length, (length,) * each, n)
                todo -= n * each
                continue
            room = rooms[k]
            content, n = next(iter(free[room].items()))
            n = min(n, todo)
            free[room][content] -= n
            if not free[room][content]:
                del free[room][content]
            if not free[room]:
                del free[room]
                rooms.pop(k)
            add(room - length, (*content, length), n)
            todo -= n
    out: Counter = Counter()
    for held in free.values():
        out.update(held)
    return out


def plan(count: np.ndarray, capacity: int = CAPACITY, powers: tuple[float, ...] = (0.0, 2.0)) -> Counter:
    """{lengths of a sequence: how many such sequences} that use up a histogram of piece lengths.

    Fits with each weighting and keeps the plan with the fewest sequences: plain
    least squares wins where lengths are well filled, weighted where few pieces
    must fill the room beside long ones.
    """
    rest = count.astype(np.int64).copy()
    rest[capacity] = 0
    rows = patterns(np.flatnonzero(rest), capacity)
    plans = [_planned(rows, rest, power, capacity) for power in powers]
    out = min(plans, key=lambda found: sum(found.values()))
    if count[capacity]:
        out[(capacity,)] += int(count[capacity])
    return out


def _planned(rows: np.ndarray, count: np.ndarray, power: float, capacity: int) -> Counter:
    left, out = count.copy(), Counter()
    x = fit(rows, left, power) if len(rows) else np.zeros(0)
    for p in np.argsort(-x, kind="stable")[: int((x >= 1).sum())].tolist():
        need = Counter(v for v in rows[p].tolist() if v)
        n = min(int(x[p]), *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            out[tuple(sorted(need.elements(), reverse=True))] += n
            for v, k in need.items():
                left[v] -= n * k
    out.update(best_fit(left, capacity))
    return out


@dataclass
class Slots:
    """Where the pieces of each length go: runs of ranks with their first sequence and their offset."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    SHIFT = 48

    @classmethod
    def of(cls, planned: Counter) -> Slots:
        used, first, rows = Counter(), 0, []
        for lengths, n in sorted(planned.items(), reverse=True):
            offset = 0
            for v in lengths:
                rows.append((v << cls.SHIFT | used[v], first, offset))
                used[v] += n
                offset += v
            first += n
        rows.sort()
        key, sequence, offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        return cls(key, sequence, offset)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << self.SHIFT | rank, side="right") - 1
        return self.sequence[at] + rank - (self.key[at] & ((1 << self.SHIFT) - 1)), self.offset[at]


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; sequences are numbered from 0 without gaps."""
    parts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = parts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most one row per length
    count = np.zeros(capacity + 1, np.int64)
    for row in total:
        count[row["length"]] = row["n"]
    slots = Slots.of(plan(count, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    base = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batch: pa.RecordBatch):
        length = batch.column("length").to_numpy()
        sequence, offset = slots.find(length, batch.column("at").to_numpy() + batch.column("base").to_numpy())
        return pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
        )

    return found.join(base, ["part", "length"]).mapInArrow(
        each_batch(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces and places.

    A document's ids are its byte-level BPE ids and id 0 after them; NULL and
    empty texts are the 0 alone.  Repeated rows and rows with a NULL id are
    packed like any others; an empty table has no pieces.  Other columns are
    left out, so their names cannot clash.
    """
    return pack(pieces(docs, id_col, text_col, capacity), capacity)
