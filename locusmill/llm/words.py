"""Words of many texts at once, as arrays inside a task.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8
is the same as ``[^\\x20\\x09-\\x0D]+`` over characters.  Words get 64-bit
multilinear hashes of their bytes; a second, independent hash makes 128 bits
where equality must hold over very many words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random multipliers; a longer list starts with a shorter one."""
    with np.errstate(over="ignore"):
        counter = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 % 2**64)
        return mix(counter) | _U(1)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of consecutive rows: byte ranges in ``raw``, and the first word of each row (plus the end)."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def left(self) -> np.ndarray:
        """How many words of its row are left from each word on, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))

    def hashes(self, seed: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, _U)
        size = self.end - self.start
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        value = self.raw[place + np.repeat(self.start, size)].astype(_U) + _U(1)
        value *= multipliers(int(size.max()), seed)[place]
        return mix(np.add.reduceat(value, at) + size.astype(_U) * _U(0x9E3779B97F4A7C15))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows that ``offsets`` delimits; ``lower`` turns A-Z to a-z."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw, offsets = raw[lo:hi], offsets - lo
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < hi - lo)]
    starts = inside & ~before
    starts[cuts] = inside[cuts]
    start = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    end = np.flatnonzero(ends) + 1
    return Words(raw, start, end, np.searchsorted(start, offsets))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` entries (rows are not kept apart: mask by what is left)."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, _U)
    for j, m in enumerate(multipliers(k, seed + 101)):
        out += h[j : j + n] * m
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def each_batch(fn):
    """A mapInArrow function that applies ``fn(batch)`` and drops empty results."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return run


def each_part(fn):
    """A mapInArrow function that hands on what ``fn(batch)`` yields, part by part, but empty parts."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from (out for out in fn(batch) if out.num_rows)

    return run
