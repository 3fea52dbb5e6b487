"""Packing: right ids, no gaps, no overlaps, close to the fewest sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from text_cases import frame

from locusmill.llm import packing


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.byte_bpe_paths()[0])


@pytest.mark.parametrize("kind", ["small", "odd"])
def test_documents(spark, request, reference, kind):
    docs = request.getfixturevalue(kind)
    out = packing.packed_documents(frame(spark, docs)).collect()
    want = []
    for doc, text in docs:
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        first = len(ids) % 2048
        for k, n in enumerate(([first] if first else []) + [2048] * (len(ids) // 2048)):
            want.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
    assert sorted([tuple(r)[:5] for r in out], key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert set(places) == set(range(len(places)))
    total = sum(r.length for r in out)
    assert len(places) <= -(-total // 2048) * 1.1 + 1


def test_empty(spark):
    assert packing.packed_documents(frame(spark, [])).count() == 0


def test_same_ids(reference):
    """The faster encoder gives the same ids wherever it is used."""
    rng, encode = random.Random(4), packing.byte_bpe(packing.byte_bpe_paths())
    alphabet = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]] + list("  \n\n''stmdrevl")
    for n in [*range(0, 60), 500, 3000]:
        for _ in range(8):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("<|endoftext|>", "a<|endoftext|>b", "\x85\xa0　 日本 \U0001f600\x1c", "x" * 30000, " " * 3000 + "a", "\n" * 500):
        assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed,n,scale", [(1, 3000, 700), (2, 50, 300), (3, 200_000, 500), (4, 1, 5), (5, 4000, 3000)])
def test_plan(seed, n, scale):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.gamma(1.2, scale, n).astype(int) + 1, 1, 2048)
    count = np.bincount(lengths, minlength=2049)
    planned = packing.plan(count)
    used = Counter()
    for content, k in planned.items():
        assert sum(content) <= 2048 and k > 0
        for v in content:
            used[v] += k
    assert all(used[v] == c for v, c in enumerate(count) if c)
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    plain = sum(packing.best_fit(count, 2048).values())
    assert sum(planned.values()) <= max(plain * 1.002, least * 1.01) + 1
    slots = packing.Slots.of(planned)
    for v in np.flatnonzero(count)[:20]:
        sequence, offset = slots.find(np.full(count[v], v), np.arange(count[v]))
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == count[v]


def test_fit_reaches_the_minimum():
    """Repeat counts solve a small exact case."""
    rows = np.array([[1, 7, 0], [2, 6, 0], [1, 2, 5], [4, 4, 0], [2, 3, 3]])
    want = np.array([10.0, 0, 20, 15, 4])
    count = np.zeros(9)
    for r, k in zip(rows, want):
        for v in r:
            count[v] += k * (v > 0)
    x = packing.fit(rows, count, 0.0, rounds=2000)
    left = count.copy()
    for r, k in zip(rows, x):
        for v in r:
            left[v] -= k * (v > 0)
    assert np.abs(left[1:]).max() < 2 and (x >= 0).all()
