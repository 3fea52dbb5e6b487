import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusmill.llm import id_files, mixing_coder, packing
from text_cases import frame


def round_trip(blocks):
    order = sorted(range(len(blocks)), key=lambda j: -len(blocks[j]))
    data = mixing_coder.encode([blocks[j] for j in order])
    back = mixing_coder.decode(data, [len(blocks[j]) for j in order])
    for j, got in zip(order, back):
        assert np.array_equal(got, blocks[j])
    return sum(map(len, data))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 255, 256, 50256, 65535]) | st.integers(0, 65535), min_size=1, max_size=700),
                min_size=1, max_size=5))
def test_any_blocks_come_back(blocks):
    round_trip([np.array(b, np.uint32) for b in blocks])


def test_whole_blocks_come_back():
    rng = np.random.default_rng(4)
    n = mixing_coder.BLOCK
    one = np.zeros(n, np.uint32)
    cycle = np.arange(n, dtype=np.uint32) % 7
    every = rng.permutation(65536)[:n].astype(np.uint32)
    skewed = np.minimum(rng.geometric(0.01, n), 65535).astype(np.uint32)
    late = np.concatenate([np.zeros(n - 300, np.uint32), np.arange(300, dtype=np.uint32)])
    sizes = [round_trip([b]) for b in (one, cycle, every, skewed, late)]
    assert sizes[0] < 60 and sizes[1] < 200  # predictions settle
    assert sizes[3] < 1.2 * n * 8.08 / 8  # ids of 8.08 bits each
    assert round_trip([one, cycle, every, skewed, late, late[:17], every[:1]]) == sum(sizes) + round_trip([late[:17]]) + round_trip([every[:1]])


def test_carries():
    """Many blocks, so that words of 0xFFFF with a carry behind them occur."""
    rng = np.random.default_rng(9)
    round_trip([rng.choice(4, 3000, p=[0.97, 0.01, 0.01, 0.01]).astype(np.uint32) for _ in range(300)])


def expected(rows):
    slow = Tokenizer.from_file(packing.byte_bpe_paths()[0])
    out, start = [], 0
    ids = [(d, np.array(slow.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in rows]
    by_doc = {}
    for d, i in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0)):
        by_doc.setdefault(d, []).append((start, len(i), zlib.crc32(i.tobytes())))
        out.append((d, len(i), zlib.crc32(i.tobytes())))
        start += len(i)
    return out, by_doc, start


def check(spark, rows):
    got = [tuple(r) for r in id_files.coded_ids(frame(spark, rows)).collect()]
    want, by_doc, total = expected(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((d, n, c) for d, _, n, c in got), key=key) == sorted(want, key=key)
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist() and sum(r[2] for r in got) == total
    docs = [r[0] for r in got]
    assert docs == sorted(docs, key=lambda d: (d is not None, d or 0))
    for d, start, n, crc in got:
        if len(by_doc[d]) == 1:  # ids that occur once have one place
            assert by_doc[d] == [(start, n, crc)]


def test_given_table(spark, small):
    check(spark, small)


def test_odd_rows(spark, odd):
    random.seed(2)
    long = " ".join(random.choice(["alpha", "beta", "日本", "##", "<|endoftext|>"]) for _ in range(30_000))  # over many blocks
    check(spark, odd + [(-5, "##"), (3, long), (4, long), (2**40, "x"), (7, "# ends with its own mark #")] + [(9, "same")] * 50)


def test_no_rows(spark):
    assert id_files.coded_ids(frame(spark, [])).collect() == []


def test_files_hold_the_ids(spark, small, tmp_path):
    path = str(tmp_path / "ids")
    id_files.write_ids(frame(spark, small[:60]), path, end=50256)
    slow = Tokenizer.from_file(packing.byte_bpe_paths()[0])
    rows = id_files.read_blocks(spark.read.parquet(path)).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["at"])):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert ids == {d: slow.encode(t or "", add_special_tokens=False).ids + [50256] for d, t in small[:60]}


@pytest.mark.parametrize("place", [0, 5, 30, 60, -1])
def test_damage_is_seen(place):
    ids = np.array([5, 6, 5, 6, 7], np.uint32)
    data = bytearray(id_files.pack_block(ids, mixing_coder.encode([ids])[0], 0, np.array([[1, 0, 0, 5]]), np.array([False])))
    assert id_files.unpack_block(bytes(data))[0] == 5
    data[place] ^= 16
    with pytest.raises(id_files.DamagedBlock):
        id_files.unpack_block(bytes(data))


def test_wrong_ids_are_seen():
    ids = np.array([5, 6, 5, 6, 7], np.uint32)
    other = mixing_coder.encode([np.array([5, 6, 5, 6, 8], np.uint32)])[0]
    data = id_files.pack_block(ids, other, 0, np.array([[1, 0, 0, 5]]), np.array([False]))
    with pytest.raises(id_files.DamagedBlock):
        list(id_files._read([0], [data], True))


def test_crc_parts_add_up():
    a, b, c = b"first part", b"x" * 1000, b"end"
    parts = np.array([zlib.crc32(a), zlib.crc32(b), zlib.crc32(c)], np.uint64)
    assert int(np.bitwise_xor.reduce(id_files._shifted(parts, np.array([1003, 3, 0])))) == zlib.crc32(a + b + c)


def test_a_large_block_shares_one_model():
    """A block may be longer than 4,096 ids; its lanes learn from each other."""
    rng = np.random.default_rng(6)
    phrases = [rng.integers(0, 50257, 8).astype(np.uint32) for _ in range(3000)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 3000, 40_001)])[:320_005]
    assert round_trip([ids]) < 0.8 * len(ids)  # alone, 4,096 ids hold most phrases once
    assert round_trip([ids[:2049], ids[:1025], ids[:1]]) > 0
