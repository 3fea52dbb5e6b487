"""Token ids as files of checksummed, range-coded blocks.

Documents are sorted by id over all tasks.  Each task encodes its range and
cuts the ids into blocks of some millions that the coder of ``mixing_coder``
compresses one by one.  A file row is a block: part (the range's number), number of the block in
its part, how many ids it holds, and its bytes.  Spark writes and commits the
files, so a lost executor leaves none behind, and any reader of Spark's finds
them.

Bytes of a block, little-endian: ``LMID``; ids, documents and payload bytes as
unsigned 32-bit numbers; the place of its first id in the part as 64 bits; the
CRC-32 of its ids; for each document that reaches into it id, ordinal in the
part, place of the block's first id of it, and all its ids, 64 bits each, and a
byte that is 1 where the document has no id; the payload; the CRC-32 of all
before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import scratch_path, stable
from .mixing_coder import decode, encode
from .packing import byte_bpe_paths
from .piece_ids import piece_ids

MAGIC = b"LMID"
HEAD = "<4sIIIQI"
IDS = 1 << 21
"""Least ids of a block that is not its part's only one; a block has fewer than twice as many."""
END = 2


class DamagedBlock(ValueError):
    """A block whose bytes do not agree with their checksums."""


def pack_block(ids: np.ndarray, payload: bytes, first: int, docs: np.ndarray, missing: np.ndarray) -> bytes:
    """One block's bytes; ``docs`` has a row (id, ordinal, place, total) for each document in it."""
    head = struct.pack(HEAD, MAGIC, len(ids), len(docs), len(payload), first, zlib.crc32(ids.astype("<u4").tobytes()))
    body = head + docs.astype("<i8").tobytes() + missing.astype(np.uint8).tobytes() + payload
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(data: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray, bytes]:
    """(ids, place of the first, CRC-32 of the ids, documents, which have no id, payload)."""
    if len(data) < struct.calcsize(HEAD) + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise DamagedBlock("a block's bytes do not agree with its checksum")
    magic, n, n_docs, size, first, crc = struct.unpack_from(HEAD, data)
    at = struct.calcsize(HEAD)
    if magic != MAGIC or len(data) != at + 33 * n_docs + size + 4:
        raise DamagedBlock("not a block of ids")
    docs = np.frombuffer(data, "<i8", 4 * n_docs, at).reshape(n_docs, 4)
    missing = np.frombuffer(data, np.uint8, n_docs, at + 32 * n_docs)
    return n, first, crc, docs, missing, data[at + 33 * n_docs : -4]


class _Writer:
    """Ids and documents of one part that are not yet in a block."""

    def __init__(self, part: int):
        self.part, self.first, self.block = part, 0, 0
        self.waiting, self.size = [], 0
        self.docs: list[tuple[int, int, int, int]] = []  # id, ordinal, place in the part, total
        self.missing: list[bool] = []
        self.seen = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, self.seen, self.first + self.size, len(ids)))
        self.missing.append(doc is None)
        self.waiting.append(ids)
        self.size += len(ids)
        self.seen += 1

    def blocks(self, whole: bool) -> Iterator[pa.RecordBatch]:
        """Waiting ids as blocks, one at a time; what may still grow waits for the end."""
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        docs, missing = np.array(self.docs, np.int64).reshape(-1, 4), np.array(self.missing, bool)
        done = 0
        while (left := len(ids) - done) >= 2 * IDS or (whole and left):
            block = ids[done : done + (IDS if left >= 2 * IDS else left)]
            last = self.first + len(block)
            a = np.searchsorted(docs[:, 2] + docs[:, 3], self.first, side="right")
            b = np.searchsorted(docs[:, 2], last, side="left")
            inside = docs[a:b].copy()
            inside[:, 2] = np.maximum(self.first - inside[:, 2], 0)
            data = pack_block(block, encode([block])[0], self.first, inside, missing[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.part], pa.int32()), pa.array([self.block]), pa.array([len(block)]), pa.array([data], pa.binary())],
                names=["part", "block", "n_ids", "data"],
            )
            self.first, self.block = last, self.block + 1
            done += len(block)
        self.waiting, self.size = [ids[done:].copy()], len(ids) - done
        open_docs = docs[:, 2] + docs[:, 3] > self.first
        self.docs, self.missing = [tuple(d) for d in docs[open_docs].tolist()], missing[open_docs].tolist()


def write_ids(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
    paths: tuple[str, str] | None = None,
) -> None:
    """Write the byte-level BPE ids of every text, and ``end`` after each, in ascending order of the documents' ids.

    Rows without an id come first; rows of one id follow the hash of their
    text, equal ones in any order.  NULL and empty texts are the end id alone.
    An id or a text that occurs very often is cut into several ranges.
    """
    paths = paths or byte_bpe_paths()

    def run(batches):
        text_ids, out = piece_ids(paths), _Writer(TaskContext.get().partitionId())
        for batch in batches:
            for doc, ids in zip(batch.column("_id").to_pylist(), text_ids(batch.column("_text"))):
                out.add(doc, np.append(ids, np.uint32(end)))
                if out.size >= 2 * IDS:
                    yield from out.blocks(False)
        yield from out.blocks(True)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    ranged = rows.orderBy("_id", F.xxhash64("_text"), F.monotonically_increasing_id())
    ranged.mapInArrow(run, "part int, block long, n_ids long, data binary").write.parquet(path)


def _shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 contributions moved before ``zeros`` bytes (CRC-32 is linear: parts of a text add up by exclusive or)."""
    crc = crc.astype(np.uint64)
    power = np.array([1 << (30 - i) if i < 31 else 0xEDB88320 for i in range(32)], np.uint64)  # one bit further: times x
    # power[i] is what bit 31 - i becomes; eight such steps are one byte
    for _ in range(3):
        power = _apply(power, power)
    left = zeros.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        crc[odd] = _apply(power, crc[odd])
        power, left = _apply(power, power), left >> 1
    return crc


def _apply(power: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where(values >> np.uint64(31 - i) & np.uint64(1), power[i], np.uint64(0))
    return out


def read_blocks(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document in each block, decoded and checked: doc_id, part, ordinal, at, n, total, crc, ids.

    ``at`` is the place in the part of its first id here; ``crc`` is what these
    ids add to the CRC-32 of the whole document by exclusive or.  ``ids`` may
    be left out.
    """
    schema = "doc_id long, part int, ordinal long, at long, n long, total long, crc long" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column("part"), batch.column("data")):
                yield from _read([part.as_py()], [data.as_py()], with_ids)  # one block at a time

    return blocks.select("part", "data").mapInArrow(run, schema)


def _read(part: list[int], data: list[bytes], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for j, block in enumerate(data):
        n, first, crc, docs, missing, payload = unpack_block(block)
        ids = decode([payload], [n])[0]
        raw = ids.astype("<u4").tobytes()
        if zlib.crc32(raw) != crc:
            raise DamagedBlock("decoded ids do not agree with their checksum")
        size = np.minimum(docs[:, 3] - docs[:, 2], n)
        start = np.cumsum(size) - size
        size = np.minimum(size, n - start)  # the last one may go on in the next block
        view = memoryview(raw)
        own = np.array([zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(start.tolist(), size.tolist())], np.uint64)
        after = 4 * (docs[:, 3] - docs[:, 2] - size)
        open_ = after > 0
        own[open_] = _shifted(own[open_], after[open_])
        columns = {
            "doc_id": pa.array(docs[:, 0].copy(), mask=missing.astype(bool)), "part": pa.array([part[j]] * len(docs), pa.int32()),
            "ordinal": pa.array(docs[:, 1].copy()), "at": pa.array(first + start), "n": pa.array(size),
            "total": pa.array(docs[:, 3].copy()), "crc": pa.array(own.astype(np.int64)),
        }
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(start, n), pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(columns)


def part_starts(blocks: DataFrame) -> DataFrame:
    """(part, base): ids in all parts before; one row for each part, which is one task of the writer."""
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    rows, base = [], 0
    for part, n in sizes:
        rows.append((part, base))
        base += n
    return blocks.sparkSession.createDataFrame(rows, "part int, base long")


def id_digests(blocks: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32.

    A document within one block is ready there; only those that reach over
    blocks meet in a shuffle, where the CRC-32 of their parts add up.
    """
    found = stable(read_blocks(blocks, with_ids=False))  # decoded once
    columns = ["doc_id", "part", "at", "total", "crc"]
    whole = found.where("n = total").select(*columns)
    cut = found.where("n < total").groupBy("part", "ordinal").agg(
        F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.max("total").alias("total"),
        F.bit_xor("crc").alias("crc"), F.sum("n").alias("n"))
    short = F.raise_error(F.lit("a document's ids are not complete")).cast("long")
    cut = cut.withColumn("total", F.when(F.col("n") == F.col("total"), F.col("total")).otherwise(short)).select(*columns)
    rows = whole.union(cut).join(F.broadcast(part_starts(blocks)), "part")
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("total").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def coded_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the ids of all documents to ``path`` (a new folder below the shared one if none is given) and digest the files.

    Repeated rows are documents like any others; an empty table gives no rows;
    other columns are left out, so their names cannot clash.
    """
    spark: SparkSession = docs.sparkSession
    path = path or scratch_path(spark, "ids")
    write_ids(docs, path, id_col, text_col)
    return id_digests(spark.read.schema("part int, block long, n_ids long, data binary").parquet(path))
