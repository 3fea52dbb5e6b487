"""Packed two-bit call files written by Spark tasks and published as a whole.

A store is a folder of part files, each a packed file of consecutive markers,
and a manifest that lists them.  Every task streams its markers into a file of
its own and reports their range; only when all have ended does the manifest
appear under its name.  Readers go by the manifest, so a failed job, a repeated
attempt or a lost executor never shows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .bed import MAGIC, MANIFEST, MISSING, PackedCalls, locate, lookup

CHUNK = 4096
"""Samples a row carries; a multiple of four, so that chunks meet at whole bytes."""


@dataclass
class WrittenPart(WriterCommitMessage):
    """A task's file and its markers; no file where the task had none."""

    file: str | None
    first: int
    end: int


class PackedWriter(DataSourceArrowWriter):
    """Two-phase commit: tasks write files of their own, the manifest makes them a store."""

    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.n_samples, self.n_markers = int(options["n_samples"]), int(options["n_markers"])
        self.count_allele = int(options["count_allele"])
        lookup(self.count_allele)
        files, inner = locate(self.path)
        files.create_dir(inner)
        if files.get_file_info(f"{inner}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} already exists")

    @property
    def chunks(self) -> int:
        return max(1, -(-self.n_samples // CHUNK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenPart:
        files, inner = locate(self.path)
        name = f"{self.run}-{uuid.uuid4().hex}.bed"
        stream, first, place = None, 0, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                at = batch.column("marker_idx").to_numpy() * self.chunks + batch.column("chunk").to_numpy()
                if stream is None:
                    first, rest = divmod(int(at[0]), self.chunks)
                    if rest:
                        raise ValueError(f"marker {first} is cut over two tasks")
                    stream, place = files.open_output_stream(f"{inner}/{name}"), int(at[0])
                    stream.write(MAGIC)
                if not np.array_equal(at, np.arange(place, place + len(at))):
                    raise ValueError("markers and chunks are not consecutive")
                place += len(at)
                for data in self._bytes(batch):
                    stream.write(data)
        except BaseException:
            if stream is not None:
                stream.close()
                files.delete_file(f"{inner}/{name}")
            raise
        if stream is None:
            return WrittenPart(None, 0, 0)
        stream.close()
        end, rest = divmod(place, self.chunks)
        if rest:
            files.delete_file(f"{inner}/{name}")
            raise ValueError(f"marker {end} is cut over two tasks")
        return WrittenPart(name, first, end)

    def _bytes(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        """Packed bytes of each row; a sample without a call is missing."""
        dosages = lookup(self.count_allele)[:, 0][:4]
        code = np.zeros(4, np.uint8)  # by dosage + 1
        code[dosages + 1] = np.arange(4)
        for chunk, calls in zip(batch.column("chunk").to_pylist(), batch.column("calls")):
            size = min(CHUNK, self.n_samples - chunk * CHUNK)
            full = np.zeros(-(-size // 4) * 4, np.uint8)
            full[:size] = code[MISSING + 1]
            found = calls.values
            at = found.field("at").to_numpy()
            if len(np.unique(at)) != len(at):
                raise ValueError("two calls of one sample and marker")
            full[at] = code[found.field("dosage").to_numpy() + 1]
            yield (full.reshape(-1, 4) << (np.arange(4, dtype=np.uint8) * 2)).sum(1).astype(np.uint8).tobytes()

    def _own_files(self) -> list[str]:
        files, inner = locate(self.path)
        found = files.get_file_info(pafs.FileSelector(inner))
        return [f.base_name for f in found if f.base_name.startswith(self.run)]

    def commit(self, messages: list[WrittenPart | None]) -> None:
        files, inner = locate(self.path)
        parts = sorted((m.first, m.end, m.file) for m in messages if m is not None and m.file is not None)
        ends = [0, *(end for _, end, _ in parts)]
        if [first for first, _, _ in parts] != ends[:-1] or ends[-1] != self.n_markers:
            raise ValueError(f"the parts do not hold {self.n_markers} markers")
        published = {file for _, _, file in parts}
        for name in self._own_files():  # of attempts whose executor was lost
            if name not in published:
                files.delete_file(f"{inner}/{name}")
        manifest = {
            "n_samples": self.n_samples, "n_markers": self.n_markers, "count_allele": self.count_allele,
            "parts": [{"file": file, "first": first, "end": end} for first, end, file in parts],
        }
        staged = f"{inner}/{self.run}.json"
        with files.open_output_stream(staged) as stream:
            stream.write(json.dumps(manifest).encode())
        files.move(staged, f"{inner}/{MANIFEST}")

    def abort(self, messages: list[WrittenPart | None]) -> None:
        files, inner = locate(self.path)
        for name in self._own_files():
            files.delete_file(f"{inner}/{name}")


def sink_packed(
    calls: DataFrame, n_samples: int, n_markers: int, path: str, count_allele: int = 2, partitions: int | None = None
) -> None:
    """Write ``calls`` (sample_idx, marker_idx, dosage) as a packed store that ``scan_bed`` reads.

    Samples and markers are numbered from 0; pairs without a row, and NULL
    dosages, are missing.  Numbers or dosages out of range and repeated calls
    are errors, and nothing is overwritten.  A task holds chunks of 4,096
    samples, never a whole marker.
    """
    lookup(count_allele)
    spark, chunks = calls.sparkSession, max(1, -(-n_samples // CHUNK))
    sample, marker, dosage = F.col("sample_idx"), F.col("marker_idx"), F.col("dosage")
    known = sample.between(0, n_samples - 1) & marker.between(0, n_markers - 1) & F.coalesce(dosage.between(0, 2), F.lit(True))
    wrong = F.raise_error(F.concat(F.lit("call out of range: "), F.to_json(F.struct("sample_idx", "marker_idx", "dosage")))).cast("long")
    marker = F.when(F.coalesce(known, F.lit(False)), marker.cast("long")).otherwise(wrong)
    call = F.struct((sample % CHUNK).cast("int").alias("at"), F.coalesce(dosage, F.lit(MISSING)).cast("tinyint").alias("dosage"))
    rows = calls.select(marker.alias("marker_idx"), F.floor(sample / CHUNK).cast("int").alias("chunk"), call.alias("call"))
    every = spark.range(n_markers * chunks).select(
        F.floor(F.col("id") / chunks).alias("marker_idx"), (F.col("id") % chunks).cast("int").alias("chunk"),
        F.lit(None).cast(rows.schema["call"].dataType).alias("call"))
    lists = rows.union(every).groupBy("marker_idx", "chunk").agg(F.collect_list("call").alias("calls"))
    ranged = lists.repartitionByRange(partitions, "marker_idx") if partitions else lists.repartitionByRange("marker_idx")
    spark.dataSource.register(PackedCalls)
    ranged.sortWithinPartitions("marker_idx", "chunk").write.format("packed_calls").mode("append").options(
        path=path, n_samples=n_samples, n_markers=n_markers, count_allele=count_allele).save()
