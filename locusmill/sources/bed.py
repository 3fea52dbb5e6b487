"""Packed two-bit call files as a Spark data source.

A file is three magic bytes, then ``ceil(n / 4)`` bytes per marker, four samples
a byte.  Byte ranges of whole markers become input partitions, and a filter on
``marker_idx`` drops ranges before anything is read.  A folder with a manifest
holds the markers in several such files (see ``packed_sink``).
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

# File signature and variant-major flag of the packed format.
MAGIC = b"\x6c\x1b\x01"
MANIFEST = "manifest.json"
MISSING = -1
BATCH_BYTES = 4 << 20


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path; a path without a scheme is a shared mount."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class MarkerRange(InputPartition):
    """Runs of markers: file, the file's first marker, first and end of the run."""

    def __init__(self, runs: list[tuple[str, int, int, int]]):
        self.runs = runs


def lookup(count_allele: int) -> np.ndarray:
    """256 x 4 table: the dosages of the four samples in a byte."""
    if count_allele not in (1, 2):
        raise ValueError("count_allele must be 1 or 2")
    dosage = np.array([0, MISSING, 1, 2] if count_allele == 2 else [2, MISSING, 1, 0], dtype=np.int8)
    shifts = np.arange(4) * 2
    return dosage[(np.arange(256)[:, None] >> shifts) & 3]


class PackedReader(DataSourceReader):
    """Reads whole-marker byte ranges; the options may bound the markers."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.n_samples = int(options["n_samples"])
        self.count_allele = int(options["count_allele"])
        self.per_partition = int(options.get("markers_per_partition", "4096"))
        self.low = int(options.get("from_marker", "0"))
        self.high = int(options["to_marker"]) if "to_marker" in options else None
        self.listed = None

    @property
    def width(self) -> int:
        return -(-self.n_samples // 4)

    def _total(self, files: pafs.FileSystem, inner: str) -> int:
        """Markers of one file."""
        with files.open_input_file(inner) as stream:
            size = stream.size()
            if stream.read_at(3, 0) != MAGIC:
                raise ValueError(f"{inner} is no variant-major packed call file")
        total, rest = divmod(size - 3, self.width)
        if rest:
            raise ValueError(f"{inner} is truncated: {rest} bytes after the last whole marker")
        return total

    def _files(self) -> tuple[list[int], list[str], int]:
        """First marker of each file, the files, and the number of markers.

        Of a folder only the manifest is read here; a task that meets a short file says so.
        """
        files, inner = locate(self.path)
        kind = files.get_file_info(inner).type
        if kind == pafs.FileType.NotFound:
            raise ValueError(f"{self.path} is no file, and no manifest was committed there")
        if kind != pafs.FileType.Directory:
            return [0], [inner], self._total(files, inner)
        if files.get_file_info(f"{inner}/{MANIFEST}").type != pafs.FileType.File:
            raise ValueError(f"{self.path} has no manifest: nothing was committed there")
        with files.open_input_file(f"{inner}/{MANIFEST}") as stream:
            manifest = json.loads(stream.read())
        for key, given in (("n_samples", self.n_samples), ("count_allele", self.count_allele)):
            if manifest[key] != given:
                raise ValueError(f"{self.path} was written with {key} {manifest[key]}, not {given}")
        parts = manifest["parts"]
        return [p["first"] for p in parts], [f"{inner}/{p['file']}" for p in parts], manifest["n_markers"]

    def partitions(self):
        firsts, names, total = self._files()
        stop = total if self.high is None else min(total, self.high)
        if self.listed is None:
            runs = [(self.low, stop)] if self.low < stop else []
        else:
            runs = [(m, m + 1) for m in sorted(self.listed) if self.low <= m < stop]
        parts, current, held = [], [], 0
        for start, end in runs:
            while start < end:
                k = bisect_right(firsts, start) - 1
                last = firsts[k + 1] if k + 1 < len(firsts) else total
                take = min(end - start, self.per_partition - held, last - start)
                current.append((names[k], firsts[k], start, start + take))
                start, held = start + take, held + take
                if held == self.per_partition:
                    parts.append(MarkerRange(current))
                    current, held = [], 0
        if current:
            parts.append(MarkerRange(current))
        return parts or [MarkerRange([])]

    def read(self, partition: MarkerRange) -> Iterator[pa.RecordBatch]:
        table = lookup(self.count_allele)
        step = max(1, BATCH_BYTES // max(self.width, 1))
        files, _ = locate(self.path)
        for name, runs in groupby(partition.runs, key=lambda run: run[0]):
            with files.open_input_file(name) as stream:
                for first, count, begin in ((m, min(step, end - m), base) for _, base, start, end in runs for m in range(start, end, step)):
                    data = stream.read_at(count * self.width, 3 + (first - begin) * self.width)
                    if len(data) != count * self.width:
                        raise ValueError(f"short read at marker {first}")
                    codes = table[np.frombuffer(data, dtype=np.uint8).reshape(count, self.width)]
                    codes = codes.reshape(count, self.width * 4)[:, : self.n_samples]
                    offsets = np.arange(count + 1, dtype=np.int32) * self.n_samples
                    values = pa.array(codes.ravel(), mask=(codes == MISSING).ravel())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(first, first + count, dtype=np.int32)),
                         pa.ListArray.from_arrays(pa.array(offsets), values)],
                        names=["marker_idx", "codes"],
                    )


class FilteringReader(PackedReader):
    """Also takes filters on the marker; Spark refuses it unless that is switched on."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("marker_idx",):
                yield f
            elif isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThanOrEqual, LessThan)):
                top = int(f.value) + 1 - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            elif isinstance(f, (EqualTo, In)):
                values = {int(f.value)} if isinstance(f, EqualTo) else {int(v) for v in f.value if v is not None}
                self.listed = values if self.listed is None else self.listed & values
            else:
                yield f


class PackedCalls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_calls"

    def schema(self) -> str:
        return "marker_idx int, codes array<tinyint>"

    def reader(self, schema) -> PackedReader:
        return (FilteringReader if self.options.get("filters") == "true" else PackedReader)(self.options)

    def writer(self, schema, overwrite: bool):
        from .packed_sink import PackedWriter

        if overwrite:
            raise ValueError("a packed store is never overwritten")
        return PackedWriter(self.options)


def scan_bed(
    spark: SparkSession, path: str, n_samples: int, count_allele: int, markers_per_partition: int = 4096,
    markers: tuple[int, int] | None = None,
) -> DataFrame:
    """(marker_idx, codes): one row per marker, NULL where a call is missing.

    ``markers`` bounds the markers read (first, end).  Where the session lets
    Python sources take filters, a filter on ``marker_idx`` does the same.

    ``path`` is a packed file, or a folder that ``sink_packed`` wrote, on a mount
    all executors share, or a URI that Arrow's file systems read.  The counted allele has no default, because both
    orientations are in use.
    """
    lookup(count_allele)
    spark.dataSource.register(PackedCalls)
    bounds = {} if markers is None else {"from_marker": markers[0], "to_marker": markers[1]}
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("packed_calls").options(
        path=path, n_samples=n_samples, count_allele=count_allele, markers_per_partition=markers_per_partition,
        filters=filters, **bounds,
    ).load()


def bed_calls(packed: DataFrame, fam: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Long (sample_id, marker_idx, dosage) for all or the wanted samples."""
    long = packed.select("marker_idx", F.posexplode("codes").alias("sample_idx", "dosage"))
    chosen = fam.select(F.col("sample_idx").cast("int").alias("sample_idx"), "sample_id")
    if wanted is not None:
        chosen = chosen.join(wanted.select("sample_id"), "sample_id", "left_semi")
    return long.join(chosen, "sample_idx").select("sample_id", "marker_idx", F.col("dosage").cast("int").alias("dosage"))
