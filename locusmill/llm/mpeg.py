"""MPEG audio columns: frames with checksums, tags and a variable-bitrate table, written and read back.

The reader resynchronises on frame headers, so junk before, between or after
frames costs only the frames it hits.  Durations are exact sample counts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import each_batch

# Fixed values of the MPEG audio header (kbit/s by index; samples a second by index; samples in a frame).
_RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_HERTZ = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 3: [11025, 12000, 8000]}
_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

UNIT = 192
_SMALL, _LARGE = 6, 14  # bitrate indexes of 80 and 320 kbit/s: 240 and 960 bytes at 48 kHz
_HEAD = 4 + 2 + 17  # header, checksum, side information of one channel


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The checksum of MPEG audio frames (polynomial 0x8005, start 0xFFFF)."""
    for byte in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC[(value >> 8) ^ byte]
    return value


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 3 for 2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    channels: int
    size: int
    samples: int
    side: int


_HEADERS: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The frame header in 32 bits, or None where they are not one (free format counts as none)."""
    if word >> 21 != 0x7FF:
        return None
    key = word & 0xFFFFFFC0 | (word & 0xC0)
    if key in _HEADERS:
        return _HEADERS[key]
    version = {3: 1, 2: 2, 0: 3}.get(word >> 19 & 3)
    layer, rate, hertz = 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    found = None
    if version and layer < 4 and 0 < rate < 15 and hertz < 3:
        kind = (min(version, 2), layer)
        kbps, hz, pad = _RATES[kind][rate], _HERTZ[version][hertz], word >> 9 & 1
        samples = _SAMPLES[kind]
        unit = 4 if layer == 1 else 1
        size = (samples // 8 // unit * kbps * 1000 // hz + pad) * unit
        channels = 1 if word >> 6 & 3 == 3 else 2
        side = 0 if layer < 3 else ((17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17))
        found = Header(version, layer, not word >> 16 & 1, kbps, hz, channels, size, samples, side)
    if len(_HEADERS) < 4096:
        _HEADERS[key] = found
    return found


@dataclass
class Media:
    """What a stream holds: tags, variable-bitrate table, and its audio frames."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    hertz: int = 0
    kbits: int = 0
    bad_checks: int = 0
    skipped: int = 0

    @property
    def duration_ms(self) -> int:
        """Whole milliseconds, rounded down; samples and hertz are exact."""
        return self.samples * 1000 // self.hertz if self.hertz else 0


def _synchsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _tag2(data: bytes, media: Media) -> int:
    """Read an ID3v2 tag of version 3 or 4 at the start; returns where the audio may begin."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    end, at = 10 + _synchsafe(data[6:10]) + (10 if data[5] & 16 else 0), 10
    while data[3] in (3, 4) and at + 10 <= min(end, len(data)) and data[at]:
        size = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : min(at + 10 + size, end)]
        if data[at : at + 1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            media.tags[data[at : at + 4].decode("latin-1")] = body[1:].decode(code, "replace").rstrip("\0")
        at += 10 + size
    return min(end, len(data))


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in a frame that begins at ``at``, if it is such a frame."""
    place = at + 4 + (2 if h.protected else 0) + h.side
    if data[place : place + 4] in (b"Xing", b"Info"):
        flags, out, p = int.from_bytes(data[place + 4 : place + 8]), {"kind": data[place : place + 4].decode()}, place + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & 4:
            out["toc"], p = list(data[p : p + 100]), p + 100
        return out
    place = at + 36
    if data[place : place + 4] == b"VBRI" and place + 26 <= len(data):
        return {"kind": "VBRI", "bytes": int.from_bytes(data[place + 10 : place + 14]), "frames": int.from_bytes(data[place + 14 : place + 18])}
    return None


def parse(data: bytes) -> Media:
    """Tags, table and frames of a stream; b"" has none of them.

    A header counts where the next frame (or the end of the stream) follows it.
    ``TAG`` 128 bytes before the end is a tag unless it lies inside a frame;
    other bytes are skipped and counted.  Frames whose checksum fails are
    counted in ``bad_checks`` and left out.
    """
    media = Media()
    at, end = _tag2(data, media), len(data)
    tag = end - 128 if end - 128 >= at and data[-128:-125] == b"TAG" else end
    first = True
    while at + 4 <= end and at != tag:
        h = header(int.from_bytes(data[at : at + 4]))
        fits = h is not None and at + h.size <= end
        if fits and at + h.size != tag and (at + h.size + 4 <= end or at < tag < at + h.size < end):
            fits = header(int.from_bytes(data[at + h.size : at + h.size + 4])) is not None
        if not fits:
            stop = tag if at < tag else end
            nxt = data.find(b"\xff", at + 1, stop)
            nxt = stop if nxt < 0 else nxt
            media.skipped += nxt - at
            at = nxt
            continue
        good = True
        if h.protected and h.layer == 3:
            body = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
            good = crc16(body) == int.from_bytes(data[at + 4 : at + 6])
        table = _table(data, at, h) if first and good else None
        first = False
        if table is not None:
            media.table = table
        elif good:
            media.offsets.append(at)
            media.sizes.append(h.size)
            media.samples += h.samples
            media.hertz = media.hertz or h.hertz
            media.kbits += h.kbps
        else:
            media.bad_checks += 1
        at += h.size
    if at == tag < end:
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            media.tags.setdefault(name, data[tag + a : tag + b].split(b"\0")[0].decode("latin-1").rstrip())
        at = end
    media.skipped += end - at if at < end else 0
    return media


def _frame(rate: int, body: bytes) -> bytes:
    """One checked Layer III frame of 48 kHz, one channel, silent side information; ``body`` is ancillary."""
    head = bytes([0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    h = header(int.from_bytes(head))
    return head + crc16(head[2:] + side).to_bytes(2) + side + body.ljust(h.size - _HEAD, b"\0")


_EMPTY = {rate: _frame(rate, b"")[:_HEAD] for rate in (_SMALL, _LARGE)}


def _frames(payload: bytes, rate: int, units: int) -> bytes:
    """Frames of one size, each with ``units`` units of the payload."""
    body = np.frombuffer(payload, np.uint8).reshape(-1, UNIT * units)
    size = header(int.from_bytes(_EMPTY[rate][:4])).size
    out = np.zeros((len(body), size), np.uint8)
    out[:, :_HEAD] = np.frombuffer(_EMPTY[rate], np.uint8)
    out[:, _HEAD : _HEAD + UNIT * units] = body
    return out.tobytes()


def write(payload: bytes, title: str = "") -> bytes:
    """A tagged variable-bitrate stream that carries ``payload`` (whole units) in its frames.

    Four units go into a frame of 320 kbit/s, the one to three left into frames
    of 80 kbit/s each.  The first frame holds the table of frame count, bytes
    and 100 seek points.
    """
    big = len(payload) // (4 * UNIT) * 4 * UNIT
    audio = _frames(payload[:big], _LARGE, 4) + _frames(payload[big:], _SMALL, 1)
    n_big, n_small = big // (4 * UNIT), (len(payload) - big) // UNIT
    n = n_big + n_small
    size = 240 + len(audio)
    starts = [240 + 960 * min(k, n_big) + 240 * max(k - n_big, 0) for k in (n * i // 100 for i in range(100))]
    toc = bytes(min(255, s * 256 // size) for s in starts)
    info = _frame(_SMALL, b"Xing" + struct.pack(">III", 7, n, size) + toc)
    text = b"\x03" + title.encode()
    tag = b"TIT2" + _safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _safe(len(tag)) + tag + info + audio


def _safe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def payload_of(data: bytes, media: Media) -> bytes:
    """What ``write`` put into the frames of ``media``."""
    return b"".join(
        data[at + _HEAD : at + _HEAD + (4 * UNIT if size > 240 else UNIT)] for at, size in zip(media.offsets, media.sizes)
    )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text stored as a stream, read back and described, one row per input row.

    NULL and empty texts store one unit of blanks.  ``with_media`` adds the
    stored bytes and the frame offsets.  Equal texts have equal columns.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batch: pa.RecordBatch):
        rows, stored, seek = [], [], []
        for text in batch.column("_text").to_pylist():
            body = (text or "").encode()
            padded = body.ljust(max(-(-len(body) // UNIT), 1) * UNIT, b" ")
            data = write(padded, f"{len(body)} bytes")
            media = parse(data)
            back = payload_of(data, media)
            points = zlib.crc32(np.asarray(media.offsets, "<u8").tobytes())
            feature = (
                f"frames={len(media.offsets)};samples={media.samples};hertz={media.hertz};ms={media.duration_ms};"
                f"kbps={media.kbits / max(len(media.offsets), 1):.3f};bad={media.bad_checks};skipped={media.skipped};"
                f"table={media.table['frames'] if media.table else 0};seek_crc32={points};title={media.tags.get('TIT2', '')}"
            )
            rows.append((len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data),
                         hashlib.sha256(data).hexdigest(), feature))
            if with_media:
                stored.append(data)
                seek.append(media.offsets)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        arrays = [batch.column("doc_id")] + [pa.array(v, k) for v, k in zip(zip(*rows), kinds)]
        if with_media:
            arrays += [pa.array(stored, pa.binary()), pa.array(seek, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=names + (["media", "frame_offsets"] if with_media else []))

    kinds = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
             "media_bytes long, media_sha256 string, feature string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(each_batch(run), kinds + (", media binary, frame_offsets array<long>" if with_media else ""))
