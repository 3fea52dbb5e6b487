"""Byte-level BPE ids of whole columns of texts, each distinct piece merged once.

The vocabulary's pattern cuts a text into pieces (a word with the space before
it, a number, a run of signs, white space) and merges within each.  For plain
Latin texts numpy finds the cuts of many texts at once; Arrow numbers their
distinct pieces, and only those are merged.  Other texts go to the encoder
whole, as do very long ones.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .packing import byte_bpe
from .words import blocks, texts

GROUP = 1 << 24
"""Bytes of text whose distinct pieces are merged together; a longer text goes to the encoder."""
PART = 1 << 20
"""Bytes of text that are cut at once."""

_ODD, _SIGN, _LETTER, _NUMBER, _WHITE = range(5)
_SPACE, _QUOTE, _LESS, _BAR = b" '<|"


def _kind(code: int) -> int:
    if chr(code) in "\t\n\r ":
        return _WHITE
    if code < 0x20 or 0x7F <= code <= 0xA0 or code >= 0x250:
        return _ODD
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(code))[0], _SIGN)


_KINDS = np.array([_kind(code) for code in range(0x280)], np.uint8)  # up to what C9 starts in UTF-8
_BYTE_KINDS = np.where(np.arange(256) < 0x80, _KINDS[:256], _ODD).astype(np.uint8)


def cuts(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where pieces start in texts that start at ``starts``, and which texts are not plain (their cuts mean nothing)."""
    n = len(raw)
    head = np.zeros(n + 3, bool)
    head[starts] = head[n:] = True
    kind = _BYTE_KINDS.take(raw)
    lead = np.flatnonzero(raw >= 0xC2)
    after = raw.take(lead + 1, mode="clip")
    two = (raw.take(lead) <= 0xC9) & (after >> 6 == 2) & ~head.take(lead + 1)
    lead, after = lead[two], after[two]
    kind[lead] = kind[lead + 1] = _KINDS.take((raw.take(lead) & 31).astype(np.int64) << 6 | after & 63)
    bar = np.flatnonzero(raw == _LESS)
    bar = bar[raw.take(bar + 1, mode="clip") == _BAR]  # may spell a special token
    odd = np.zeros(len(starts), bool)
    odd[np.searchsorted(starts, np.concatenate([np.flatnonzero(kind == _ODD), bar]), side="right") - 1] = True

    edge, white = head[:n].copy(), kind == _WHITE
    edge[1:] |= (kind[1:] != kind[:-1]) & (raw[:-1] != _SPACE)
    edge[:-1] |= white[:-1] & ~white[1:] & ~head[1:n]  # the last white space before a word, which takes it if it is a space
    quote = np.flatnonzero(raw == _QUOTE)
    quote = quote[edge.take(quote) & ~head.take(quote + 1)]
    a, b = raw.take(quote + 1), raw.take(quote + 2, mode="clip")
    ends = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    short = np.isin(a, np.frombuffer(b"stmd", np.uint8)) + 2 * (ends & ~head.take(quote + 2))  # letters of 's and the like
    quote, short = quote[short > 0], short[short > 0]
    edge[quote + 1] = False
    after = quote + 1 + short
    edge[after[after < n]] = True
    return np.flatnonzero(edge), odd


def _pieces(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of the plain ones of some texts, the first piece of each text and the end, and which texts are not plain."""
    place, odd = cuts(raw, at[:-1])
    first = np.searchsorted(place, at)
    offsets = np.append(place, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    if odd.any():
        plain = np.repeat(~odd, np.diff(first))
        pieces, first = pieces.filter(pa.array(plain)), np.append(0, np.cumsum(plain)).take(first)
    return pieces, first, odd


class PieceIds:
    """Ids of columns of texts by an encoder of one text; ``width`` is how many bytes each id stands for."""

    def __init__(self, encode: Callable[[str], np.ndarray], width: np.ndarray):
        self.encode, self.width = encode, width

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null is empty."""
        raw, at = texts(column)
        for a, b in blocks(at, GROUP):
            if at[b] - at[a] > GROUP:
                yield self._whole(raw[at[a] : at[b]])
            else:
                yield from self._group(raw, at[a : b + 1])

    def _whole(self, raw: np.ndarray) -> np.ndarray:
        return self.encode(raw.tobytes().decode())

    def _group(self, raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        parts = [_pieces(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at, PART)]
        numbered = pa.concat_arrays([pieces for pieces, _, _ in parts]).dictionary_encode()
        ids, start, size = self._merged(*texts(numbered.dictionary))
        upto = np.cumsum([len(pieces) for pieces, _, _ in parts])
        each = np.split(numbered.indices.to_numpy(), upto[:-1])
        for which, (_, first, odd), (a, _) in zip(each, parts, blocks(at, PART)):
            count = size.take(which)
            end = np.append(0, np.cumsum(count))
            here = ids.take(np.repeat(start.take(which) - end[:-1], count) + np.arange(end[-1]))
            ends = end.take(first).tolist()
            for j, whole in enumerate(odd.tolist()):
                yield self._whole(raw[at[a + j] : at[a + j + 1]]) if whole else here[ends[j] : ends[j + 1]]

    def _merged(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece start and how many they are.

        The pieces are encoded as one text in which the pattern finds them
        again: line feeds stand before those that do not start with a space.
        White space alone would run together, so its few kinds are encoded singly.
        """
        raw, at = raw[at[0] : at[-1]], at - at[0]
        size = np.diff(at)
        white = _BYTE_KINDS.take(raw.take(at[1:] - 1)) == _WHITE
        feed = (raw.take(at[:-1]) != _SPACE) & ~white
        inside = np.repeat(~white, size)
        size[white] = 0
        upto = np.cumsum(size + feed)
        text = np.full(upto[-1] if len(upto) else 0, 10, np.uint8)  # line feeds
        text[np.repeat(upto - np.cumsum(size), size) + np.arange(size.sum())] = raw[inside]
        ids = self._whole(text)
        ends = np.append(0, np.cumsum(self.width.take(ids)))
        end = np.searchsorted(ends, upto)
        start = np.append(0, end[:-1]) + feed
        if (ends.take(end) != upto).any() or (ends.take(start) != upto - size).any():
            raise ValueError("pieces are not found again in the text of all pieces")
        count, parts, n = end - start, [ids], len(ids)
        for j in np.flatnonzero(white).tolist():
            parts.append(self._whole(raw[at[j] : at[j + 1]]))
            start[j], count[j] = n, len(parts[-1])
            n += len(parts[-1])
        return np.concatenate(parts), start, count


@cache
def piece_ids(paths: tuple[str, str]) -> PieceIds:
    """Ids of ``packing.byte_bpe`` for columns of texts.  One instance per worker."""
    with open(paths[1], "rb") as file:
        widths = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, file)}
    width = np.zeros(max(widths) + 1, np.int64)
    width[list(widths)] = list(widths.values())
    return PieceIds(byte_bpe(paths), width)
