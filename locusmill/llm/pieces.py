"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reads a text once.  At each character its state and the chain of
output links list every piece that ends there, longest first, and each relaxes
the best score of that position.  Characters that no piece covers cost more than
any piece and are written as bytes.

What a piece scores depends on the kind of model that the file holds.  A unigram
model adds the scores of pieces.  A merge model ranks merges by them: its ids of
a prefix end with one certain piece, and a further piece scores 0 where merging
it and the piece before leaves the two as they are, and minus infinity where it
does not.  At each position exactly one piece is left, so one pass finds the ids
that merging step by step gives.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import each_batch

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 400_000
"""So many text parts and their ids a worker keeps; older ones are computed again."""


codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


MERGES = 2
"""The number of merge models in a file's settings."""


def model_kind(path: str) -> int:
    """The kind of model that a file says it holds: field 3 of the settings, which are field 2 of the file."""

    def number(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    def field(data: bytes, wanted: int):
        at = 0
        while at < len(data):
            tag, at = number(data, at)
            if tag & 7 == 0:
                value, at = number(data, at)
            else:
                size, at = number(data, at) if tag & 7 == 2 else (8 if tag & 7 == 1 else 4, at)
                value, at = data[at : at + size], at + size
            if tag >> 3 == wanted:
                return value
        return None

    with open(path, "rb") as file:
        settings = field(file.read(), 2)
    kind = field(settings, 3) if settings is not None else None
    return 1 if kind is None else kind


class Automaton:
    """Goto, failure and output links over pieces with scores."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.known, self.texts = pieces, {number: text for text, (number, _) in pieces.items()}
        self.stands: dict[int, bool] = {}  # by both pieces' ids
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, float, int] | None] = [None]  # id, score, length
        for text, (number, score) in pieces.items():
            node = 0
            for ch in text:
                if ch not in self.goto[node]:
                    self.goto[node][ch] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(None)
                node = self.goto[node][ch]
            self.piece[node] = (number, score, len(text))
        self.fail = [0] * len(self.goto)
        self.output = [0] * len(self.goto)  # the longest proper suffix that is a piece; 0: none
        queue = deque(self.goto[0].values())
        while queue:
            node = queue.popleft()
            for ch, child in self.goto[node].items():
                back = self.fail[node]
                while back and ch not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = self.goto[back].get(ch, 0)
                back = self.fail[child]
                self.output[child] = back if self.piece[back] else self.output[back]
                queue.append(child)
        # per node: known moves along goto and failure links, and the pieces on its output links, longest first
        self.moves: list[dict[str, int]] = [{} for _ in self.goto]
        self.chain: list[tuple[tuple[int, int], ...]] = [()] * len(self.goto)
        by_depth = deque([0])
        while by_depth:
            node = by_depth.popleft()
            own = self.piece[node]
            self.chain[node] = (((own[0], own[2]),) if own else ()) + self.chain[self.output[node]]
            by_depth.extend(self.goto[node].values())

    def _move(self, node: int, ch: str) -> int:
        at = node
        while at and ch not in self.goto[at]:
            at = self.fail[at]
        found = self.goto[at].get(ch, 0)
        if found:  # moves to the start are not kept, so any character may come
            self.moves[node][ch] = found
        return found

    def best(self, text: str, unknown: float) -> list[tuple[int, int]]:
        """(piece id or -1, end) of the best split; ties go to the longest last piece."""
        goto, fail, output, piece = self.goto, self.fail, self.output, self.piece
        n, node = len(text), 0
        score, back = [0.0] + [-np.inf] * n, [(-1, 0)] * (n + 1)
        for end in range(1, n + 1):
            ch = text[end - 1]
            while node and ch not in goto[node]:
                node = fail[node]
            node = goto[node].get(ch, 0)
            out = node if piece[node] else output[node]
            single = False
            while out:
                number, value, length = piece[out]
                total = score[end - length] + value
                if total > score[end]:
                    score[end], back[end] = total, (number, end - length)
                single = length == 1
                out = output[out]
            if not single and score[end - 1] + unknown > score[end]:
                score[end], back[end] = score[end - 1] + unknown, (-1, end - 1)
        return _walked(back)

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces, best score first and leftmost among equals, ends in these two."""
        symbols, known = list(self.texts[left] + self.texts[right]), self.known
        while len(symbols) > 1:
            score, at = -np.inf, -1
            for i in range(len(symbols) - 1):
                found = known.get(symbols[i] + symbols[i + 1])
                if found is not None and found[1] > score:
                    score, at = found[1], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols == [self.texts[left], self.texts[right]]

    def merged(self, text: str) -> list[tuple[int, int]]:
        """(piece id or -1, end) as merging gives them; each prefix keeps the one piece that its left neighbour leaves standing."""
        moves, chain, stands = self.moves, self.chain, self.stands
        n, node = len(text), 0
        last, begin = [-1] * (n + 1), list(range(-1, n))
        for end, ch in enumerate(text, 1):
            found = moves[node].get(ch)
            node = self._move(node, ch) if found is None else found
            for number, length in chain[node]:
                left = last[end - length]
                if left >= 0:
                    pair = left << 32 | number
                    fits = stands.get(pair)
                    if fits is None:
                        if len(stands) >= MEMO:
                            stands.clear()
                        fits = stands[pair] = self._apart(left, number)
                    if not fits:
                        continue
                last[end], begin[end] = number, end - length
                break
        return _walked(list(zip(last, begin)))


def _walked(back: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(piece id, end) from the start on, given the last piece of every prefix and where it begins."""
    found, end = [], len(back) - 1
    while end:
        number, start = back[end]
        found.append((number, end))
        end = start
    return found[::-1]


class _Memo(dict):
    """Ids of text parts, as bytes."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self[part] = self.make(part)
        return out


class Encoder:
    """A piece model read from a file: text to ids and back.

    ``merges`` says whether scores rank merges; as the file says if it is left out.
    """

    def __init__(self, path: str, merges: bool | None = None):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_id = model.unk_id()
        self.special = {i for i in range(n) if special[i] and not model.is_byte(i)}
        normal = {self.pieces[i]: (i, model.get_score(i)) for i in range(n) if not special[i]}
        self.automaton = Automaton(normal)
        self.merges = model_kind(path) == MERGES if merges is None else merges
        blank = " \u2047 ".encode()
        self.raw = [
            bytes([self.byte_of[i]]) if i in self.byte_of else blank if i == self.unknown_id else b"" if i in self.special
            else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)
        ]
        self.unknown = min((s for _, s in normal.values()), default=0.0) - UNKNOWN_PENALTY
        inner = any(SPACE in p.lstrip(SPACE) for p in normal)
        breaks = not any("\n" in p for p in normal)
        # no piece goes on behind a space that follows another character, so parts that begin with spaces are split alone
        self.part = re.compile(r"[\s\S]+") if inner or not breaks else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.memo = _Memo(self._split)

    def _split(self, part: str) -> bytes:
        ids, start = [], 0
        for number, end in self.automaton.merged(part) if self.merges else self.automaton.best(part, self.unknown):
            if number >= 0:
                ids.append(number)
            elif self.bytes:
                ids += [self.bytes[b] for b in part[start:end].encode()]
            else:
                ids.append(self.unknown_id)
            start = end
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; spaces count as ``SPACE`` and one is put before it."""
        if not text:
            return np.zeros(0, "<i4")
        parts = self.part.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.memo.__getitem__, parts)), "<i4")

    def decode(self, ids) -> str:
        """The text of ids: bytes are joined (each invalid one becomes U+FFFD), control ids vanish, the space put before goes."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "each_byte")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def _id_lists(found: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """How many ids each text has, and the ids."""
    size = np.array([len(f) for f in found], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.array(size), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32, copy=False)))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_ids and ids of every row.

    NULL and empty texts have no ids; rows with a NULL id and repeated rows are
    rows like others; an empty table gives no rows.  Other columns are left out.
    """
    path = path or piece_path()

    def run(batch: pa.RecordBatch):
        model = encoder(path)
        size, ids = _id_lists([model.encode(t or "") for t in batch.column("_text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), size, ids], names=["doc_id", "n_ids", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(each_batch(run), "doc_id long, n_ids long, ids array<int>")


def decode_ids(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; NULL ids are an empty text."""
    path = path or piece_path()

    def run(batch: pa.RecordBatch):
        model = encoder(path)
        text = [model.decode(i or []) for i in batch.column("_ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col(ids_col).alias("_ids")).mapInArrow(each_batch(run), "doc_id long, text string")


def piece_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 and same_text: every text encoded, decoded from its ids again and compared.

    Both happen in one task, so ids cross to Python's side once.  A text that
    has U+2581 of its own comes back with a blank in its place, so its
    ``same_text`` is false.  Odd rows are treated as in ``encode_texts``.
    """
    path = path or piece_path()

    def run(batch: pa.RecordBatch):
        model, sha, same = encoder(path), [], []
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        found = [model.encode(t) for t in texts]
        for text, ids in zip(texts, found):
            back = model.decode(ids)
            sha.append(hashlib.sha256(back.encode()).hexdigest())
            same.append(back == text)
        size, ids = _id_lists(found)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), size, ids, pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
            names=["doc_id", "n_ids", "ids", "decoded_sha256", "same_text"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(each_batch(run), "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, same_text boolean")
