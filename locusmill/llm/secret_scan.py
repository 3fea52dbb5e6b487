"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are tagged begin, inside or outside of a secret from their shape, the
words beside them and features of the whole text; the best tag sequence is
decoded by Viterbi.  The field is trained here, on windows of a bounded sample
of documents labelled by the patterns, and on generated lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks, each_batch, multipliers, texts

SAMPLE_DOCUMENTS = 4000
"""At most so many documents, those with the smallest id hashes, give training windows."""

SAMPLE_WINDOWS = 3000
KINDS = ("assign", "access", "hex", "crf")
MIN_CHARS = 8
MARK = "[secret]"
SCAN_BYTES = 1 << 17
"""Bytes of text that a task scans and hands on at once: features take many times as much.  A longer text is scanned alone."""

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and non-overlapping per kind."""
    low, out = text.lower(), []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# --- tokens and their features -------------------------------------------------------------------

_OTHER, _DIGIT, _UPPER, _LOWER, _JOIN, _HIGH, _SEP = range(7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = _DIGIT, _UPPER, _LOWER
_CLASS[list(b"_+/-")] = _JOIN
_CLASS[128:] = _HIGH
_CLASS[list(b"=:\"'")] = _SEP
_HEXADECIMAL = np.zeros(256, np.int64)
_HEXADECIMAL[list(b"0123456789abcdef")] = 1

_KEYWORDS = (
    "password passwd secret token apikey api_key key pwd auth authorization bearer credential credentials access_key "
    "secret_key private_key client_secret access_token auth_token passphrase pass"
).split()


def _word_hash(data: bytes) -> np.uint64:
    with np.errstate(over="ignore"):
        value = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * multipliers(len(data), 5)
        return value.sum(dtype=np.uint64)


_KEYS = np.sort(np.array([_word_hash(w.encode()) for w in _KEYWORDS], np.uint64))

_LENGTHS = (3, 7, 11, 15, 19, 23, 31, 39, 47)
_SHAPES = [
    "letters", "digits", "hex", "hex_both", "upper_digit", "mixed_case", "letter_digit", "all_three", "joined", "high",
    "separator", "keyword", "akia", "many_changes", "few_lower",
]
_OWN = [f"len>{n}" for n in _LENGTHS] + _SHAPES
_NEAR = ["key-1", "key-2", "key-3", "key-4", "sep-1", "sep-2", "sep+1", "long-1", "long+1"]
_FILE = ["file_digits", "file_separators", "file_short"]
_CROSS = ["bare_letters_after_key", "mixed_after_separator", "long_mixed"]
FEATURES = ["one", *_OWN, *_NEAR, *_FILE, *_CROSS]


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first token of each row, and the end
    x: np.ndarray  # features


def tokens(raw: np.ndarray, at: np.ndarray) -> Tokens:
    """Tokens of the rows between the offsets: runs of word characters, and single separators."""
    lo, hi = int(at[0]), int(at[-1])
    raw, at = raw[lo:hi], at - lo
    kind = _CLASS[raw]
    word = (kind != _OTHER) & (kind != _SEP)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at[at < len(raw)]] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero((word & (~before | edge[:-1])) | (kind == _SEP))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    end = np.flatnonzero((word & (~after | edge[1:])) | (kind == _SEP)) + 1
    first = np.searchsorted(start, at)
    n = len(start)
    if not n:
        return Tokens(start, end, first, np.zeros((0, len(FEATURES)), np.float32))
    size = end - start

    def total(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values)])
        return run[end] - run[start]

    digit, upper, lower, join, high = (total(kind == k) for k in (_DIGIT, _UPPER, _LOWER, _JOIN, _HIGH))
    sep = kind[start] == _SEP
    changes = total(np.concatenate([[False], (kind[1:] != kind[:-1])]) & ~edge[:-1])
    hexed = total(_HEXADECIMAL[raw])
    letter = upper + lower
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    byte = raw[place + np.repeat(start, size)].astype(np.uint64)
    byte += np.where((byte >= 65) & (byte <= 90), 32, 0).astype(np.uint64)
    short = np.minimum(place, 63)
    h = np.add.reduceat((byte + np.uint64(1)) * multipliers(64, 5)[short], np.cumsum(size) - size)
    near = np.minimum(np.searchsorted(_KEYS, h), len(_KEYS) - 1)
    key = (_KEYS[near] == h) & (size < 64)
    akia = np.zeros(n, bool)
    long_ = size >= 8
    akia[long_] = np.all(raw[start[long_][:, None] + np.arange(4)] == np.frombuffer(b"AKIA", np.uint8), axis=1)
    both = (digit > 0) & (letter > 0)
    own = [size > k for k in _LENGTHS] + [
        (letter + high == size) & ~sep, digit == size, hexed == size, (hexed == size) & both,
        (upper + digit == size) & both, (upper > 0) & (lower > 0) & (upper > 1), both, (upper > 0) & (lower > 0) & (digit > 0),
        (join > 0), high > 0, sep, key, akia, 4 * changes > size, (size > 7) & (3 * lower < size),
    ]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    head, tail = first[:-1][row], first[1:][row]
    spot = np.arange(n)

    def shifted(flag: np.ndarray, by: int) -> np.ndarray:
        other = spot + by
        ok = (other >= head) & (other < tail)
        return flag[np.clip(other, 0, n - 1)] & ok

    longish = both & (size > 11)
    beside = [shifted(key, -1), shifted(key, -2), shifted(key, -3), shifted(key, -4), shifted(sep, -1), shifted(sep, -2),
              shifted(sep, 1), shifted(longish, -1), shifted(longish, 1)]
    counted = np.maximum(np.diff(first), 1)
    share = lambda flag: np.bincount(row, weights=flag, minlength=len(counted)) / counted
    whole = [(share(digit > 0) > 0.1)[row], (share(sep) > 0.1)[row], (counted < 50)[row]]
    after_key = beside[0] | beside[1] | beside[2] | beside[3]
    cross = [(letter + high == size) & ~sep & after_key & ~beside[4], both & beside[4], both & (size > 19)]
    x = np.stack([np.ones(n, bool), *own, *beside, *whole, *cross], 1).astype(np.float32)
    return Tokens(start, end, first, x)


# --- the field -----------------------------------------------------------------------------------

O, B, I = range(3)  # noqa: E741
_NEVER = -1e9
_AT_ONCE = 600


@dataclass
class Field:
    """Weights of the features for each tag, and of tag pairs; inside never follows outside."""

    weights: np.ndarray
    pairs: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x.astype(float) @ self.weights

    def allowed(self) -> np.ndarray:
        out = self.pairs.copy()
        out[O, I] = _NEVER
        return out

    def margins(self) -> dict[int, float]:
        """How far a tag may fall behind "outside" before no neighbours can make up for it."""
        pairs, out = self.allowed(), {}
        renamed = min(0.0, float((pairs[B] - pairs[I]).min()))  # where inside turns into begin, its next pair changes too
        for x in (B, I):
            gains = []
            for a in (O, B, I, None):
                for b in (O, B, I, None):
                    if x == I and a in (O, None):
                        continue
                    before = 0.0 if a is None else pairs[a, O] - pairs[a, x]
                    after = 0.0 if b is None else pairs[O, B if b == I else b] - pairs[x, b]
                    after += renamed if b == I else 0.0
                    gains.append(before + after)
            out[x] = min(gains)
        return out

    def decode(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of each row (Viterbi); ``first`` has the first token of each row, and the end.

        A token whose scores speak so clearly against a secret that no
        neighbours could outweigh them is outside in every best sequence; the
        runs of other tokens between are decoded one by one, which gives the
        same tags as decoding whole rows at once.
        """
        n, pairs, margin = len(score), self.allowed(), self.margins()
        tags = np.zeros(n, np.int64)
        if not n:
            return tags
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        follow = np.append(np.maximum(score[1:, I] - score[1:, B], 0), 0.0)
        sure = (score[:, B] - score[:, O] < margin[B] - follow) & (score[:, I] - score[:, O] < margin[I] - follow)
        open_ = np.flatnonzero(~sure)
        if len(open_):
            cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(row[open_]) > 0)) + 1
            for run in np.split(open_, cuts):
                lo, hi = int(run[0]), int(run[-1]) + 1
                tags[lo:hi] = self._viterbi(score[lo:hi], pairs, lo > first[row[lo]], hi < first[row[lo] + 1])
        return tags

    @staticmethod
    def _viterbi(score: np.ndarray, pairs: np.ndarray, before: bool, after: bool) -> np.ndarray:
        best = score[0] + (pairs[O] if before else np.array([0.0, 0.0, _NEVER]))
        back = np.zeros((len(score), 3), np.int64)
        for t in range(1, len(score)):
            each = best[:, None] + pairs
            back[t] = each.argmax(0)
            best = each.max(0) + score[t]
        if after:
            best = best + pairs[:, O]
        tags = np.zeros(len(score), np.int64)
        tags[-1] = best.argmax()
        for t in range(len(score) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


def fit_field(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum penalised likelihood by gradient steps (Adam); each window has features and tags.

    Features are small whole numbers and stay bytes; a few hundred windows at a
    time are turned into floating point, so that memory does not grow with steps.
    """
    k, longest, count = len(FEATURES), max(len(t) for _, t in windows), len(windows)
    x = np.zeros((count, longest, k), np.uint8)
    y, mask = np.zeros((count, longest), np.int8), np.zeros((count, longest), bool)
    for i, (f, t) in enumerate(windows):
        x[i, : len(t)], y[i, : len(t)], mask[i, : len(t)] = f, t, True
    parts = [slice(a, a + _AT_ONCE) for a in range(0, count, _AT_ONCE)]
    want, want_pairs = np.zeros((k, 3)), np.zeros((3, 3))
    for p in parts:
        hot = np.eye(3, dtype=np.float32)[y[p]] * mask[p][..., None]
        want += x[p].reshape(-1, k).astype(np.float32).T @ hot.reshape(-1, 3)
        want_pairs += np.einsum("nta,ntb->ab", hot[:, :-1] * mask[p][:, 1:, None], hot[:, 1:])
    field = Field(np.zeros((k, 3)), np.zeros((3, 3)))
    params = [field.weights, field.pairs]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        expected = [np.zeros((k, 3)), np.zeros((3, 3))]
        for p in parts:
            for total, more in zip(expected, _expected(field, x[p], mask[p])):
                total += more
        grads = [(want - expected[0]) / count - penalty * field.weights, (want_pairs - expected[1]) / count - penalty * field.pairs]
        grads[1][O, I] = 0.0
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return field


def _expected(field: Field, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected features of each tag, and expected tag pairs, of some windows (forward-backward)."""
    count, longest, k = x.shape
    flat, both = x.reshape(-1, k).astype(np.float32), mask[:, 1:]
    score = (flat @ field.weights.astype(np.float32)).reshape(count, longest, 3).astype(float)
    score[:, 0, I] += _NEVER
    pairs = field.allowed()
    trans = np.exp(pairs - pairs.max())
    emit = np.exp(score - score.max(2, keepdims=True))
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    forward[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        now = (forward[:, t - 1] @ trans) * emit[:, t]
        now /= now.sum(1, keepdims=True)
        forward[:, t] = np.where(mask[:, t, None], now, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        now = (backward[:, t + 1] * emit[:, t + 1]) @ trans.T
        now /= now.sum(1, keepdims=True)
        backward[:, t] = np.where(mask[:, t + 1, None], now, 1.0)
    node = forward * backward
    node = node / node.sum(2, keepdims=True) * mask[..., None]
    joint = forward[:, :-1, :, None] * trans * (emit[:, 1:] * backward[:, 1:])[:, :, None, :]
    joint = joint / joint.sum((2, 3), keepdims=True) * both[..., None, None]
    return flat.T @ node.reshape(-1, 3).astype(np.float32), joint.sum((0, 1))


# --- training data -------------------------------------------------------------------------------

_WINDOW = 48


def _points(text: str) -> np.ndarray:
    """Code point number of each byte of the text, and of its end."""
    data = np.frombuffer(text.encode(), np.uint8)
    return np.concatenate([np.cumsum((data & 0xC0) != 0x80) - 1, [len(text)]]) if len(data) else np.zeros(1, np.int64)


def _value(text: str, span: tuple[int, int, str]) -> tuple[int, int]:
    """The secret itself within a pattern's match."""
    if span[2] == "assign":
        m = _ASSIGN.match(text, span[0])
        return m.start(2), m.end(2)
    return span[:2]


def _tagged(text: str, spans: list[tuple[int, int]]) -> tuple[Tokens, np.ndarray]:
    raw, at = texts(pa.array([text]))
    found = tokens(raw, at)
    tags = np.zeros(len(found.start), np.int64)
    if spans and len(found.start):
        point = _points(text)
        start, end = point[found.start], point[found.end]
        for a, b in spans:
            inside = np.flatnonzero((start >= a) & (end <= b))
            if len(inside):
                tags[inside] = I
                tags[inside[0]] = B
    return found, tags


def labelled_windows(text: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Features, tags and text of windows around each pattern match, or of one from the middle; base patterns are the labels."""
    data = text.encode()
    found, tags = _tagged(text, [_value(text, s) for s in base_spans(text)])
    n, out = len(tags), []
    centres = np.flatnonzero(tags == B).tolist() or [n // 2]
    last = -_WINDOW
    for c in centres:
        if c - last >= _WINDOW // 2 and n:
            lo = max(0, min(c - _WINDOW // 2, n - _WINDOW))
            while lo > 0 and tags[lo] == I:
                lo -= 1
            end = min(lo + _WINDOW, n)
            part = data[found.start[lo] : found.end[end - 1]].decode(errors="ignore")
            out.append((found.x[lo:end], tags[lo:end], part))
            last = c
    return out


def generated_lines(vocabulary: list[str], count: int = 1200, seed: int = 23) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with and without invented secrets, with the places of the secrets."""
    rng = np.random.default_rng(seed)
    vocabulary = vocabulary or ["the", "of", "and", "value", "Report"]
    sets = {
        "hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "digits": "0123456789", "letters": "abcdefghijklmnopqrstuvwxyz",
    }

    def draw(kind: str, lo: int, hi: int) -> str:
        return "".join(rng.choice(list(sets[kind]), int(rng.integers(lo, hi))))

    def pick(items):
        return items[int(rng.integers(len(items)))]

    def plain(n: int) -> str:
        return " ".join(pick(vocabulary) for _ in range(n))

    out = []
    for i in range(count):
        left, right = plain(int(rng.integers(0, 14))), plain(int(rng.integers(0, 14)))
        secret, between = "", ""
        if i % 2:
            secret = pick([draw("hex", 24, 64), draw("base64", 16, 48), draw("base64", 24, 41), "AKIA" + draw("upper", 16, 17)])
            if rng.random() < 0.7:
                between = pick(_KEYWORDS) + pick([" = ", ": ", "=", ":", " = \"", ": '", "=\""])
        else:
            between = pick([
                "", draw("digits", 1, 17), f"{draw('digits', 2, 5)}-{draw('digits', 2, 3)}-{draw('digits', 2, 3)}", draw("letters", 3, 30),
                f"http://{draw('letters', 4, 9)}.example.org/{draw('letters', 3, 9)}/{draw('digits', 1, 6)}", draw("upper", 2, 7),
                f"{pick(vocabulary)} = {pick(vocabulary)}", f"the {pick(_KEYWORDS)} of {pick(vocabulary)}", f"{draw('letters', 3, 8)}_{draw('letters', 3, 8)}",
                f"{draw('letters', 4, 8)}@{draw('letters', 4, 8)}.org", draw("base64", 1, 5), f"{pick(_KEYWORDS)}: {pick(vocabulary)}", plain(3),
                f"+{draw('digits', 2, 3)} {draw('digits', 3, 4)} {draw('digits', 6, 8)}", draw("letters", 2, 6).upper() + draw("digits", 1, 5),
            ])
        head = f"{left} {between}"
        close = between[-1] if between and between[-1] in "\"'" else ""
        out.append((f"{head}{secret}{close} {right}", [(len(head), len(head) + len(secret))] if secret else []))
    return out


def train_field(docs: DataFrame, max_documents: int = SAMPLE_DOCUMENTS, max_windows: int = SAMPLE_WINDOWS) -> Field:
    """The field from at most ``max_documents`` documents (doc_id, text) and the generated lines.

    Windows with a match come first; ties go by hash.  No documents: generated
    lines alone.
    """
    chosen = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text")  # at most max_documents ids

    def run(batch: pa.RecordBatch):
        rows = []
        for text in batch.column(0).to_pylist():
            for x, tags, part in labelled_windows(text or ""):
                word = re.findall(r"[^\W\d_]+", part)[::7][:3]
                rows.append((int((tags == O).all()), x.astype(np.uint8).tobytes(), tags.astype(np.uint8).tobytes(), " ".join(word)))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["plain", "x", "tags", "word"]) if rows else None

    found = sample.mapInArrow(each_batch(run), "plain int, x binary, tags binary, word string")
    rows = found.orderBy("plain", F.xxhash64("x", "tags"), "x", "tags", "word").limit(max_windows).collect()  # bounded
    windows = [
        (np.frombuffer(r.x, np.uint8).reshape(-1, len(FEATURES)), np.frombuffer(r.tags, np.uint8))
        for r in rows
    ]
    vocabulary = sorted({w for r in rows for w in r.word.split()})
    for line, spans in generated_lines(vocabulary):
        found_, tags = _tagged(line, spans)
        if len(tags):
            windows.append((found_.x[:_WINDOW].astype(np.uint8), tags[:_WINDOW]))
    return fit_field(windows)


# --- the operator --------------------------------------------------------------------------------


def _crf_spans(begin: int, found: Tokens, tags: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """Byte spans, from the row's ``begin``, of the secrets among tokens a..b."""
    out = []
    for t in (np.flatnonzero(tags[a:b] == B) + a).tolist():
        last = t
        while last + 1 < b and tags[last + 1] == I:
            last += 1
        out.append((int(found.start[t]) - begin, int(found.end[last]) - begin))
    return out


_FOUND = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_spans": "string", "spans": "string"}


def find_secrets(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), redact: str | None = None) -> DataFrame:
    """Columns ``keep`` plus n_assign, n_access, n_hex, base_spans and spans; ``redact`` adds the text with each span replaced.

    ``docs`` has ``text``.  Spans of the field that touch a pattern's match are
    left out.  NULL and empty texts have none; repeated rows are scanned one by one.
    """
    kinds = _FOUND | ({"redacted": "string"} if redact is not None else {})
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema += [f"{n} {k}" for n, k in kinds.items()]
    return rows.mapInArrow(lambda batches: _scanned(batches, field, keep, redact), ", ".join(schema))


def _scanned(batches: Iterator[pa.RecordBatch], field: Field, keep: tuple[str, ...], redact: str | None) -> Iterator[pa.RecordBatch]:
    """Rows of ``find_secrets`` for batches of the columns ``keep`` and _text, handed on as they are found."""
    kinds = [pa.int64() if k == "long" else pa.string() for k in _FOUND.values()]
    names, kinds = ([*_FOUND, "redacted"], [*kinds, pa.string()]) if redact is not None else ([*_FOUND], kinds)
    for batch in batches:
        raw, at = texts(batch.column("_text"))
        for lo, hi in blocks(at, SCAN_BYTES):
            cut, own, rows = at[lo : hi + 1], batch.slice(lo, hi - lo), []
            found = tokens(raw, cut)
            tags = field.decode(field.scores(found.x), found.first)
            for r, text in enumerate(own.column("_text").to_pylist()):
                text = text or ""
                base, all_ = _spans(text, int(cut[r] - cut[0]), found, tags, *found.first[r : r + 2])
                kind = [s[2] for s in base]
                row = [kind.count("assign"), kind.count("access"), kind.count("hex"), written(base), written(all_)]
                if redact is not None:
                    row.append(_replaced(text, all_, redact))
                rows.append(row)
            kept = [own.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*keep, *names])


def _spans(text: str, begin: int, found: Tokens, tags: np.ndarray, a: int, b: int):
    """The patterns' spans of a text whose tokens are a..b, and all spans."""
    base, extra = base_spans(text), []
    if tags[a:b].any():
        point = _points(text)
        for s, e in _crf_spans(begin, found, tags, a, b):
            s, e = int(point[s]), int(point[e])
            if e - s >= MIN_CHARS and not any(s < y and x < e for x, y, _ in base):
                extra.append((s, e, "crf"))
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _replaced(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with every run of overlapping spans replaced once; the key word of an assignment goes with its value."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of documents (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs, train_field(docs))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )
