"""Adaptive context-mixing range coder for token ids, in blocks that start anew.

What mostly followed the last two ids, and what mostly followed the last one,
are the order-2 and order-1 predictions; the counts of all ids are order 0.  The
three are mixed into one distribution whose weights depend on how often
predictions of such confidence came true in this block.  An id that is new to
the block is spelled out.  A range coder with 48 bits of range writes it all.

Blocks know nothing of each other.  A block's ids are dealt to lanes of about a
thousand consecutive ones, up to 4,096 of them, which are coded in step: each
numpy operation serves one id of every lane.  All lanes of a block share one
model, so its tables stay in a core's cache and learn from all that was coded.
Encoder and decoder run the same model in whole numbers.  It learns at steps 1
to 8, after every quarter more, and every 128 steps in the end.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
"""Most lanes of a block."""
LANE = 1024
"""A block has a lane for so many ids, as far as ``BLOCK`` goes."""
VOCABULARY = 1 << 16
REFRESH = 128

_U = np.uint64
_LOW, _SIXTEEN, _VOCABULARY_BITS, _LEAST, _RANGE = _U(0xFFFFFFFF), _U(16), _U(16), _U(1 << 32), _U(1 << 48)
_WEIGHT_BITS = 12
_WEIGHTS = 1 << _WEIGHT_BITS
_FLOOR = 16
_CONFIDENCE = np.searchsorted([1, 2, 4, 8, 12, 16, 20, 24, 28, 30], np.arange(32), side="right") + 1
"""By the 32nds of a context's ids that its prediction exceeds."""
_EXPECTED = np.array([0, 1, 2, 4, 8, 14, 20, 26, 32, 40, 52, 60, 0, 0, 0, 0])
"""64ths of predictions that come true, by confidence, before any were seen."""
_ROWS = 4
"""Steps that the encoder looks up at once."""


class _Table:
    """What mostly followed each context: entry is id * 16 + confidence; 0: nothing yet."""

    def __init__(self, contexts: int):
        self.entry = np.zeros(contexts, np.int32)
        self.score, self.total = np.zeros(contexts, np.int64), np.zeros(contexts, np.int64)

    def learn(self, context: np.ndarray, ids: np.ndarray) -> None:
        key = context << np.uint32(16) | ids
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, key = np.diff(first, append=len(key)), key.take(first).astype(np.int64)
        context, ids = key >> 16, key & (VOCABULARY - 1)
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        best = np.maximum.reduceat(count << 16 | (VOCABULARY - 1 - ids), at)
        again = np.add.reduceat(count * (self.entry.take(context) >> 4 == ids), at)
        context = context.take(at)
        total = self.total.take(context) + np.diff(first.take(at), append=first[-1] + count[-1])
        score = self.score.take(context) + again
        more, known = best >> 16, self.entry.take(context) >> 4
        new = more > score
        known = np.where(new, VOCABULARY - 1 - (best & (VOCABULARY - 1)), known)
        score = np.maximum(score, more)
        self.total[context], self.score[context] = total, score
        share = (32 * score - 1) // (total + 1)
        self.entry[context] = known << 4 | _CONFIDENCE.take(share)


class _Model:
    """What a block has seen so far."""

    def __init__(self, n: int):
        self.bits = min(max(n.bit_length() + 2, 12), 18)  # order 0 has 2 to the ``bits`` units
        self.total = _U(self.bits + _WEIGHT_BITS)
        hashed = min(max(n.bit_length(), 8), 16)
        self.right = np.uint32(32 - hashed)
        self.after_one, self.after_two = _Table(VOCABULARY), _Table(1 << hashed)
        self.count = np.zeros(VOCABULARY, np.int64)
        # outcomes of each state (do they agree, confidence of order 2, of order 1): order 2, order 1, neither
        state = np.arange(512)
        two, one, agree = state >> 4 & 15, state & 15, state >> 8
        self.may = np.stack([two > 0, (one > 0) & ((agree == 0) | (two == 0))], 1)  # id 0 agrees with nothing yet
        hit = _EXPECTED[two]
        other = np.where(self.may[:, 1], _EXPECTED[one] * (64 - hit) // 64, 0)
        self.seen = np.stack([hit, other, 64 - hit - other], 1)
        self.refresh()

    def refresh(self) -> None:
        """Mixing weights, and the ends of order 0 (entry 0: a new id) from the counts."""
        share = self.seen[:, :2] * (_WEIGHTS - _FLOOR) // self.seen.sum(1)[:, None] + 1
        share = np.where(self.may, share, 0)
        self.upto_two, self.upto_one = share[:, 0].copy(), share.sum(1)
        kinds = np.flatnonzero(self.count)
        count = np.concatenate([[0], self.count[kinds]])
        count[0] = np.count_nonzero(count == 1) + 1  # as many as came once are to be expected
        whole = 1 << self.bits
        self.freq = count * (whole - len(count)) // count.sum() + 1
        self.freq[np.argmax(self.freq)] += whole - self.freq.sum()
        self.start = np.cumsum(self.freq) - self.freq
        self.at_unit = np.repeat(np.arange(len(count), dtype=np.int32), self.freq)
        self.id_of = np.concatenate([[0], kinds])
        self.entry_of = np.zeros(VOCABULARY, np.int32)
        self.entry_of[kinds] = np.arange(1, len(count))

    def hashed(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return (two * np.uint32(2654435761) + one * np.uint32(2246822519)) >> self.right

    def predict(self, two: np.ndarray, one: np.ndarray):
        """Order-2 and order-1 entry, state, and where in the weights order 2 and order 1 end."""
        e2 = self.after_two.entry.take(self.hashed(two, one).astype(np.int64), mode="clip")
        e1 = self.after_one.entry.take(one.astype(np.int64), mode="clip")
        state = ((e2 & 15) << 4 | (e1 & 15)) + (((e1 ^ e2) < 16).view(np.int8).astype(np.int32) << 8)
        state = state.astype(np.int64)
        return e2, e1, state, self.upto_two.take(state, mode="clip"), self.upto_one.take(state, mode="clip")

    def learn(self, ids: np.ndarray, outcome: np.ndarray) -> None:
        """``ids``: some steps of all lanes and the two before; ``outcome``: state * 3 + what came true, of some of them."""
        two, one, now = (ids[k : len(ids) - 2 + k].ravel() for k in range(3))
        self.after_two.learn(self.hashed(two, one), now)
        self.after_one.learn(one, now)
        self.count += np.bincount(now, minlength=VOCABULARY)
        self.seen += 4 * 16 * np.bincount(outcome.ravel(), minlength=512 * 3).reshape(512, 3)
        self.refresh()


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes of a block of ``n`` ids, steps of all of them, and how many lanes have one id more."""
    lanes = min(max(n // LANE, 1), BLOCK)
    return lanes, n // lanes, n % lanes


def _segments(steps: int):
    """Ranges of steps between which the model learns."""
    t = 0
    while t < steps:
        upto = min(t + min(max(t // 4, 1), REFRESH), steps)
        yield t, upto
        t = upto


def _watched(a: int, b: int) -> int:
    """Of the steps ``a`` to ``b`` every how many counts for the weights."""
    return 4 if b - a >= 16 else 1


def _ids(n: int) -> np.ndarray:
    """Room for a block's ids, a row a step, after two rows that stand for no id."""
    lanes, steps, more = _shape(n)
    rows = np.zeros((steps + 2 + (more > 0), lanes), np.uint32)
    rows[:2] = VOCABULARY - 1
    return rows


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes.  Ids are below 65,536."""
    return [_encode(np.asarray(block)) for block in blocks]


def _encode(block: np.ndarray) -> bytes:
    lanes, steps, more = _shape(len(block))
    rows, long = _ids(len(block)), more * (steps + 1)
    rows[2:, :more] = block[:long].reshape(more, steps + 1).T if more else 0
    rows[2 : steps + 2, more:] = block[long:].reshape(lanes - more, steps).T
    model = _Model(len(block))
    low, span = np.zeros(lanes, _U), np.full(lanes, _RANGE)
    words, whose, lane = [], [], np.arange(lanes, dtype=np.uint16)

    def shift():
        """Hand on upper words while the range is short; a carry stays in the word for the end."""
        short = span < _LEAST  # about half of all: no work by index here
        if len(who := np.flatnonzero(short)):
            one = short.view(np.int8).astype(_U)
            upper, by = low >> _U(32), one << _U(4)
            words.append(upper.take(who).astype(np.uint32))
            whose.append(lane.take(who))
            np.subtract(low, upper * one << _U(32), out=low)
            np.left_shift(low, by, out=low)
            np.left_shift(span, by, out=span)
            while len(who := who[span.take(who) < _LEAST]):
                old = low[who]
                words.append((old >> _U(32)).astype(np.uint32))
                whose.append(lane.take(who))
                low[who] = (old & _LOW) << _SIXTEEN
                span[who] <<= _SIXTEEN

    def code(a: int, b: int, m: int) -> np.ndarray:
        """Steps ``a`` to ``b`` of the first ``m`` lanes; their outcomes."""
        two, one, s = (rows[a + k : b + k, :m] for k in range(3))
        e2, e1, state, upto_two, upto_one = model.predict(two, one)
        is_two = (e2 >> 4 == s) & (e2 > 0)
        is_one = (e1 >> 4 == s) & (e1 > 0) & ~is_two
        by_two, by_one = is_two.view(np.int8).astype(np.int64), is_one.view(np.int8).astype(np.int64)
        entry = model.entry_of.take(s.astype(np.int64), mode="clip").astype(np.int64)
        rest = (_WEIGHTS - upto_one) * (1 - by_two - by_one)
        start = ((upto_one * (1 - by_two - by_one) + upto_two * by_one) << model.bits) + model.start.take(entry, mode="clip") * rest
        freq = ((upto_two * by_two + (upto_one - upto_two) * by_one) << model.bits) + model.freq.take(entry, mode="clip") * rest
        start, freq, new = start.view(_U), freq.view(_U), (entry == 0) & (rest > 0)
        for t in range(b - a):
            step = span[:m] >> model.total
            low[:m] += step * start[t]
            np.multiply(step, freq[t], out=span[:m])
            shift()
            fresh = np.flatnonzero(new[t])
            if len(fresh):
                span[fresh] >>= _VOCABULARY_BITS
                low[fresh] += span[fresh] * s[t].take(fresh)
                shift()
        return state * 3 + 2 - 2 * by_two - by_one

    for a, b in _segments(steps):
        outcome = [code(c, min(c + _ROWS, b), lanes) for c in range(a, b, _ROWS)]
        if b < steps or more:
            model.learn(rows[a : b + 2], np.concatenate(outcome)[:: _watched(a, b)])
    if more:
        code(steps, steps + 1, more)
    for up in (32, 16, 0):
        words.append(((low >> _U(up)) & (_LOW if up == 32 else _U(0xFFFF))).astype(np.uint32))
        whose.append(lane)
    whose = np.concatenate(whose)
    size = np.bincount(whose, minlength=lanes)
    words = np.concatenate(words)[np.argsort(whose, kind="stable")]
    while (words > 0xFFFF).any():
        carry = words >> 16
        words &= 0xFFFF
        words[:-1] += carry[1:]
    end = np.cumsum(size).tolist()
    parts = [words[b - k : b].astype("<u2").tobytes().rstrip(b"\0") for k, b in zip(size.tolist(), end)]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def decode(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks that ``encode`` wrote, given how many each has."""
    return [_decode(d, n) for d, n in zip(data, sizes)]


def _decode(data: bytes, n: int) -> np.ndarray:
    lanes, steps, more = _shape(n)
    size = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    wide = (int(size.max()) + 1) // 2 + 3 * 2 + 2
    padded = np.zeros((lanes, 2 * wide), np.uint8)
    raw = np.frombuffer(data, np.uint8, offset=4 * lanes)
    if len(raw) != size.sum():
        raise ValueError("a block's lanes are not as long as it says")
    end = np.cumsum(size)
    for lane, (a, b) in enumerate(zip((end - size).tolist(), end.tolist())):
        padded[lane, : b - a] = raw[a:b]
    words = padded.view("<u2")
    code = words[:, 0].astype(_U) << _U(32) | words[:, 1].astype(_U) << _SIXTEEN | words[:, 2]
    words, at = words.ravel(), np.arange(lanes) * wide + 3
    last = np.arange(1, lanes + 1) * wide - 1
    span = np.full(lanes, _RANGE)
    model, rows = _Model(n), _ids(n)
    top = (1 << int(model.total)) - 1

    def shift():
        short = span < _LEAST
        who = np.flatnonzero(short)
        if len(who):
            one = short.view(np.int8).astype(_U)
            by = one << _U(4)
            np.left_shift(code, by, out=code)
            np.bitwise_or(code, words.take(np.minimum(at, last), mode="clip") * one, out=code)
            np.left_shift(span, by, out=span)
            np.add(at, one.view(np.int64), out=at)
            while len(who := who[span.take(who) < _LEAST]):
                place = at[who]
                code[who] = code[who] << _SIXTEEN | words.take(np.minimum(place, last[who]))
                at[who] = place + 1
                span[who] <<= _SIXTEEN

    ends = np.zeros((4, lanes), np.int64)  # of order 2, order 1 and order 0 in the weights
    ends[3] = _WEIGHTS
    guess, lane = np.zeros((3, lanes), np.int32), np.arange(lanes)

    def read(t: int, two: np.ndarray, one: np.ndarray, outcome: list | None) -> np.ndarray:
        """The ids of step ``t``, given the two before."""
        m = len(one)
        e2, e1, state, upto_two, upto_one = model.predict(two, one)
        ends[1, :m], ends[2, :m], guess[0, :m], guess[1, :m] = upto_two, upto_one, e2, e1
        step = span[:m] >> model.total
        # exact: whole numbers below 2 to the 48 and a quotient below 2 to the 31
        v = np.minimum((code[:m].view(np.int64).astype(float) / step.view(np.int64).astype(float)).astype(np.int64), top)
        unit = v >> model.bits
        guessed = unit < upto_one
        kind = (2 - (unit < upto_two).view(np.int8) - guessed.view(np.int8)).astype(np.int64)
        which = kind * lanes + lane[:m]
        s = (guess.take(which, mode="clip") >> 4).view(np.uint32)
        from_ = ends.take(which, mode="clip")
        start, freq = from_ << model.bits, (ends.take(which + lanes, mode="clip") - from_) << model.bits
        rare = np.flatnonzero(~guessed)
        rest, from0 = freq.take(rare) >> model.bits, start.take(rare)
        entry = model.at_unit.take(((v.take(rare) - from0).astype(float) / rest.astype(float)).astype(np.int64), mode="clip").astype(np.int64)
        start[rare] = from0 + model.start.take(entry, mode="clip") * rest
        freq[rare] = model.freq.take(entry, mode="clip") * rest
        s[rare] = model.id_of.take(entry, mode="clip")
        if outcome is not None:
            outcome.append(state * 3 + kind)
        code[:m] -= step * start.view(_U)
        np.multiply(step, freq.view(_U), out=span[:m])
        shift()
        fresh = rare[entry == 0]
        if len(fresh):
            span[fresh] >>= _VOCABULARY_BITS
            spelled = np.minimum(code[fresh] // span[fresh], _U(VOCABULARY - 1))
            code[fresh] -= span[fresh] * spelled
            s[fresh] = spelled
            shift()
        rows[t + 2, :m] = s
        return s

    two, one = rows[0], rows[1]
    for a, b in _segments(steps):
        outcome: list[np.ndarray] = []
        for t in range(a, b):
            two, one = one, read(t, two, one, None if (t - a) % _watched(a, b) else outcome)
        if b < steps or more:
            model.learn(rows[a : b + 2], np.concatenate(outcome))
    if more:
        read(steps, two[:more], one[:more], None)
    long = rows[2:, :more].T.ravel()
    return np.concatenate([long, rows[2 : steps + 2, more:].T.ravel()]).astype(np.uint16)
