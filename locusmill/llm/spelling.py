"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Words are cut into grams of two or three letters.  The dictionary of longer
grams holds those whose first two letters are frequent, so that a frequent
pair of letters always goes with a third one.  From the places of a word's
grams and the dictionary follows which of them one edit can change; the
largest such number is the word's bound.  Two words one edit apart share at
least one of the rarest ``bound + 1`` grams of each, with everything before it
or everything after it unchanged, so lists of postings are merged on the gram,
that side of the word and the length.  Every merged pair is compared exactly.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stable
from .tables import attach
from .words import Words, blocks, texts

LEAST_LENGTH = 6
LEAST_COUNT = 5
STEP = 5
NOISE = 199
FREQUENT = 64
"""Words that must hold a pair of letters before it is extended by a third; decides speed, never results."""

_BLOCK = 8 << 20
_SHORT = 64


def _crc_table() -> np.ndarray:
    """What one byte does to a CRC-32 register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def letter_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z made small, and their code points."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw, offsets = raw[lo:hi], offsets - lo
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)
    lead = raw == 0xC3  # in UTF-8 the first byte of exactly U+00C0 to U+00FF
    inside = ((raw >= 97) & (raw <= 122)) | lead
    inside[1:] |= lead[:-1]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < hi - lo)]
    starts = inside & ~before
    starts[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return Words(raw, start, end, np.searchsorted(start, offsets)), end - start - (leads[end] - leads[start])


def run_crc(runs: Words, state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of what led to ``state`` (one register a run) followed by each run."""
    size = runs.end - runs.start
    order = np.argsort(-size, kind="stable")
    at, state = runs.start[order], state[order].astype(np.uint32)
    size = size[order]
    long = int(np.searchsorted(-size, -_SHORT))  # runs longer than _SHORT bytes, one by one
    for j in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -j))
        old = state[long:n]
        state[long:n] = table[(old ^ runs.raw[at[long:n] + j]) & 0xFF] ^ (old >> np.uint32(8))
    for k in range(long):
        word = runs.raw[at[k] : at[k] + size[k]].tobytes()
        state[k] = zlib.crc32(word, int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _strings(runs: Words, chosen: np.ndarray) -> pa.Array:
    start, size = runs.start[chosen], (runs.end - runs.start)[chosen]
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(start, size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(runs.raw[place]))
    return column.cast(pa.string())


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """(word, n): words of at least six code points and how often they occur over all texts.

    Where ``noise`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses one
    code point first: a fixed sprinkle of misspellings.  A NULL id is the empty
    string there; NULL and empty texts have no runs.
    """

    def run(batches):
        table = _crc_table()
        for batch in batches:
            raw, at = texts(batch.column("_text"))
            ids = batch.column("_id").to_pylist()
            first = np.array([zlib.crc32(f"{d or ''}:".encode()) ^ 0xFFFFFFFF for d in ids], np.uint32)
            for a, b in blocks(at, _BLOCK):
                runs, length = letter_runs(raw, at[a : b + 1])
                row = runs.row()
                long = length >= LEAST_LENGTH
                runs, length, row = Words(runs.raw, runs.start[long], runs.end[long], runs.first), length[long], row[long]
                if not len(row):
                    continue
                crc = run_crc(runs, first[a:b][row], table)
                hit = crc % noise == 0
                plain = np.flatnonzero(~hit)
                h = Words(runs.raw, runs.start[plain], runs.end[plain], runs.first).hashes()
                _, one, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_strings(runs, plain[one]), pa.array(n, pa.int64())], names=["word", "n"])
                spoilt = Counter()
                for k in np.flatnonzero(hit & (length > LEAST_LENGTH)).tolist():
                    word = runs.raw[runs.start[k] : runs.end[k]].tobytes().decode()
                    cut = int(crc[k]) % len(word)
                    spoilt[word[:cut] + word[cut + 1 :]] += 1
                if spoilt:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(spoilt), pa.string()), pa.array(list(spoilt.values()), pa.int64())], names=["word", "n"]
                    )

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each gram of two or three letters occurs in the distinct words.

    90 letters occur in runs, so there are at most 90 + 90 squared times 90
    grams, whatever the corpus; some thousands are usual.
    """

    def run(batches):
        seen = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                seen.update(word[p : p + q] for q in (2, 3) for p in range(len(word) - q + 1))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in found.collect()}


class Grams:
    """The dictionary: which grams of three letters are used, and how rare each gram is."""

    def __init__(self, counts: dict[str, int], frequent: int = FREQUENT):
        self.counts = counts
        self.longer = {g for g in counts if len(g) == 3 and counts.get(g[:2], 0) > frequent}
        self.heads = {g[:2] for g in self.longer}
        self.tails = {g[1:] for g in self.longer}

    def cut(self, word: str) -> list[tuple[int, int]]:
        """(place, length) of the word's grams: the longest at each place, none inside an earlier one."""
        out, end = [], 0
        for p in range(len(word) - 1):
            size = 3 if word[p : p + 3] in self.longer else 2
            if p + size > end:
                out.append((p, size))
                end = p + size
        return out

    def bound(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can change.

        An edit changes the grams over its place.  A pair of letters may also
        grow when the letter after it changes (only if it begins a longer
        gram), or vanish inside a longer gram when the one before it does (only
        if it ends one).  An inserted letter changes no more grams than another
        letter at its place would.
        """
        change = [0] * (len(word) + 3)
        for p, size in grams:
            pair = word[p : p + 2] if size == 2 else None
            change[p + 1 - (pair in self.tails)] += 1
            change[p + size + 1 + (pair in self.heads)] -= 1
        most = now = 0
        for c in change:
            now += c
            most = max(most, now)
        return most

    def rarest(self, word: str) -> list[tuple[int, int]]:
        """Grams of which one at least stays as it is in every word one edit away, rarest first."""
        grams = self.cut(word)
        n = self.bound(word, grams) + 1
        if n > len(grams):
            raise ValueError(f"words of at least {LEAST_LENGTH} code points are expected, not {word!r}")
        counts = self.counts
        grams.sort(key=lambda g: (counts.get(word[g[0] : g[0] + g[1]], 0), word[g[0] : g[0] + g[1]], g[0]))
        return grams[:n]


def postings(words: DataFrame, grams: Grams) -> DataFrame:
    """(key, size, word): for each of a word's rarest grams the word up to its end, and the word from its start on, as hashes."""

    def run(batches):
        import xxhash

        for batch in batches:
            keys, size, out = [], [], []
            for word in batch.column(0).to_pylist():
                for p, n in grams.rarest(word):
                    keys.append(xxhash.xxh64_intdigest(word[: p + n].encode(), n))
                    keys.append(xxhash.xxh64_intdigest(word[p:].encode(), 16 + n))
                    size += [len(word)] * 2
                    out += [word] * 2
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(out, pa.string())],
                    names=["key", "size", "word"],
                )

    return words.select("word").mapInArrow(run, "key long, size int, word string")


def near_words(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(a, b): all pairs of different words one inserted, deleted or replaced code point apart, each pair once."""
    index = stable(postings(words, Grams(gram_counts(words), frequent)))
    longer = index.select("key", F.explode(F.array("size", F.col("size") - 1)).alias("size"), F.col("word").alias("b"),
                          F.col("size").alias("own"))
    pairs = index.withColumnRenamed("word", "a").join(longer, ["key", "size"])
    pairs = pairs.where("own > size OR a < b").where(F.levenshtein("a", "b", 1) == 1)
    return pairs.select("a", "b").distinct()


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, step: int = STEP
) -> DataFrame:
    """Every word of at least six code points and ``least`` occurrences with its more frequent spelling.

    word, form (its near word of largest n, the smallest in code-point order
    among equals, if that n is at least ``step`` times the word's; else NULL),
    root (the last word on the way from form to form), n, n_near, form_n.

    NULL and empty texts have no words; a NULL id is an empty one; repeated
    rows count each time; an empty table gives no rows.  Other columns are left
    out, so their names cannot clash.
    """
    words = stable(word_counts(docs, id_col, text_col).where(F.col("n") >= least))
    pairs = stable(near_words(words))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    with_n = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))  # most frequent, then smallest
    near = with_n.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    is_form = -F.col("best.minus") >= step * F.col("n")
    forms = stable(found.select(
        "word", "n", "n_near", F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"),
    ))
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form.  Each step multiplies n by ``step`` at least, so a few doublings suffice."""
    state = stable(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stable(attach(state, onward, ["root"], "left"))
        if joined.where("next IS NOT NULL").isEmpty():
            return joined.select("word", "root")
        state = joined.select("word", F.coalesce("next", "root").alias("root"))
