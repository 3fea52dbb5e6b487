"""Exact substring deduplication by seed and extend.

Seeds: every window of ``length`` words selects the smallest hash among its
``seed_words``-word grams (winnowing), so two equal windows always select the
same anchor at the same place.  Documents are joined on anchors that more than
one of them has.  An anchor is then extended to both sides over all windows
that selected it; where two documents agree on the whole extension they agree
on all of these windows at once.  Only where extensions of one anchor differ are
its windows compared one by one, each against the first document of every other
extension.  Repeated windows that follow each other on one diagonal (same
source, same distance) are one maximal repeat.

Extensions and windows are compared by 128 bits of hashes.  Exact copies of a
document are set aside before: all their windows are repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stable
from .tables import without
from .words import blocks, each_batch, grams, mix, multipliers, signed, texts, words

LENGTH = 13
SEED_WORDS = 4


def _anchors(found, length: int, seed_words: int):
    """Word and gram hashes; of every whole window its first word and the place of its anchor."""
    h = found.hashes()
    gram = grams(h, seed_words)
    valid = np.flatnonzero(found.left() >= length)
    place, best = valid.copy(), gram[valid]
    for j in range(1, length - seed_words + 1):
        other = gram[valid + j]
        less = other < best
        best = np.where(less, other, best)
        place = np.where(less, valid + j, place)
    return h, gram, valid, place


def _ids(batch: pa.RecordBatch):
    return (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "fp"))


def _rows(parts: list[tuple], names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=names) if parts else None


def _seed_rows(length: int, seed_words: int):
    """Each document's distinct anchors."""

    def run(batch: pa.RecordBatch):
        raw, at = texts(batch.column("text"))
        doc, fp = _ids(batch)
        out = []
        for lo, hi in blocks(at):
            found = words(raw, at[lo : hi + 1])
            _, gram, _, place = _anchors(found, length, seed_words)
            place = np.unique(place)
            key, row = signed(gram[place]), found.row()[place] + lo
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            out.append((key[new], doc[row[new]], fp[row[new]]))
        return _rows(out, ["anchor", "doc_id", "fp"])

    return each_batch(run)


def _extension_rows(length: int, seed_words: int):
    """Shared anchors extended over the windows that selected them: where they begin, how many, one hash of all."""

    def run(batch: pa.RecordBatch):
        raw, at = texts(batch.column("text"))
        doc, fp = _ids(batch)
        lists = batch.column("anchors")
        shared, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        out = []
        for lo, hi in blocks(at):
            found = words(raw, at[lo : hi + 1])
            h, gram, valid, place = _anchors(found, length, seed_words)
            if not len(valid):
                continue
            begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            count = np.diff(np.append(begin, len(valid)))
            first, anchor = valid[begin], signed(gram[place[begin]])
            row = found.row()[first]
            edges, ok = np.searchsorted(row, np.arange(hi - lo + 1)), np.zeros(len(first), bool)
            for r in range(hi - lo):  # an anchor counts where its own document lists it
                mine = slice(edges[r], edges[r + 1])
                ok[mine] = np.isin(anchor[mine], shared[ends[lo + r] : ends[lo + r + 1]])
            first, count, anchor, row = first[ok], count[ok], anchor[ok], row[ok]
            window = grams(h, length, 7)
            m = multipliers(3, 77)
            whole = mix(window[first] * m[0] + window[first + count - 1] * m[1] + count.astype(np.uint64) * m[2])
            start = (first - found.first[row]).astype(np.int32)
            out.append((anchor, signed(whole), doc[lo + row], fp[lo + row], start, count.astype(np.int32)))
        return _rows(out, ["anchor", "whole", "doc_id", "fp", "start", "n"])

    return each_batch(run)


def _window_rows(length: int):
    """The windows of the listed runs (first window, how many)."""

    def run(batch: pa.RecordBatch):
        raw, at = texts(batch.column("text"))
        doc, fp = _ids(batch)
        lists = batch.column("runs")
        runs, ends = lists.flatten(), lists.offsets.to_numpy()
        start, n = (runs.field(k).to_numpy() for k in range(2))
        ends = ends - ends[0]
        out = []
        for lo, hi in blocks(at):
            found = words(raw, at[lo : hi + 1])
            mine = slice(ends[lo], ends[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
            size = n[mine].astype(np.int64)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            place = np.repeat(start[mine], size) + step
            row = np.repeat(row, size)
            h, at_word = found.hashes(), found.first[row] + place
            w1, w2 = (signed(grams(h, length, seed)[at_word]) for seed in (7, 9))
            out.append((w1, w2, doc[lo + row], fp[lo + row], place.astype(np.int32)))
        return _rows(out, ["w1", "w2", "doc_id", "fp", "start"])

    return each_batch(run)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fp): NULL text is empty; fp tells rows with the same id but other texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, source_id) of the rows whose text a smaller id has too (128 bits of hashes)."""
    keyed = docs.select("doc_id", "fp", F.xxhash64(F.lit(1), "text").alias("fp2")).where("doc_id IS NOT NULL")
    first = keyed.groupBy("fp", "fp2").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last"))
    first = first.where("source_id < last").drop("last")
    return stable(keyed.join(first, ["fp", "fp2"]).where("doc_id > source_id").select("doc_id", "fp", "source_id").distinct())


def _first(rows: DataFrame, keys: list[str], places: bool) -> DataFrame:
    """The smallest id that has the keys (and where it stands, with ``places``) and the largest.

    Written, so that a join to it can split a hot key.
    """
    where = F.min(F.struct("doc_id", "start"))["start"] if places else F.min(F.lit(None).cast("int"))
    return stable(rows.groupBy(*keys).agg(F.min("doc_id").alias("source_id"), where.alias("source_start"), F.max("doc_id").alias("last")))


def repeated_runs(docs: DataFrame, copies: DataFrame, length: int, seed_words: int, places: bool = False) -> DataFrame:
    """(doc_id, fp, start, n, source_id, source_start): ``n`` windows from ``start`` on that ``source_id`` has too.

    ``docs`` has doc_id, text, fp; ``copies`` are its exact copies, which are left
    out here.  Every window that also starts in a document with a smaller id is in
    some run, and ``source_id`` is smaller than ``doc_id``; without
    ``places``, ``source_start`` is NULL.  NULL ids take no part.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    keys = ["doc_id", "fp"]
    originals = without(known, copies, keys)
    seeds = originals.mapInArrow(_seed_rows(length, seed_words), "anchor long, doc_id long, fp long")
    shared = stable(  # written, so that a join to it can split a hot anchor
        seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo < hi").select("anchor")
    )
    lists = seeds.join(shared, "anchor").groupBy(*keys).agg(F.collect_list("anchor").alias("anchors"))  # a document's own
    kinds = "anchor long, whole long, doc_id long, fp long, start int, n int"
    extended = stable(docs.join(lists, keys).mapInArrow(_extension_rows(length, seed_words), kinds))
    heads = _first(extended, ["anchor", "whole"], places)
    found = ["doc_id", "fp", "start", "n", "source_id", "source_start"]
    agreed = extended.join(heads.where("source_id < last"), ["anchor", "whole"]).where("doc_id > source_id").select(*found)

    several = stable(heads.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"))
    firsts = heads.join(several, "anchor").select("anchor", "whole", F.col("source_id").alias("doc_id"))
    apart = extended.join(firsts, ["anchor", "whole", "doc_id"])
    runs = apart.groupBy(*keys).agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # a document's own
    windows = docs.join(runs, keys).mapInArrow(_window_rows(length), "w1 long, w2 long, doc_id long, fp long, start int")
    windows = stable(windows)
    least = _first(windows, ["w1", "w2"], places).where("source_id < last")
    single = windows.withColumn("n", F.lit(1)).join(least, ["w1", "w2"]).where("doc_id > source_id").select(*found)
    return agreed.union(single)


def _marks(docs: DataFrame, length: int, seed_words: int) -> DataFrame:
    """docs with the runs of their repeated windows (NULL: none; a run of -1 windows: an exact copy)."""
    copies = exact_copies(docs)
    runs = repeated_runs(docs, copies, length, seed_words).select("doc_id", "fp", "start", "n")
    runs = runs.union(copies.select("doc_id", "fp", F.lit(0), F.lit(-1)))
    lists = runs.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return docs.join(lists, ["doc_id", "fp"], "left")


def covered_words(n: int, runs: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which of ``n`` words the windows of ``runs`` (first window, how many; -1: all there are) cover."""
    edge = np.zeros(n + 1, np.int64)
    for start, count in runs:
        count = n - length + 1 if count < 0 else count
        if count > 0:
            edge[start] += 1
            edge[start + count - 1 + length] -= 1
    return np.cumsum(edge[:n]) > 0


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, seed_words: int = SEED_WORDS,
) -> DataFrame:
    """Remove each word that a window of ``length`` words covers which also starts in a smaller id.

    Returns doc_id, n_words, n_removed, kept (the words left, joined by one
    space), one row per input row.  Windows are judged on the input.  NULL and
    empty texts have no words; rows with a NULL id are returned whole; rows with
    the same id never remove words from each other.  Other columns are left out,
    so their names cannot clash.
    """

    def run(batch: pa.RecordBatch):
        total, removed, kept = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            tokens = text.encode().split()
            n = len(tokens)
            if runs:
                gone = covered_words(n, [(r["start"], r["n"]) for r in runs], length)
                tokens = [t for t, g in zip(tokens, gone.tolist()) if not g]
            total.append(n)
            removed.append(n - len(tokens))
            kept.append(b" ".join(tokens).decode())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    marked = _marks(fingerprinted(docs, id_col, text_col), length, seed_words)
    return marked.mapInArrow(each_batch(run), "doc_id long, n_words long, n_removed long, kept string")


def maximal_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, seed_words: int = SEED_WORDS,
) -> DataFrame:
    """(doc_id, fp, start_word, end_word, source_id, source_start): matches extended as far as they go.

    Repeated windows of one document with one source and one distance to it
    that follow each other are one repeat, at least ``length`` words long.
    Exact copies of a whole text are not listed (see ``exact_copies``).
    """
    docs = fingerprinted(docs, id_col, text_col)
    found = repeated_runs(docs, exact_copies(docs), length, seed_words, places=True)
    keys = ["doc_id", "fp", "source_id", "shift"]
    each = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.select("doc_id", "fp", "source_id", (F.col("start") - F.col("source_start")).alias("shift"), (F.col("start") + F.col("k")).alias("at"))
    lists = each.distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("at")).alias("all"))  # of one document
    runs = lists.select(*keys, F.posexplode("all").alias("i", "at")).groupBy(*keys, (F.col("at") - F.col("i")).alias("run"))
    ends = runs.agg(F.min("at").alias("start_word"), (F.max("at") + length).alias("end_word"))
    return ends.select("doc_id", "fp", "start_word", "end_word", "source_id", (F.col("start_word") - F.col("shift")).alias("source_start"))


def substring_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed, kept_sha256."""
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
