"""Line deduplication with a suffix array over line IDs, built by distributed prefix doubling.

Every line with a word has an ID; a document is its sequence of IDs.  Suffixes
are ranked by their first line, then by their first two, four, ... lines: the
next rank of a suffix orders the pair of its own rank and that of the suffix so
many lines on.  Suffixes that share their first d lines are one interval of the
suffix array with a common prefix of at least d.  Of each interval whose prefix
reaches the wanted length the first suffix in document order stays; the lines of
the others' prefixes are later copies.  A single line counts as a run of its own
where it has enough words: such intervals are those of the first round.

Only suffixes that still share their prefix are carried on, so a round handles
the repeated part of the corpus.  Ranks come from counts of distinct pairs; no
interval, however large, is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import prefix_scan
from ..plans.session import stable
from .words import each_batch

MIN_LINES = 2
MIN_WORDS = 10
"""A line of so many words is a passage: its later copies go whatever lines stand around them."""

_KEYS = ["doc_id", "fp", "i"]


def _lined(text: str | None) -> tuple[list[str], np.ndarray]:
    """All lines, and which of them have a word."""
    lines = (text or "").split("\n")
    return lines, np.array([bool(x.strip(" \t\r\x0b\x0c")) for x in lines], bool)


def line_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, i, line, n_words): the ``i``-th line with a word of each text of docs (doc_id, text, fp)."""

    def run(batch: pa.RecordBatch):
        doc, fp, at, kept = [], [], [], []
        for d, f, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "fp", "text"))):
            lines, real = _lined(text)
            own = [x for x, r in zip(lines, real.tolist()) if r]
            doc += [d] * len(own)
            fp += [f] * len(own)
            at += range(len(own))
            kept += own
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
        columns = (doc, fp, at, kept, [len(x.encode().split()) for x in kept])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["doc_id", "fp", "i", "line", "n_words"])

    return docs.mapInArrow(each_batch(run), "doc_id long, fp long, i int, line string, n_words int")


def _ranked(rows: DataFrame, first: str, second: str, depth: int, *more: str) -> DataFrame:
    """Suffixes with the rank of their class (first, second), classes of one left out.

    ``head`` is the class's first suffix in document order, ``depth`` the length of the common prefix.
    """
    counted = rows.groupBy(first, second).agg(F.count("*").alias("n"), F.min(F.struct(*_KEYS)).alias("head")).where("n > 1")
    ranks = prefix_scan(counted, [], [first, second], {"at": ("sum", F.col("n"), False)})
    found = rows.join(ranks.select(first, second, "at", "head"), [first, second])
    return stable(found.select(*_KEYS, F.coalesce("at", F.lit(0)).cast("long").alias("rank"), "head", F.lit(depth).alias("depth"), *more))


def _shifted(suffixes: DataFrame, by: int, depth: int) -> DataFrame:
    """Suffixes ranked by their own rank and that of the suffix ``by`` lines on."""
    later = suffixes.select("doc_id", "fp", (F.col("i") - by).alias("i"), F.col("rank").alias("next"))
    return _ranked(suffixes.join(later, _KEYS).select(*_KEYS, "rank", "next"), "rank", "next", depth)


def common_prefixes(docs: DataFrame, depth: int | None = None) -> list[DataFrame]:
    """Repeated suffixes by the length of their common prefix: 1, 2, 4, ... lines, up to ``depth``.

    Each table has doc_id, fp, i, rank (the place where the suffix's interval
    begins among the repeated suffixes), head and depth, the first one also the
    line's n_words.  Without ``depth`` the
    rounds go on until no two suffixes share that many lines.
    """
    line = F.col("line")
    rows = line_positions(docs.where(F.col("doc_id").isNotNull()))
    rows = rows.select(*_KEYS, F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "n_words")
    out = [stable(_ranked(rows, "h1", "h2", 1, "n_words").distinct())]
    d = 1
    while depth is None or 2 * d <= depth:
        found = _shifted(out[-1], d, 2 * d)
        if found.isEmpty():
            break
        out.append(found)
        d *= 2
    return out


def repeated_windows(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, fp, i, head): suffixes whose first ``min_lines`` lines begin an earlier suffix, ``head``, as well."""
    return _windows(common_prefixes(docs, min_lines), min_lines)


def _windows(levels: list[DataFrame], min_lines: int) -> DataFrame:
    last = levels[-1]
    d = 2 ** (len(levels) - 1)
    if 2 * d <= min_lines:  # no two suffixes share even 2 d lines
        last = last.limit(0)
    elif d < min_lines:  # two overlapping prefixes of d lines make one of min_lines
        last = _shifted(last, min_lines - d, min_lines)
    return _later(last).select(*_KEYS, "head")


def _later(suffixes: DataFrame) -> DataFrame:
    return suffixes.where(F.struct(*_KEYS) > F.col("head"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, first, last, source_id, source_first): maximal runs of lines that also stand earlier.

    Lines are numbered from 0 among those with a word, ``last`` included.  Runs
    follow one source at one distance; a run's windows are a document's own.
    """
    found = repeated_windows(_keyed(docs, id_col, text_col), min_lines)
    rows = found.select("doc_id", "fp", "i", F.col("head.doc_id").alias("source_id"), (F.col("i") - F.col("head.i")).alias("shift"))
    keys = ["doc_id", "fp", "source_id", "shift"]
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("i")).alias("all"))
    runs = lists.select(*keys, F.posexplode("all").alias("k", "i")).groupBy(*keys, (F.col("i") - F.col("k")).alias("run"))
    ends = runs.agg(F.min("i").alias("first"), (F.max("i") + min_lines - 1).alias("last"))
    return ends.select("doc_id", "fp", "first", "last", "source_id", (F.col("first") - F.col("shift")).alias("source_first"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"), *more)


def without_copies(text: str, starts: list[int], min_lines: int, single: list[int] = ()) -> tuple[str, int, int]:
    """The text without the lines of the windows that begin at ``starts``, the number of its lines with a word, and how many went.

    The lines in ``single`` go by themselves.
    A line without a word goes with the line before it.
    """
    lines, real = _lined(text)
    n = int(real.sum())
    edge = np.zeros(n + 1, np.int64)
    for s in set(starts):
        edge[s] += 1
        edge[s + min_lines] -= 1
    gone = np.cumsum(edge[:n]) > 0
    gone[list(single)] = True
    which = np.cumsum(real) - 1
    drop = (which >= 0) & gone[np.maximum(which, 0)] if n else np.zeros(len(lines), bool)
    return "\n".join(x for x, g in zip(lines, drop.tolist()) if not g), n, int(gone.sum())


def line_dedup(
    docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    min_words: int | None = None,
) -> DataFrame:
    """doc_id, n_lines, n_removed, kept, one row per input row; ``keep`` adds a struct ``row`` of those columns.

    A line goes where ``min_lines`` lines in a row, itself among them, also
    stand earlier: in a smaller id, or further up in the same text.  With
    ``min_words`` a line of at least so many words goes wherever it also stands
    earlier, alone or among other lines.  Lines
    without a word do not count and go with the line before them.  NULL and
    empty texts stay empty; rows with a NULL id are returned whole; rows that
    are equal in id and text count as one, rows with the same id and other texts
    follow the order of their text hashes.  Other columns are left out.
    """
    levels = common_prefixes(_keyed(docs, id_col, text_col), min_lines)
    found = _windows(levels, min_lines).select("doc_id", "fp", F.col("i").alias("start"), F.lit(None).cast("int").alias("line"))
    if min_words is not None:
        long = _later(levels[0].where(F.col("n_words") >= min_words))
        found = found.union(long.select("doc_id", "fp", F.lit(None).cast("int"), "i"))
    sets = [F.collect_set(c).alias(a) for c, a in (("start", "starts"), ("line", "single"))]
    starts = found.groupBy("doc_id", "fp").agg(*sets)  # a document's own
    carried, more = ([F.struct(*keep).alias("row")], ["row"]) if keep else ([], [])
    keyed = _keyed(docs, id_col, text_col, *carried)

    def run(batch: pa.RecordBatch):
        rows = []
        for text, own, single in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "single"))):
            rows.append(without_copies(text, own or [], min_lines, single or []))
        kept, n, gone = zip(*rows)
        arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
        names = ["doc_id", "n_lines", "n_removed", "kept"]
        return pa.RecordBatch.from_arrays(arrays + [batch.column(c) for c in more], names=names + more)

    marked = keyed.join(starts, ["doc_id", "fp"], "left")
    kinds = "doc_id long, n_lines long, n_removed long, kept string"
    kinds += f", row {keyed.schema['row'].dataType.simpleString()}" if keep else ""
    return marked.mapInArrow(each_batch(run), kinds)
