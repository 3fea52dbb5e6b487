"""Document quality by a learned decision list.

Statistics of every text feed threshold conditions.  Sequential covering grows
one conjunction at a time on labelled rows (information gain), prunes it on rows
held back, removes what it covers and goes on.  The list becomes one ordered
Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import blocks, each_batch, grams, texts, words

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LABELLED_ROWS = 20_000
"""At most so many labelled rows, the ones with the smallest id hashes, are fitted."""

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_letters", "n_upper", "n_digits", "n_punct", "n_ends", "n_distinct"]
FEATURES = [
    "n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share",
    "letter_share", "upper_share", "digit_share", "punct_share", "ends_per_word", "distinct_share", "words_per_line",
]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_WEIGHTS = {
    "n_symbols": _table(SYMBOLS),
    "n_letters": _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))),
    "n_upper": _table(bytes(range(65, 91))),
    "n_digits": _table(b"0123456789"),
    "n_punct": _table(b"!\"'(),-./:;?[]_`{}~@^\\+="),
    "n_ends": _table(b".!?"),
}
_LEAD = np.ones(256, np.int64)  # bytes that begin a character
_LEAD[0x80:0xC0] = 0


def _summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _repeated(found, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: words in 3-word windows found twice or more in the row, and distinct words."""
    h, row, n = found.hashes(), found.row(), len(found.start)
    marks, distinct = np.zeros(n + 1, np.int64), np.zeros(n_rows, np.int64)
    if n:
        order = np.lexsort((h, row))
        new = np.ones(n, bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=n_rows)
    valid = np.flatnonzero(found.left() >= 3)
    if len(valid):
        g, r = grams(h, 3)[valid], row[valid]
        order = np.lexsort((g, r))
        same = (g[order][1:] == g[order][:-1]) & (r[order][1:] == r[order][:-1])
        twice = np.zeros(len(valid), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = valid[twice]
        for j in range(3):
            marks[at + j] = 1
    return np.bincount(row, weights=marks[:n], minlength=n_rows).astype(np.int64), distinct


def _dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def text_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus the statistics of each text; NULL and empty texts have zeros.

    Repeated rows are kept; every row is counted by itself.
    """
    names = STATS + _MORE

    def run(batch: pa.RecordBatch):
        column = batch.column(place)
        raw, at = texts(column)
        out = {n: np.zeros(batch.num_rows, np.int64) for n in names}
        for lo, hi in blocks(at):
            cut = at[lo : hi + 1]
            found = words(raw, cut)
            part, local = found.raw, cut - cut[0]
            out["n_words"][lo:hi] = found.count
            inside = np.zeros(len(part) + 1, np.int64)
            inside[found.start] = 1
            inside[found.end] -= 1
            inside = np.cumsum(inside)[:-1]
            out["word_chars"][lo:hi] = _summed(inside * _LEAD[part], local)
            for name, weight in _WEIGHTS.items():
                out[name][lo:hi] = _summed(weight[part], local)
            out["n_repeat_words"][lo:hi], out["n_distinct"][lo:hi] = _repeated(found, hi - lo)
            out["n_lines"][lo:hi] = _summed((part == 10).astype(np.int64), local) + 1
        out["n_dup_lines"][:] = [_dup_lines(t) if t else 0 for t in column.to_pylist()]
        kept = [batch.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays(kept + [pa.array(out[n]) for n in names], names=[*keep, *names])

    place = keep.index(text_col) if text_col in keep else len(keep)
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    kinds = ", ".join(carried + [f"{n} long" for n in names])
    return rows.mapInArrow(each_batch(run), kinds)


def features() -> dict[str, Column]:
    """The conditions' inputs, as expressions over the statistics."""
    c = {n: F.col(n).cast("double") for n in STATS + _MORE}
    words_, lines, chars = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "n_lines", "word_chars"))
    return {
        "n_words": c["n_words"], "mean_word": c["word_chars"] / words_, "symbols_per_word": c["n_symbols"] / words_,
        "dup_line_share": c["n_dup_lines"] / lines, "repeat_share": c["n_repeat_words"] / words_,
        "letter_share": c["n_letters"] / chars, "upper_share": c["n_upper"] / chars,
        "digit_share": c["n_digits"] / chars, "punct_share": c["n_punct"] / chars,
        "ends_per_word": c["n_ends"] / words_, "distinct_share": c["n_distinct"] / words_,
        "words_per_line": c["n_words"] / lines,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) and what it decides."""

    conditions: tuple[tuple[str, str, float], ...]
    keep: bool
    precision: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, side, cut in self.conditions:
            value = x[:, FEATURES.index(name)]
            out &= value <= cut if side == "<=" else value > cut
        return out

    def expression(self) -> Column:
        have, out = features(), F.lit(True)
        for name, side, cut in self.conditions:
            out = out & (have[name] <= cut if side == "<=" else have[name] > cut)
        return out


def _gain(p, n, p0, n0):
    """First-order information gain of covering p bad and n good rows out of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _best(x: np.ndarray, bad: np.ndarray):
    p0, n0 = bad.sum(), (~bad).sum()
    best = (0.0, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value = x[order, f]
        edge = np.flatnonzero(value[1:] != value[:-1])
        if not len(edge):
            continue
        p = np.cumsum(bad[order])[edge]
        n = edge + 1 - p
        for side, gain in (("<=", _gain(p, n, p0, n0)), (">", _gain(p0 - p, n0 - n, p0, n0))):
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                cut = float((value[edge[k]] + value[edge[k] + 1]) / 2)
                best = (float(gain[k]), (FEATURES[f], side, cut))
    return best[1]


def learn_rules(
    x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4,
    min_precision: float = 0.9, min_cover: int = 5, seed: int = 7,
) -> list[Rule]:
    """Sequential covering of the bad rows: grow on two thirds, prune on the rest.

    A rule counts only where at least ``min_cover`` bad rows and
    ``min_precision`` of all rows it covers speak for it, so that good
    documents stay.  No labelled rows, or one class only: an empty list.
    """
    rules: list[Rule] = []
    bad = bad.astype(bool)
    held = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    alive = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, prune = alive & ~held, alive & held
        if not bad[grow].any() or bad[grow].all():
            break
        inside, conditions = grow.copy(), []
        while len(conditions) < max_conditions and not bad[inside].all():
            step = _best(x[inside], bad[inside])
            if step is None:
                break
            conditions.append(step)
            inside = grow & Rule(tuple(conditions), False, 0.0).holds(x)
        if not conditions:
            break

        def worth(k: int) -> float:
            hit = prune & Rule(tuple(conditions[:k]), False, 0.0).holds(x)
            p, n = bad[hit].sum(), (~bad[hit]).sum()
            return (p - 3.0 * n) / max(p + n, 1)

        size = max(range(1, len(conditions) + 1), key=lambda k: (round(worth(k), 9), -k))
        hit = alive & Rule(tuple(conditions[:size]), False, 0.0).holds(x)
        precision = float(bad[hit].mean()) if hit.any() else 0.0
        if bad[hit].sum() < min_cover or precision < min_precision:
            break
        rules.append(Rule(tuple(conditions[:size]), False, precision))
        alive &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that holds decides, else the row is kept."""
    out = None
    for rule in rules:
        out = F.when(rule.expression(), rule.keep) if out is None else out.when(rule.expression(), rule.keep)
    return F.lit(True) if out is None else out.otherwise(True)


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality) of ``docs`` (doc_id, text).

    The fit takes at most ``max_rows`` labels, those with the smallest id hashes
    (Spark keeps no more per task); everything else covers all documents.
    Labels without a document, NULL ids and NULL qualities are left out.
    """
    chosen = (
        labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("_good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows small rows
    stats = text_stats(marked, keep=("doc_id", "_good"))
    have = features()
    rows = stats.select("doc_id", "_good", *[have[n].alias(f"f_{n}") for n in FEATURES]).toPandas()
    rows = rows.sort_values(["doc_id", *[f"f_{n}" for n in FEATURES]], kind="stable")
    return learn_rules(rows[[f"f_{n}" for n in FEATURES]].to_numpy(float), rows["_good"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics, base_failed and kept of every row; empty and NULL texts fail the base."""
    stats = text_stats(docs, keep=keep).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = quality(docs, fit_rules(docs, labels))
    return out.select("doc_id", *STATS, "base_failed", "kept")
