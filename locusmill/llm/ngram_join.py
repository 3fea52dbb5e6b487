"""N-gram Jaccard join with prefix filters under several token orders.

Two sets with a Jaccard similarity of at least t share a token among the first
n - ceil(t n) + 1 of each, whatever the order of tokens is.  Candidates must
share such a prefix token under every one of several orders: the first order
brings them together, the others are checked on the pair before its sets are
fetched and compared.  All orders put frequent n-grams last and break ties by
different hashes.

Documents with equal sets are one class.  Within a class of near copies not all
pairs are made: each prefix token first links its members to the member in
whose prefix the token stands foremost; only members that this leaves in another
component are then compared with the rest, in bands of similar set sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stable
from .components import components
from .tables import attach
from .words import blocks, each_part, grams, mix, signed, texts, words

N = 3
PERCENT = 90
FREQUENT = 1 << 17
"""So many of the most repeated n-grams are known to the orders; they decide speed, never results."""

SET_BYTES = 1 << 18
"""Bytes of text whose sets a task holds at once with all that it derives from them."""

_FLUSH = 1 << 21
_BANDS = 1.05
_U = np.uint64


def _sets(raw: np.ndarray, at: np.ndarray, n: int):
    """Sorted distinct n-gram hashes of each row, one after the other, with their row numbers.

    A text of fewer than ``n`` words has one entry, its whole sequence; one without words has none.
    """
    found = words(raw, at, lower=True)
    h, row, left = found.hashes(), found.row(), found.left()
    whole = np.flatnonzero(left >= n)
    keys, rows = [grams(h, n)[whole]], [row[whole]]
    for k in range(1, n):
        short = np.flatnonzero((left == k) & (found.count[row] == k))
        keys.append(grams(h, k, 1000 + k)[short])
        rows.append(row[short])
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]


def _fingerprints(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and a 128-bit fingerprint of each row's set."""
    size = np.bincount(row, minlength=rows)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = []
    for seed in (0x1234567, 0x89ABCDE):
        run = np.concatenate([np.zeros(1, _U), np.cumsum(mix(key ^ _U(seed)), dtype=_U)])
        out.append(signed(mix(run[ends[1:]] - run[ends[:-1]] + size.astype(_U))))
    return size, out[0], out[1]


def frequent_grams(docs: DataFrame, n: int = N, top: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` most repeated n-grams, as sorted hashes with their counts.

    All documents are counted; n-grams that occur once among some two million
    are left out of a partial count, as they cannot be among the most frequent.
    """

    def counted(parts):
        key = np.concatenate(parts)
        parts.clear()
        key.sort()  # in place: a task holds one copy of its hashes
        again = key[1:] == key[:-1]
        first = again.copy()
        first[1:] &= ~again[:-1]
        at = np.flatnonzero(first)
        if not len(at):
            return None
        found = key[at]
        count = np.searchsorted(key, found, side="right") - at
        return pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(count.astype(np.int64))], names=["gram", "n"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            raw, at = texts(batch.column(0))
            for lo, hi in blocks(at, SET_BYTES):
                key, _ = _sets(raw, at[lo : hi + 1], n)
                parts.append(key)
                held += len(key)
                if held >= _FLUSH:
                    out, held = counted(parts), 0
                    if out is not None:
                        yield out
        if parts and (out := counted(parts)) is not None:
            yield out

    found = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "gram").limit(top).toArrow()  # at most ``top`` rows
    gram = rows.column("gram").to_numpy().astype(np.int64).view(_U)
    order = np.argsort(gram)
    return gram[order], rows.column("n").to_numpy().astype(np.int64)[order]


def set_sizes(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, fp, n_shingles, s1, s2) of every row; fp is the hash of its text."""

    def run(batch: pa.RecordBatch):
        raw, at = texts(batch.column("text"))
        names = ["doc_id", "fp", "n_shingles", "s1", "s2"]
        for lo, hi in blocks(at, SET_BYTES):
            arrays = [pa.array(x) for x in _fingerprints(*_sets(raw, at[lo : hi + 1], n), hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in names[:2]] + arrays, names=names)

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    return hashed.mapInArrow(each_part(run), "doc_id long, fp long, n_shingles long, s1 long, s2 long")


def _prefix_rows(n: int, percent: int, known: np.ndarray, count: np.ndarray):
    """Per row: fingerprint, size, and the prefix under three orders."""

    def frequency(key):
        if not len(known):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.where(known[at] == key, count[at], 0)

    def run(batch: pa.RecordBatch):
        raw, at = texts(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi in blocks(at, SET_BYTES):
            key, row = _sets(raw, at[lo : hi + 1], n)
            size, s1, s2 = _fingerprints(key, row, hi - lo)
            often = frequency(key)
            first = np.repeat(np.cumsum(size) - size, size)
            take = np.repeat(size - -(-percent * size // 100) + 1, size)
            lists = []
            for j in range(3):
                tie = key if j == 0 else mix(key + _U(j))
                order = np.lexsort((tie, often, row))
                prefix = key[order][np.arange(len(key)) - first < take]
                lists.append(signed(prefix) if j == 0 else (mix(prefix) >> _U(32)).astype(np.uint32).view(np.int32))
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, size - -(-percent * size // 100) + 1, 0))])
            full = np.flatnonzero(size > 0)
            arrays = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)).take(pa.array(full)) for v in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo + full]), pa.array(s1[full]), pa.array(s2[full]), pa.array(size[full]), *arrays],
                names=["doc_id", "s1", "s2", "n", "p1", "p2", "p3"],
            )

    return each_part(run)


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per distinct non-empty set: cid, rep (least doc_id), s1, s2, n and the prefixes p1, p2, p3."""
    known, count = frequent_grams(docs, n)
    kinds = "doc_id long, s1 long, s2 long, n long, p1 array<long>, p2 array<int>, p3 array<int>"
    rows = docs.mapInArrow(_prefix_rows(n, percent, known, count), kinds)
    merged = rows.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in ("p1", "p2", "p3")]
    )
    return stable(merged.withColumn("cid", F.monotonically_increasing_id()))


def _long_enough(left: str, right: str, percent: int):
    """Both sets have enough tokens from their shared one on."""
    most = F.least(F.col(f"{left}.n") - F.col(f"{left}.pos"), F.col(f"{right}.n") - F.col(f"{right}.pos"))
    return 100 * most >= percent * (F.col(f"{left}.n") + F.col(f"{right}.n") - most)


def _verified(pairs: DataFrame, klass: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v: class ids) that agree under the other orders and in their whole sets."""
    ids = stable(pairs.select(F.col("u").alias("cid")).union(pairs.select(F.col("v").alias("cid"))).distinct())
    near = attach(klass.select("cid", "rep", "s1", "s2", "p2", "p3"), ids, ["cid"])
    near = stable(near)
    sides = [near.select(F.col("cid").alias(s), *[F.col(p).alias(f"{s}{p}") for p in ("p2", "p3")]) for s in ("u", "v")]
    both = pairs.join(sides[0], "u").join(sides[1], "v")
    left = stable(both.where(F.arrays_overlap("up2", "vp2") & F.arrays_overlap("up3", "vp3")).select("u", "v"))

    def run(batch: pa.RecordBatch):
        raw, at = texts(batch.column("text"))
        for lo, hi in blocks(at, SET_BYTES):
            key, row = _sets(raw, at[lo : hi + 1], n)
            size, s1, s2 = _fingerprints(key, row, hi - lo)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(key)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(s1), pa.array(s2), lists], names=["doc_id", "s1", "s2", "set"]
            )

    used = left.select(F.col("u").alias("cid")).union(left.select(F.col("v").alias("cid"))).distinct()
    wanted = stable(near.join(used, "cid").select("cid", "rep", "s1", "s2"))
    fetched = attach(docs, stable(wanted.select(F.col("rep").alias("doc_id")).distinct()), ["doc_id"])
    sets = fetched.mapInArrow(each_part(run), "doc_id long, s1 long, s2 long, set array<long>")
    sets = attach(sets.withColumnRenamed("doc_id", "rep"), wanted, ["rep", "s1", "s2"])
    sets = stable(sets.select("cid", "set"))  # rows that are equal in id and text come twice: links are made distinct
    compared = left.join(sets.select(F.col("cid").alias("u"), F.col("set").alias("a")), "u").join(
        sets.select(F.col("cid").alias("v"), F.col("set").alias("b")), "v"
    )
    common = F.size(F.array_intersect("a", "b")).cast("long")
    counted = compared.select("u", "v", common.alias("both"), (F.size("a") + F.size("b")).cast("long").alias("all"))
    linked = counted.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("u", "v")
    return stable(linked).distinct()  # written before, so that Spark may split a centre with many members


def partner_sizes(percent: int) -> tuple[str, str]:
    """Least and greatest size of a set that can link with one of ``n`` tokens whose shared token has ``pos`` before it.

    Whole numbers throughout: a partner may have exactly the least size.
    """
    return f"(n * {percent} + 99) div 100", f"((n - pos) * {100 + percent} - n * {percent}) div {percent}"


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def class_links(klass: DataFrame, docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Verified links between classes, enough to join every component, and those components."""
    spread = klass.select("cid", F.explode("p1").alias("token"))  # two longs a row: these are many
    shared = spread.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    kept = stable(spread.join(shared, "token"))
    places = klass.select("cid", "n", "p1").join(kept, "cid")
    placed = stable(places.select("token", "cid", "n", (F.array_position("p1", F.col("token")) - 1).alias("pos")))
    least = placed.groupBy("token").agg(F.min(F.struct("pos", "cid", "n")).alias("c"))
    members = stable(placed.join(least, "token"))
    row, center = members.alias("m"), F.col("c")
    most = F.least(F.col("n") - F.col("pos"), center["n"] - center["pos"])
    fits = 100 * most >= percent * (F.col("n") + center["n"] - most)
    star = stable(_pairs(row.where((F.col("cid") != center["cid"]) & fits).select(F.col("cid").alias("x"), center["cid"].alias("y"))))
    links = _verified(star, klass, docs, n, percent)
    found = components(links)

    named = found.withColumnRenamed("node", "cid")
    at = members.join(named, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    heads = found.select(F.col("node").alias("head"), F.col("component").alias("hcomp"))
    at = at.withColumn("head", center["cid"]).join(heads, "head", "left").withColumn("hcomp", F.coalesce("hcomp", "head"))
    at = stable(at.select("token", "cid", "n", "pos", "comp", (F.col("comp") != F.col("hcomp")).alias("apart")))
    band = lambda size: F.floor(F.log(size.cast("double")) / math.log(_BANDS)).cast("int")
    lower, upper = (F.expr(e) for e in partner_sizes(percent))
    probe = at.where("apart").where(upper >= lower).withColumn("band", F.explode(F.sequence(band(lower), band(upper))))
    build = at.join(at.where("apart").select("token").distinct(), "token", "left_semi").withColumn("band", band(F.col("n")))
    a, b = probe.alias("a"), build.alias("b")
    meet = a.join(
        b, (F.col("a.token") == F.col("b.token")) & (F.col("a.band") == F.col("b.band"))
        & (F.col("a.comp") != F.col("b.comp")) & _long_enough("a", "b", percent),
    )
    rest = _pairs(meet.select(F.col("a.cid").alias("x"), F.col("b.cid").alias("y")))
    rest = stable(rest.join(star, ["u", "v"], "left_anti"))
    more = _verified(rest, klass, docs, n, percent)
    if more.isEmpty():
        return links, found
    links = links.union(more)
    return links, components(links)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT,
    with_keys: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per input row.

    ``with_keys`` adds fp, xxhash64 of the text, and component, a number of the
    component that differs even where ids that occur twice make component_id equal.

    Rows link where 100 * |intersection| >= percent * |union| of their n-gram
    sets; component_id is the least doc_id that links reach.  NULL, empty and
    wordless texts have an empty set and keep their own id; a NULL id takes no
    part and has a NULL component_id.  Rows with the same id are compared like
    any others.  Other columns are left out, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    known = docs.where(F.col("doc_id").isNotNull())
    klass = classes(known, n, percent)
    _, found = class_links(klass, known, n, percent)
    labelled = klass.select("cid", "rep", "s1", "s2").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "cid"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "component").select("s1", "s2", "component_id", "component")
    rows = set_sizes(docs, n).join(named, ["s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id"))
    out = rows.select("doc_id", "fp", "n_shingles", own.otherwise(F.col("component_id")).alias("component_id"), "component")
    if with_keys:
        return out.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))
    return out.drop("fp", "component")
