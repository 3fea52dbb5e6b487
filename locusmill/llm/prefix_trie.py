"""Prefix trie of conversations, grown from vertical bitmaps.

A turn at a depth is one 128-bit key, and a prefix of turns is the exclusive or
of its keys, so that prefixes of equal sequences meet across tasks without
their texts.  Conversations are cut into shards of neighbouring ids and bands
of neighbouring depths.  Within a shard and band the index holds, for each
(depth, turn), the set of conversations as bits of one integer.  A node's
children are found depth first: its set intersected with the postings of the
next turns of its members.  Bit counts give members, bits of conversations
that end at a depth give the end lists.  Nodes of all shards are merged by key.

Sums over subtrees need no level-by-level walk.  A node belongs to its smallest
member; a member's nodes are one run of depths, a chain.  Chains form a tree
whose sums are found by doubling, and sums along a chain are a scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import prefix_scan
from ..plans.session import stable
from .tables import attach

FAMILY = 100
"""A conversation starts like the one whose id is the next lower multiple of this."""
SHARED = 6
"""It takes over fewer turns than this."""

SHARD_BITS = 9
BAND_BITS = 8
_SHARD = 1 << SHARD_BITS
_NODE = ["k1", "k2", "depth"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, NULL first), two hashes of role and text, code points of the text.

    Rows of one conversation with the same turn number are ordered by those
    hashes.  Rows without a conv_id belong to no conversation and are left out.
    A conversation of any length is numbered in slices, not in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.length(text).cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), "h1", "h2"]
    return prefix_scan(rows, ["conv_id"], order, {"pos": ("count", F.lit(1), True)})


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Written table of conv_id, depth, k1, k2, size: every rebuilt conversation's turns, and a row of depth 0 for each.

    Conversation c takes the first h turns of conversation ``c - c % FAMILY``
    (all if it has fewer, none if there is no such conversation), where h is
    the CRC-32 of c's decimal digits modulo ``SHARED``; then come its own turns
    after its first h.  The remainder has the sign of c, as in SQL.
    """
    turns = stable(numbered_turns(conversations))
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED))
    first = stable(first.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "size"))).alias("head")))  # fewer than SHARED turns
    rows = attach(turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY), first, ["base"], "left")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    none = F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,size:bigint>>")
    rows = rows.withColumn("h", taken.cast("int")).withColumn("head", F.slice(F.coalesce("head", none), 1, F.col("h")))
    depth = (F.col("pos") - F.col("h") + F.size("head")).cast("long")
    root = F.array(F.struct(F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "size")]))
    own = F.when(F.col("pos") > F.col("h"), F.array(F.struct(depth.alias("pos"), "h1", "h2", "size"))).otherwise(none)
    every = F.concat(F.when(F.col("pos") == 1, F.concat(root, "head")).otherwise(none), own)
    out = rows.select("conv_id", F.explode(every).alias("t"))
    at_root = F.col("t.pos") == 0
    keys = [F.when(at_root, 0).otherwise(F.xxhash64(F.lit(i), "t.pos", "t.h1", "t.h2")).alias(f"k{i}") for i in (1, 2)]
    return stable(out.select("conv_id", F.col("t.pos").alias("depth"), *keys, F.col("t.size").alias("size")))


def _heads(rows: DataFrame) -> DataFrame:
    """One row for each conversation and band: the key of all turns before the band, and the last depth where it ends there."""
    bands = rows.groupBy("conv_id", F.shiftright("depth", BAND_BITS).alias("band")).agg(
        F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.max("depth").alias("deepest"))
    order = Window.partitionBy("conv_id").orderBy("band")  # one row for every 256 turns
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return bands.select(
        "conv_id", "band", F.lit(-1).cast("long").alias("depth"),
        *[F.coalesce(F.bit_xor(k).over(before), F.lit(0)).alias(k) for k in ("k1", "k2")],
        F.when(F.lead("band").over(order).isNull(), F.col("deepest")).otherwise(-1).alias("size"),
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _bits(places: list[int]) -> int:
    out = bytearray(_SHARD >> 3)
    for p in places:
        out[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(out, "little")


def pack_set(bits: int) -> bytes:
    """A set of places in a shard: two bytes for each of a few, else all bits."""
    if bits.bit_count() * 2 < _SHARD >> 3:
        return np.flatnonzero(_unpacked(bits)).astype("<u2").tobytes()
    return bits.to_bytes(_SHARD >> 3, "little")


def _unpacked(bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.to_bytes(_SHARD >> 3, "little"), np.uint8), bitorder="little")


def unpack_set(data: bytes) -> np.ndarray:
    if len(data) == _SHARD >> 3:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return np.frombuffer(data, "<u2").astype(np.int64)


def grow(conv: np.ndarray, depth: np.ndarray, k1: np.ndarray, k2: np.ndarray, size: np.ndarray):
    """Nodes of one shard and band, depth first.

    Rows are sorted by conversation; each one's head (depth -1: key of what
    came before, last depth in ``size``) precedes its turns.  Returns for each
    node the row of its smallest member, the members, and the set of members
    that end there; and the key of every row's prefix.
    """
    head = np.flatnonzero(depth < 0)
    ends = np.append(head[1:], len(conv))
    local = (conv[head] & (_SHARD - 1)).tolist()
    prefix = []
    for k in (k1, k2):
        all_before = np.bitwise_xor.accumulate(k)
        start = np.where(head > 0, all_before[head - 1], 0)
        prefix.append(all_before ^ np.repeat(start, ends - head))
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    # vertical index: for each (depth, turn) the conversations that have it
    owner = np.repeat(np.array(local), ends - head)
    turn = depth[order] >= 0
    cuts = np.flatnonzero(np.diff(code[order][turn], prepend=-1))
    members = owner[order][turn]
    postings: dict[int, int] = {}
    for a, b, c in zip(cuts.tolist(), [*cuts[1:].tolist(), len(members)], code[order][turn][cuts].tolist()):
        postings[c] = 1 << int(members[a]) if b - a == 1 else _bits(members[a:b].tolist())
    code = code.tolist()
    row_of, last_of, stops, started = {}, {}, {}, {}
    for j, h, e in zip(local, head.tolist(), ends.tolist()):
        row_of[j], last_of[j] = h + 1, e
        if size[h] >= 0:
            stops.setdefault(int(size[h]), []).append(j)
        started.setdefault((int(prefix[0][h]), int(prefix[1][h])), []).append(j)
    stops = {d: _bits(js) for d, js in stops.items()}
    at = np.asarray(depth).tolist()
    nodes, stack = [], [(_bits(js), 0) for js in started.values()]
    while stack:
        parent, d = stack.pop()
        rest = parent
        while rest:
            low = rest & -rest
            j = low.bit_length() - 1
            r = row_of[j] + d
            if r >= last_of[j]:  # has no turn here
                rest ^= low
                continue
            child = parent & postings[code[r]]
            rest &= ~child
            if child == low:  # a single conversation: the rest of its turns
                for q in range(r, last_of[j]):
                    nodes.append((q, 1, low if stops.get(at[q], 0) & low else 0))
            else:
                nodes.append((r, child.bit_count(), child & stops.get(at[r], 0)))
                stack.append((child, d + 1))
    return nodes, prefix


def shard_nodes(rows: DataFrame) -> DataFrame:
    """Written table of the nodes of every shard: key, depth, parent's key, smallest member, members, code points, end set."""
    names = ["conv_id", "band", "depth", "k1", "k2", "size"]
    with_band = rows.withColumn("band", F.shiftright("depth", BAND_BITS)).select(*names)
    both = with_band.union(_heads(rows).select(*names)).withColumn("shard", F.shiftright("conv_id", SHARD_BITS))
    placed = both.repartition("shard", "band").sortWithinPartitions("shard", "band", "conv_id", "depth")
    schema = "k1 long, k2 long, depth long, p1 long, p2 long, conv_id long, n long, size long, shard long, ends binary"

    def run(batches):
        for group in _groups(batches, ["shard", "band"]):
            conv, depth, k1, k2, size = (group.column(c).to_numpy() for c in ("conv_id", "depth", "k1", "k2", "size"))
            nodes, (x1, x2) = grow(conv, depth, k1, k2, size)
            r, n, ends = (list(c) for c in zip(*nodes))
            r = np.array(r)
            columns = [x1[r], x2[r], depth[r], x1[r - 1], x2[r - 1], conv[r], np.array(n, np.int64), size[r]]
            shard = np.full(len(r), int(conv[0]) >> SHARD_BITS, np.int64)
            sets = pa.array([pack_set(e) if e else None for e in ends], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (*columns, shard)] + [sets],
                names=["k1", "k2", "depth", "p1", "p2", "conv_id", "n", "size", "shard", "ends"],
            )

    return stable(placed.mapInArrow(run, schema))


def end_lists(nodes: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of the nodes where a conversation ends.

    A digest of one list is sequential; the task reads the list as one small
    set for each shard, in order, and holds one set at a time.
    """
    sets = nodes.where("ends IS NOT NULL").select(*_NODE, "shard", "ends")
    sets = sets.repartition(*_NODE).sortWithinPartitions(*_NODE, "shard")

    def run(batches):
        now, state, rows = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_NODE, "shard", "ends")]
            for k1, k2, depth, shard, data in zip(*columns):
                text = ",".join(map(str, (unpack_set(data) + (shard << SHARD_BITS)).tolist()))
                if (k1, k2, depth) != now:
                    if now:
                        rows.append((*now, state.hexdigest()))
                    now, state = (k1, k2, depth), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if rows:
                yield _digests(rows)
                rows = []
        if now:
            yield _digests([(*now, state.hexdigest())])

    return sets.mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*_NODE, "ends_sha256"])


def _chains(nodes: DataFrame) -> DataFrame:
    """Written table of chains: owner, top and bottom depth, saved (own sum), the owner above and the depth where it hangs."""
    top = F.min_by(F.struct("p1", "p2"), "depth")
    saved = F.sum((F.col("n_convs") - 1) * F.col("size"))
    chains = nodes.groupBy(F.col("conv_id").alias("owner")).agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), saved.alias("saved"), top.alias("p"))
    chains = chains.select("owner", "top", "bottom", "saved", F.col("p.p1").alias("k1"), F.col("p.p2").alias("k2"),
                           (F.col("top") - 1).alias("depth"))
    above = nodes.select(*_NODE, F.col("conv_id").alias("above"))
    return stable(chains.join(above, _NODE, "left").select("owner", "top", "bottom", "saved", "above", F.col("depth").alias("at")))


def _totals(chains: DataFrame) -> DataFrame:
    """(owner, saved, leaves): sums over each chain and all chains that hang from it, directly or not.

    After round k a chain holds the sums of the chains less than 2 to the k
    steps below it, and knows the one 2 to the k steps above.
    """
    hung = chains.where("above IS NOT NULL").select(F.col("above").alias("owner"), F.col("at").alias("bottom")).distinct()
    ends = chains.join(hung.withColumn("goes_on", F.lit(1)), ["owner", "bottom"], "left")
    state = stable(ends.select("owner", "above", "saved", F.when(F.col("goes_on").isNull(), 1).otherwise(0).cast("long").alias("leaves")))
    while not state.where("above IS NOT NULL").isEmpty():
        given = state.where("above IS NOT NULL").groupBy(F.col("above").alias("owner")).agg(
            F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        onward = state.where("above IS NOT NULL").select(F.col("owner").alias("above"), F.col("above").alias("next"))
        state = stable(state.join(given, "owner", "left").join(onward, "above", "left").select(
            "owner", F.col("next").alias("above"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")))
    return state.select("owner", "saved", "leaves")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations as one node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  NULL roles and texts are empty;
    repeated rows are turns like any others; rows without a conv_id are left
    out; an empty table has no nodes, not even a root.  Other columns are not
    read, so their names cannot clash.
    """
    parts = shard_nodes(rebuilt_turns(conversations))
    nodes = stable(parts.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("size").alias("size"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    chains = _chains(nodes)
    totals = _totals(chains)
    hung = chains.where("above IS NOT NULL").join(totals.withColumnsRenamed({"saved": "all_saved", "leaves": "all_leaves"}), "owner")
    hung = hung.groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.count("*").alias("branches"), F.sum("all_saved").alias("all_saved"), F.sum("all_leaves").alias("all_leaves"))
    chain = chains.select(F.col("owner").alias("conv_id"), "top", "bottom", "above")
    rows = nodes.join(chain, "conv_id").join(hung, ["conv_id", "depth"], "left").join(end_lists(parts), _NODE, "left")
    none, goes_on = F.lit(0), F.col("depth") < F.col("bottom")
    children = goes_on.cast("long") + F.coalesce("branches", none)
    rows = rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", children.alias("n_children"),
        F.when(children == 0, 1).otherwise(F.coalesce("all_leaves", none)).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size") + F.coalesce("all_saved", none)).alias("saved"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    # along a chain: everything at the node's depth or below
    out = prefix_scan(rows, ["conv_id"], [F.col("depth").desc()], {
        "n_leaves": ("sum", F.col("leaves"), True), "saved_tokens": ("sum", F.col("saved"), True)})
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
