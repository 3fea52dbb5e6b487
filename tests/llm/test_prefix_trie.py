import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql.types import LongType

from locusmill.llm import prefix_trie, sql
from text_cases import SF

COLUMNS = "conv_id long, turn long, role string, text string, depth int, k1 string, owner int"


def plain(rows):
    """Nodes from a dictionary of prefixes, for (conv_id, turn, role, text) rows."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            role, text = (r or "").encode(), (x or "").encode()
            h = xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(role, 42))
            conv[c].append((t is not None, t or 0, h - (h >> 63 << 64), r or "", x or ""))
    own = {c: [q[3:] for q in sorted(v)] for c, v in conv.items()}
    members = defaultdict(list)
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) if below[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below[p])
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted(
        (least[p], len(p), least[p[:-1]] if p else -10**9, len(m), len(below[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest())
        for p, m in members.items()
    )


def trie(spark, rows):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], COLUMNS)
    out = prefix_trie.prefix_trie(table)
    assert all(f.dataType == LongType() for f in out.schema.fields[:-1])
    return sorted((*r[:2], -10**9 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def test_given_table(spark):
    table = pq.read_table(f"{SF}/conversations.parquet")
    rows = list(zip(*(table[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))))
    assert trie(spark, rows) == plain(rows)


def test_shared_and_odd_rows(spark):
    random.seed(3)
    rows = []
    for c in [*range(0, 40), *range(95, 110), 511, 512, 513, 600, 1024, -3, -100, -150, 10**12, 10**12 + 7]:
        for t in range(random.randint(0, 7)):
            rows.append((c, t, random.choice(["user", "assistant", None]), random.choice(["a", "b", "", None, "日本 é"])))
    rows += [(7, None, "user", "late"), (7, None, "user", "early"), (8, 3, "user", "tie"), (8, 3, "user", "tie"), (8, 3, "x", "other tie")]
    rows += [(None, 0, "user", "nobody"), (61, None, None, None), (62, 0, "ab", "c"), (63, 0, "a", "bc")]
    rows += [(64, 0, "user", "x" * 100_000)]
    assert trie(spark, rows) == plain(rows)


def test_long_conversations_cross_bands(spark):
    """Several lengths around a band's 256 turns; copies that end inside and outside shared bands."""
    rows = []
    for c, n in ((200, 700), (201, 256), (202, 255), (203, 257), (204, 512), (205, 511), (206, 700), (299, 513)):
        rows += [(c, t, "user", f"turn {t}" if (c, t) != (206, 600) else "apart") for t in range(n)]
    assert trie(spark, rows) == plain(rows)


def test_one_very_common_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1500) for t in range(4)] + [(c, 4, "user", str(c % 7)) for c in range(0, 1500, 3)]
    assert trie(spark, rows) == plain(rows)


def test_chain_of_branches(spark):
    """Each conversation leaves the one before it one turn later, so that chains hang from chains."""
    rows = [(100 * c, t, "user", "on" if t < c else f"off {c}") for c in range(40) for t in range(c + 2)]
    assert trie(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("places", [[], [0], [511], [3, 7, 500], list(range(0, 512, 2)), list(range(512))])
def test_sets_survive_packing(places):
    assert prefix_trie.unpack_set(prefix_trie.pack_set(prefix_trie._bits(places))).tolist() == places


def test_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        want = db.sql(sql.PREFIX_TRIE).fetchall()
    got = [tuple(r) for r in prefix_trie.prefix_trie(spark.read.parquet(f"{SF}/conversations.parquet")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
