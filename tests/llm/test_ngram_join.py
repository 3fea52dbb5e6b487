"""Components of the n-gram join against comparing every pair."""

import random

import numpy as np
import pytest
from brute import components as brute
from text_cases import frame

from locusmill.llm import ngram_join
from locusmill.llm.components import components


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_group(rng, size, words, most):
    """A text and ``size`` copies with up to ``most`` changed words each."""
    base = [f"t{rng.randrange(4000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(most + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_small(spark, small):
    assert got(ngram_join.jaccard_components(frame(spark, small))) == sorted(brute(small), key=str)


def test_groups(spark):
    """Groups whose members lie on both sides of the threshold, a line all share, exact copies."""
    rng = random.Random(3)
    found = []
    for size, words, most in ((60, 120, 8), (40, 300, 25), (30, 40, 3), (25, 12, 1), (20, 700, 40)):
        found += near_group(rng, size, words, most)
    common = "one very common line that nearly all of the texts begin with here "
    found = [common + t if i % 3 else t for i, t in enumerate(found)] + found[5:25] + ["", "a", "a", "A", "a b", "b a"]
    rng.shuffle(found)
    docs = list(enumerate(found))
    want = sorted(brute(docs), key=str)
    assert got(ngram_join.jaccard_components(frame(spark, docs))) == want
    assert 5 < len({c for _, _, c in want}) < len(docs) - 20


def test_order_without_counts(spark, monkeypatch):
    """Results do not depend on what the orders know about frequencies."""
    rng = random.Random(5)
    docs = list(enumerate(near_group(rng, 50, 90, 7) + near_group(rng, 30, 60, 4)))
    monkeypatch.setattr(ngram_join, "frequent_grams", lambda docs, n: (ngram_join.np.zeros(0, "u8"), ngram_join.np.zeros(0, "i8")))
    assert got(ngram_join.jaccard_components(frame(spark, docs))) == sorted(brute(docs), key=str)


def test_odd(spark, odd):
    want = sorted(brute([(d, t) for d, t in odd if d is not None]), key=str)
    out = got(ngram_join.jaccard_components(frame(spark, odd)))
    assert [r for r in out if r[0] is not None] == want
    assert [r[2] for r in out if r[0] is None] == [None]
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, rng.randrange(200, 260)) for _ in range(80)]
    links += [(rng.randrange(300, 380), rng.randrange(300, 380)) for _ in range(40)]
    label = {n: n for e in links for n in e}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    out = components(spark.createDataFrame(links, "u long, v long")).collect()
    looped = {a for a, b in links if a == b}
    assert {r.node: r.component for r in out} == {n: c for n, c in label.items() if n in {r.node for r in out}}
    assert {n for n in label} - {r.node for r in out} <= looped


def partners_of_least_size(n, percent):
    """Groups in which the only partner of a set has exactly the least size it may have.

    y has so many words that its set is smaller than that of x by exactly what
    is allowed; c shares x's and y's n-grams and a last one that is frequent.
    """
    docs = []
    for g in range(40):
        y = [f"y{g}w{i}" for i in range(11)]
        x, c = [f"x{g}", *y], [*y, f"often {percent} again"]
        texts = [x, y, c] + [[f"u{g}v{k}w{i}" for i in range(9)] + [f"often {percent} again"] for k in range(6)]
        docs += [(10 * g + j, " ".join(t)) for j, t in enumerate(texts)]
    return docs


@pytest.mark.parametrize("n,percent", [(3, 90), (3, 80), (5, 80)])
def test_partners_of_least_size(spark, n, percent):
    docs = partners_of_least_size(n, percent)
    sets = {d: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for d, t in docs}
    want = {d: d for d in sets}
    for _ in range(3):
        for a in sets:
            for b in range(a - a % 10, a - a % 10 + 9):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    out = ngram_join.jaccard_components(frame(spark, docs), n=n, percent=percent)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_partner_sizes(spark, percent):
    """Every set size up to 5,000 at several places of the shared token, in whole numbers."""
    low, high = ngram_join.partner_sizes(percent)
    rows = spark.range(1, 5001).selectExpr("id AS n", "explode(array(0, 1, 2, id div 30, id div 12)) AS pos").where("pos < n")
    for n, pos, a, b in rows.selectExpr("n", "pos", low, high).distinct().collect():
        links = lambda size: 100 * min(n - pos, size) >= percent * (n + size - min(n - pos, size))  # noqa: B023, E731
        if b >= a:
            assert links(b) and not links(b + 1) and 100 * a >= percent * n > 100 * (a - 1)
        else:
            assert not any(links(size) for size in range(max(a - 1, 1), n + 2))


def test_parts_of_a_batch_are_handed_on():
    """No task holds the sets or prefixes of a whole batch at once."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    long = [" ".join(map(str, rng.integers(0, 10**6, 20_000))) for _ in range(12)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(12), pa.int64()), "text": pa.array(long)})
    parts = list(ngram_join._prefix_rows(3, 90, np.zeros(0, np.uint64), np.zeros(0, np.int64))(iter([batch])))
    assert len(parts) == 12 and max(p.num_rows for p in parts) < 3
    assert [d for p in parts for d in p.column("doc_id").to_pylist()] == list(range(12))
