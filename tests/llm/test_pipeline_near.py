"""The pipeline's near-duplicate stage against a 5-word, 0.8 brute force."""

from itertools import combinations

from brute import words
from text_cases import SF, frame

import corpus_pipeline as cp
from locusmill.llm import ngram_join


def shingles(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)) if w else frozenset()


def near(a, b, n, percent):
    return 100 * len(a & b) >= percent * len(a | b) if a and b else False


def kept(docs, n=5, percent=80):
    """Ids that stay: the least of each component, found by comparing all pairs."""
    sets, least = {d: shingles(t, n) for d, t in docs}, {d: d for d, _ in docs}
    links = [p for p in combinations(sorted(sets), 2) if near(sets[p[0]], sets[p[1]], n, percent)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            moved |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    return {d for d, low in least.items() if d == low}


def test_small_table(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = kept(small)
    assert want < kept(small, 3, 90)  # the table has pairs that only five words and 0.8 find
    assert {r.doc_id for r in cp.near_duplicate_stage(spark, docs, SF).collect()} == want


def test_pair_that_three_words_and_90_miss(spark):
    text = [f"w{i}" for i in range(100)]
    changed = [x if i not in (30, 70) else f"other{i}" for i, x in enumerate(text)]
    further = [x if i not in (20, 40, 60, 80) else f"far{i}" for i, x in enumerate(text)]
    docs = [(1, " ".join(text)), (2, " ".join(changed)), (3, " ".join(further)), (4, "a b c d"), (5, "A b c d"), (6, ""), (7, None)]
    a, b = shingles(docs[0][1], 5), shingles(docs[1][1], 5)
    assert near(a, b, 5, 80) and not near(shingles(docs[0][1], 3), shingles(docs[1][1], 3), 3, 90)
    found = {r.doc_id for r in cp.near_duplicate_stage(spark, frame(spark, docs), SF).collect()}
    assert found == kept(docs) == {1, 3, 4, 6, 7}
    assert (ngram_join.N, ngram_join.PERCENT) == (3, 90)  # op10's own
