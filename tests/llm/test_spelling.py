import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from locusmill.llm import spelling, sql
from locusmill.llm.words import texts
from text_cases import SF, frame

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows, noise=199):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_groups(rows):
    n = {w: k for w, k in plain_counts(rows).items() if k >= 5}
    at = defaultdict(set)
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            at[v].add(w)
    near = defaultdict(set)
    for group in at.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def groups(spark, rows):
    return sorted((tuple(r) for r in spelling.spelling_groups(frame(spark, rows)).collect()))


def test_given_table(spark, small):
    assert groups(spark, small) == plain_groups(small)


def test_counts_of_odd_rows(spark, odd):
    rows = odd + [(3, "Éclair éclair ÉCLAIR naïveté×÷ abĀcdefgh ¿abcdef Kİabcdef ABCDEFé"), (3, "é" * 80), (4, "abcdefé" * 30)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(frame(spark, rows)).collect()}
    assert got == plain_counts(rows)


def test_chains_ties_and_noise(spark):
    """A way over several forms, two equally frequent neighbours, misspelt copies, repeated rows."""
    words = {"letters": 700, "lettrs": 120, "lettrss": 20, "letttrss": 4, "kiwano": 6, "kiwanos": 30, "kiwanoz": 30, "niente": 5,
             "nienté": 25, "grossß": 40, "aaaaaa": 50, "aaaaaaa": 9, "baaaaa": 7, "aaaaab": 6}
    rows = [(i, " ".join([w] * (k // 2))) for i, (w, k) in enumerate(words.items())]
    rows += [(None, " ".join([w] * (k - k // 2))) for w, k in words.items()]
    rows += rows[:3] + [(d, "receive believe separate") for d in range(900)]
    want = plain_groups(rows)
    assert groups(spark, rows) == want and any(r[2] != r[1] is not None for r in want)


def test_no_rows(spark):
    assert groups(spark, []) == groups(spark, [(1, None), (2, ""), (3, "one two")]) == []


def test_noise_drops_the_right_letter(spark):
    rows = [(d, "Straßenbahn élève chevalière") for d in range(2000)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(frame(spark, rows), noise=7).collect()}
    assert got == plain_counts(rows, noise=7) and len(got) > 10


def test_every_word_keeps_a_gram():
    """Whichever pairs of letters are extended, a word of six or more has a gram that no edit place changes."""
    for n in (6, 7, 8):
        word = "abcdefgh"[:n]
        for pick in product([False, True], repeat=n - 2):
            grams = spelling.Grams({})
            grams.longer = {word[p : p + 3] for p, on in enumerate(pick) if on}
            grams.heads = grams.tails = {word[p : p + 2] for p in range(n - 1)}  # the weakest case
            assert grams.rarest(word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=6, max_size=9), min_size=2, max_size=60, unique=True), st.integers(0, 20))
def test_near_pairs_share_a_posting(words, frequent):
    counts = Counter(w[p : p + q] for w in words for q in (2, 3) for p in range(len(w) - q + 1))
    grams, keys = spelling.Grams(counts, frequent), {}
    for w in words:
        keys[w] = {x for p, n in grams.rarest(w) for x in (("start", n, w[: p + n]), ("end", n, w[p:]))}
    for a in words:
        for b in words:
            if one_edit(a, b):
                assert keys[a] & keys[b], (a, b)


def test_run_crc():
    random.seed(5)
    rows = [" ".join("".join(random.choice("abcéÿZ") for _ in range(random.choice([1, 6, 31, 64, 65, 300]))) for _ in range(20)) for _ in range(9)]
    runs, length = spelling.letter_runs(*texts(pa.array(rows)))
    want = [w.translate(SMALL) for t in rows for w in RUN.findall(t)]
    assert length.tolist() == [len(w) for w in want]
    start = np.array([zlib.crc32(b"12:") ^ 0xFFFFFFFF] * len(want), np.uint32)
    assert spelling.run_crc(runs, start, spelling._crc_table()).tolist() == [zlib.crc32(b"12:" + w.encode()) for w in want]


def test_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = db.sql(sql.SPELLING_GROUPS).fetchall()
    got = [tuple(r) for r in spelling.spelling_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
