"""Long lines that recur alone, against plain Python."""

import re

import pytest
from test_line_dedup import brute as runs
from text_cases import SF, frame

import corpus_pipeline as cp
from locusmill.llm import line_dedup as ld
from locusmill.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k, words):
    """[(doc_id, n_lines, n_removed, kept)] with single lines of ``words`` words as runs; ids are unique here."""
    seen, pairs, out = set(), set(), []
    for doc, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone, real = (text or "").split("\n"), set(), []
        for j, x in enumerate(lines):
            if WORD.search(x):
                real.append(j)
                if doc is not None and x in seen and len(WORD.findall(x)) >= words:
                    gone.add(j)
                seen |= {x} if doc is not None else set()
        for i in range(len(real) - k + 1 if doc is not None else 0):
            window = tuple(lines[j] for j in real[i : i + k])
            gone.update(real[i : i + k] if window in pairs else [])
            pairs.add(window)
        kept, drop = [], False
        for j, x in enumerate(lines):
            drop = j in gone if j in real else drop
            kept += [] if drop else [x]
        out.append((doc, len(real), len(gone), "\n".join(kept)))
    return out


LONG = "a passage of one line that has rather more than ten words in it"


def cases():
    return [
        (1, f"first\n{LONG}\n\nlast"), (2, f"other\n{LONG}\n \nwords"), (3, LONG), (4, f"x\nshort one\n{LONG}\n{LONG}\ny"),
        (5, "own\nshort one\nend"), (6, None), (7, ""), (None, LONG), (8, "nine words are not enough to be a passage"),
        (9, "q\nnine words are not enough to be a passage"), (10, "first\n" + LONG),
    ]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("words", [2, 10])
def test_cases(spark, k, words):
    out = ld.line_dedup(frame(spark, cases()), k, min_words=words)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(brute(cases(), k, words), key=str)


def test_query(spark, small):
    want = brute(small, ld.MIN_LINES, ld.MIN_WORDS)
    assert want != runs(sorted(small), ld.MIN_LINES)  # the table has long lines that recur alone
    assert sorted(tuple(r) for r in queries.op8_line_dedup(spark, SF).collect()) == sorted(want)


def test_stage(spark, small):
    texts, want = dict(small), {}
    for d, n, gone, text in brute(small, ld.MIN_LINES, ld.MIN_WORDS):
        if gone < n and (not gone or len(WORD.findall(text)) >= cp.LEAST_WORDS or 2 * len(text) >= len(texts[d])) or not n:
            want[d] = text
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: r.text for r in cp.line_stage(spark, docs, SF).collect()} == want
