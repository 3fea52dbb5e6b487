"""Line runs against plain Python."""

import random

import pytest
from text_cases import frame

from locusmill.llm import line_dedup as ld


def brute(docs, k):
    """[(doc_id, n_lines, n_removed, kept)]; ids are unique here."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        real = [j for j, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        if doc is not None:
            for i in range(len(real) - k + 1):
                window = tuple(lines[j] for j in real[i : i + k])
                if window in seen:
                    gone.update(range(i, i + k))
                seen.add(window)
        dropped, at = set(), -1
        for j in range(len(lines)):
            if at + 1 < len(real) and real[at + 1] == j:
                at += 1
            if at in gone:
                dropped.add(j)
        out.append((doc, len(real), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in dropped)))
    return out


def invented(seed, n=60):
    rng = random.Random(seed)
    blocks = [[f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    docs = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(5)):
            lines += rng.choice(blocks) if rng.random() < 0.7 else [f"own {d} {rng.random()}"]
            lines += [""] * (rng.random() < 0.3)
        docs.append((d * 3, "\n".join(lines)))
    return docs + [(1, None), (2, ""), (4, "\n \n"), (None, docs[5][1])]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_invented(spark, k):
    docs = invented(k)
    out = ld.line_dedup(frame(spark, docs), k)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(brute(docs, k), key=str)


def test_small(spark, small):
    out = ld.line_dedup(frame(spark, small))
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute(small, ld.MIN_LINES))


def test_odd(spark, odd):
    out = ld.line_dedup(frame(spark, odd)).collect()
    assert len(out) == len(odd)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].n_removed == 0 and by[0][0].kept == ""
    assert by[50][0].n_lines in (40, 1) and {r.n_removed for r in by[60]} == {0, 40}
    assert ld.line_dedup(frame(spark, [])).count() == 0


def test_runs_and_suffix_order(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nq")]
    runs = sorted(tuple(r)[0:1] + tuple(r)[2:] for r in ld.repeated_runs(frame(spark, docs)).collect())
    assert runs == [(2, 1, 3, 1, 1), (3, 0, 1, 1, 1)]
    levels = ld.common_prefixes(ld._keyed(frame(spark, docs), "doc_id", "text"))
    assert [t.first().depth for t in levels] == [1, 2]
    two = {(r.doc_id, r.i): (r.rank, r.head.doc_id) for r in levels[1].collect()}
    assert {k for k in two} == {(1, 1), (2, 1), (3, 0), (1, 2), (2, 2)}
    assert len({two[k] for k in ((1, 1), (2, 1), (3, 0))}) == 1 and two[(1, 2)] == two[(2, 2)]
    assert {r for r, _ in two.values()} in ({0, 3}, {0, 2})


def test_long_run_takes_all_rounds(spark):
    lines = [f"l{i}" for i in range(70)]
    levels = ld.common_prefixes(ld._keyed(frame(spark, [(1, "\n".join(lines)), (2, "\n".join(lines[3:]))]), "doc_id", "text"))
    assert [t.first().depth for t in levels] == [1, 2, 4, 8, 16, 32, 64]
