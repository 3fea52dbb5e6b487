"""Language-model scores: exact base, normalised and better than the base on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import words
from text_cases import SF, frame

from locusmill.llm import log_bilinear as lbl


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(docs):
    held = [zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2 for d, _ in docs]
    tokens = [words(lower(t)) + [None] for _, t in docs]
    count = Counter(w for h, ws in zip(held, tokens) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [
        (d, h, len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5))
        for (d, _), h, ws in zip(docs, held, tokens)
    ]


@pytest.mark.parametrize("kind", ["small", "odd"])
@pytest.mark.parametrize("head", [30, lbl.HEAD])
def test_base(spark, request, kind, head):
    docs = request.getfixturevalue(kind)
    out = lbl.lbl_scores(frame(spark, docs), vocabulary=20, head=head).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out]
    assert sorted(got, key=str) == sorted(base(docs), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_empty(spark):
    assert lbl.lbl_scores(frame(spark, [])).count() == 0
    only = lbl.lbl_scores(frame(spark, [(4, "a b c")]))  # 4 is held out or not; either way a score exists
    assert math.isfinite(only.first().score)


def test_better_than_base_on_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = lbl.lbl_scores(docs).where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum()


def test_normalised():
    rng = np.random.default_rng(2)
    model = lbl.Model.start(np.sort(rng.integers(0, 1 << 60, 30)), rng.integers(1, 50, 30), 2000)
    model.target += rng.normal(0, 1, model.target.shape)
    contexts = [rng.integers(0, 32, 200), rng.integers(0, 32, 200)]
    score = model.predicted(contexts) @ model.target.T + model.bias
    p = np.exp(score - model.log_normaliser(contexts, rows=64)[:, None])
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_learns_a_pattern():
    """Entry 1 always follows entry 0: training must find out."""
    model = lbl.Model.start(np.arange(3), np.array([100, 100, 100]), 300)
    trainer = lbl._Trainer(model, 1)
    entries = np.tile([0, 1, 2, 2], 4000)
    contexts = model.contexts(entries, np.array([0, len(entries)]))
    for _ in range(150):
        trainer.step(entries, contexts)
    log_p = (model.predicted(contexts) * model.target[entries]).sum(1) + model.bias[entries] - model.log_normaliser(contexts)
    assert np.exp(log_p[1::4]).mean() > 0.8
