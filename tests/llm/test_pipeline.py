"""The pipeline's stages on the smallest tables and on odd rows, against plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import stats, words
from test_long_lines import brute as lines
from test_pipeline_near import kept
from test_secret_scan import base
from text_cases import SF, frame

import corpus_pipeline as cp
from locusmill.llm import line_dedup, packing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def steps(spark):
    """The written result of each stage over the smallest tables."""
    from locusmill.plans.session import stable

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        docs = stable(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == list(cp.COLUMNS) and df.dtypes == steps[0].dtypes


def test_quality(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[:2])
    assert set(after) < set(before) and all(after[d] == before[d] for d in after)
    for d, r in before.items():
        n, _, _, _, twice = stats(r.text)
        if n < 50 or 100 * twice > 50 * n:
            assert d not in after
    assert len(after) > 0.7 * len(before)


def test_lines(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {}
    for d, n, gone, text in lines(before, 2, line_dedup.MIN_WORDS):
        if gone < n and (len(words(text)) >= cp.LEAST_WORDS or 2 * len(text) >= len(dict(before)[d])) or not n:
            want[d] = text
    assert {r.doc_id: r.text for r in steps[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_near_duplicates(steps):
    assert {r.doc_id for r in steps[3].collect()} == kept([(r.doc_id, r.text) for r in steps[2].collect()])


def test_planted_near_copies(spark, tmp_path):
    """Copies with a changed word in one line or in every line: one of each group is left by the stages together."""
    line = lambda g, i: " ".join(f"g{g}l{i}w{j}" for j in range(12))
    docs = []
    for g in range(6):
        base = [line(g, i) for i in range(8)]
        one = [*base[:5], base[5].replace("w3", "other"), *base[6:]]
        all_ = [x.replace(f"l{i}w11", f"l{i}new") if i % 3 == 0 else x for i, x in enumerate(base)]
        docs += [(10 * g, "\n".join(base)), (10 * g + 1, "\n".join(one)), (10 * g + 2, "\n".join(all_)), (10 * g + 3, "\n".join(base))]
    docs += [(90 + k, "\n".join([line(0, 0), *(line(50 + k, i) for i in range(9))])) for k in range(3)]  # one shared line each
    out = cp.near_duplicate_stage(spark, cp.line_stage(spark, frame(spark, docs), SF), SF)
    assert {r.doc_id for r in out.collect()} == {0, 10, 20, 30, 40, 50, 90, 91, 92}


def test_secrets(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    after = {r.doc_id: r for r in steps[4].collect()}
    assert set(before) == set(after)
    for d, text in before.items():
        assert not base(after[d].text) and (base(text) or after[d].text == text or "[secret]" in after[d].text)
        assert after[d].n_chars == len(after[d].text)


def test_packing(steps):
    encode = packing.byte_bpe(packing.byte_bpe_paths())
    want = defaultdict(dict)
    for r in steps[4].collect():
        ids, start = np.append(encode(r.text), 0).astype("<u4"), 0
        for k, n in enumerate(packing.cut(len(ids))):
            want[r.doc_id][k] = (start, n, zlib.crc32(ids[start : start + n].tobytes()))
            start += n
    got = defaultdict(dict)
    for r in steps[5].collect():
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    assert got == want


def test_run(spark, steps):
    out = cp.run(spark, SF)
    assert out.columns == steps[5].columns
    assert sorted(r[:5] for r in rows(out)) == sorted(r[:5] for r in rows(steps[5]))


def test_odd_rows(spark, odd):
    """Nulls, empty texts, clashing columns, ids that occur twice: every stage takes them."""
    docs = frame(spark, odd)
    assert cp.quality_stage(spark, docs, SF).columns == list(cp.COLUMNS)
    for stage in (cp.line_stage, cp.secret_stage):
        out = stage(spark, docs, SF)
        assert out.columns == list(cp.COLUMNS) and out.count() <= len(odd)
    near = [(r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, docs, SF).collect()]
    assert len(near) == len(set(near)) and sum(t == odd[5][1] for _, t in near) == 2  # one of the group, one without an id
    assert cp.packing_stage(spark, docs, SF).count() >= len(odd)
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
