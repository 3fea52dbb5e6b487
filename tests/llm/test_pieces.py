"""Piece encoding against the library with the same model, and against plain dynamic programming."""

import hashlib
import random

import pytest
from text_cases import ODD_TEXTS, frame

from locusmill.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Encoder(pieces.piece_path())


@pytest.fixture(scope="module")
def unigram():
    """The same pieces with their scores added up, as in a unigram model."""
    return pieces.Encoder(pieces.piece_path(), merges=False)


@pytest.fixture(scope="module")
def library():
    """The library on the same pieces, with its own best-score search switched on in the file's settings."""
    from sentencepiece import SentencePieceProcessor

    with open(pieces.piece_path(), "rb") as file:
        data = file.read()
    assert data.count(b"tok_v0\x18\x02") == 1
    return SentencePieceProcessor(model_proto=data.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))


@pytest.fixture(scope="module")
def value(model):
    """Score of each piece id."""
    return {i: s for i, s, _ in filter(None, model.automaton.piece)}


def plain(model, known, part):
    """Best split by trying every piece at every place."""
    score, back = [0.0] + [float("-inf")] * len(part), [None] * (len(part) + 1)
    for end in range(1, len(part) + 1):
        for start in range(max(0, end - 20), end):
            number, value = known.get(part[start:end], (-1, model.unknown))
            if number < 0 and end - start > 1:
                continue
            if score[start] + value > score[end]:
                score[end], back[end] = score[start] + value, (number, start)
    return score[-1], back


def split_score(model, value, part):
    return sum(value[n] if n >= 0 else model.unknown for n, _ in model.automaton.best(part, model.unknown))


def test_best_score(model, value, small):
    rng, known = random.Random(1), {model.pieces[i]: (i, s) for i, s in value.items()}
    texts = sorted({w for _, t in small for w in t.split()[:30]})[::3]
    texts += ["".join(rng.choice("aehirst▁▁né漢\n,.") for _ in range(n)) for n in range(40)]
    for t in texts:
        assert split_score(model, value, t) == pytest.approx(plain(model, known, t)[0], abs=1e-6)


def test_added_scores_as_library(unigram, value, library, small):
    """Word by word, since the library adds scores in single precision; its n-best search is the exact one."""
    checked = 0
    for word in sorted({w for _, text in small for w in text.split()[:40]}):
        ids, theirs = unigram.encode(word).tolist(), library.nbest_encode_as_ids(word, 2)[0]
        score = lambda found: sum(value.get(i, -1e9) for i in found)
        assert ids == theirs or score(ids) == pytest.approx(score(theirs), rel=1e-6)
        checked += ids == theirs
    assert checked > 2000


def test_same_as_library(model, small):
    """The file as it is: the ids of every whole text, of odd texts and of runs of any characters."""
    from sentencepiece import SentencePieceProcessor

    theirs, rng = SentencePieceProcessor(model_file=pieces.piece_path()), random.Random(3)
    texts = [t for _, t in small] + [t for t in ODD_TEXTS if t]
    texts += ["".join(rng.choice("aabehiorst  né漢\n\t,.01😀") for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    texts += [c * n for c in " a0=\n-é" for n in range(1, 70)]
    for t in texts:
        assert model.encode(t).tolist() == theirs.encode(t), t[:200]
        assert model.decode(model.encode(t)) == theirs.decode(theirs.encode(t))


def test_kind(model, unigram):
    assert pieces.model_kind(pieces.piece_path()) == pieces.MERGES and model.merges and not unigram.merges


def test_decoding_of_any_ids(model):
    from sentencepiece import SentencePieceProcessor

    theirs, rng = SentencePieceProcessor(model_file=pieces.piece_path()), random.Random(5)
    for _ in range(2000):
        ids = [300] + [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == theirs.decode(ids)


@pytest.mark.parametrize("kind", ["model", "unigram"])
def test_parts_do_not_matter(kind, request):
    """Splitting a text into parts before gives the ids of the whole."""
    model = request.getfixturevalue(kind)
    text = "▁some▁▁▁words▁and▁▁numbers▁12▁x\n▁y"
    whole = model._split(text)
    assert model.encode("some   words and  numbers 12 x\n y").tobytes() == whole


def test_round_trip(model, small):
    for text in [t for _, t in small] + [t for t in ODD_TEXTS if t]:
        assert model.decode(model.encode(text)) == text
    assert model.encode("").tolist() == [] and model.decode([]) == "" and model.decode([1, 2]) == ""


def test_tables(spark, odd, model):
    out = pieces.encode_texts(frame(spark, odd))
    rows = sorted(((r.doc_id, r.n_ids, list(r.ids)) for r in out.collect()), key=str)
    assert rows == sorted(((d, len(model.encode(t or "")), model.encode(t or "").tolist()) for d, t in odd), key=str)
    back = pieces.decode_ids(out)
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((d, t or "") for d, t in odd), key=str)
    assert pieces.encode_texts(frame(spark, [])).count() == 0


def test_digest(spark, odd, model):
    odd = odd + [(70, "a \u2581 of its own")]
    want = []
    for d, t in odd:
        ids = model.encode(t or "").tolist()
        back = model.decode(ids)
        want.append((d, len(ids), ids, hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
    got = [(r.doc_id, r.n_ids, list(r.ids), r.decoded_sha256, r.same_text) for r in pieces.piece_digest(frame(spark, odd)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not all(w[-1] for w in want) and sum(not w[-1] for w in want) == 1
    assert pieces.piece_digest(frame(spark, [])).count() == 0
