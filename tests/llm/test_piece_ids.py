import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from locusmill.llm import packing, piece_ids

SIGNS = [*" '  \n\t\r'abstrevlmd'9é²ñµª×!?.<|­À´", "'s", "'re", "'ll", " '", "  ", " the", " of"]
OTHERS = ["日", "\x00", "<|endoftext|>", "ɏ", "ɐ", "\xa0", "🙂", " "]


def ids_of(rows):
    return [ids.tolist() for ids in piece_ids.piece_ids(packing.byte_bpe_paths())(pa.array(rows, pa.string()))]


def wanted(rows):
    slow = Tokenizer.from_file(packing.byte_bpe_paths()[0])
    return [slow.encode(text or "", add_special_tokens=False).ids for text in rows]


def drawn(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(SIGNS + OTHERS * (rng.random() < 0.2), k=rng.randint(0, 14))) for _ in range(n)]
    return [None, "", *texts, "", None]


def test_ids_are_the_librarys():
    rows = drawn(4000, 1)
    assert ids_of(rows) == wanted(rows)


@pytest.mark.parametrize("part, group", [(1, 1), (7, 40), (40, 7), (64, 1 << 20)])
def test_any_sizes_of_parts(monkeypatch, part, group):
    monkeypatch.setattr(piece_ids, "PART", part)
    monkeypatch.setattr(piece_ids, "GROUP", group)
    rows = drawn(300, 2)
    assert ids_of(rows) == wanted(rows)


def test_short_forms_and_white_space_at_the_ends_of_texts():
    rows = ["'", "s", "'r", "e", " ", "a", "x\n", "'s", "''s", " 's", "\n's", "'s's", "'sre", "'re're", "5'll'", "l", "\n\n a", "a \n", "é", "'é", "<", "|"]
    assert ids_of(rows) == wanted(rows)
    assert ids_of([]) == [] and ids_of([None, ""]) == [[], []]


def test_a_slice_of_a_column():
    rows = drawn(50, 3)
    got = piece_ids.piece_ids(packing.byte_bpe_paths())(pa.array(rows, pa.string())[7:31])
    assert [ids.tolist() for ids in got] == wanted(rows[7:31])


def test_distinct_pieces_are_merged_once():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 12)) for _ in range(300)]
    rows = [" ".join(words[k] for k in rng.integers(0, 300, 200)) for _ in range(100)]
    known = piece_ids.piece_ids(packing.byte_bpe_paths())
    asked = []
    counted = piece_ids.PieceIds(lambda text: asked.append(len(text)) or known.encode(text), known.width)
    assert [ids.tolist() for ids in counted(pa.array(rows))] == wanted(rows)
    assert sum(asked) <= 2 * 300 * 13  # with a space and without; the texts have 260,000 characters
