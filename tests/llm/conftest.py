import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from text_cases import ODD_TEXTS, SF


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of the smallest documents table."""
    table = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, repeated rows, a NULL id, and ids that occur twice."""
    rows = [(10 * i, t) for i, t in enumerate(ODD_TEXTS)]
    return rows + [(None, "same line of words\n" * 40), (50, "same line of words\n" * 40), (50, "other text under a known id"), (60, None)]
