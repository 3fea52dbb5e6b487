"""A trailing tag is told from a payload that begins like one."""

import pytest
from brute import payload
from text_cases import frame

from locusmill.llm import mpeg

TAG = b"TAG" + b"name".ljust(30, b"\0") + b"who".ljust(30, b"\0") + bytes(65)


@pytest.mark.parametrize("units", [1, 2, 3, 5, 6, 7])
def test_text_with_tag_in_its_last_unit(spark, units):
    text = "x" * (192 * (units - 1) + 89) + "TAG" + "Y" * 100
    row = mpeg.media_columns(frame(spark, [(1, text)])).first()
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == payload(text)
    assert "skipped=0" in row.feature


@pytest.mark.parametrize("units", [1, 4, 5])
def test_real_tag(units):
    data = mpeg.write(b"z" * 192 * units)
    found = mpeg.parse(data + TAG)
    assert found.tags["TPE1"] == "who" and mpeg.payload_of(data + TAG, found) == b"z" * 192 * units
    assert found.skipped == 0 and found.bad_checks == 0
    for junk in (b"junk" * 5, b"\xff\xfa" * 9):
        assert mpeg.parse(data + junk + TAG).tags["TPE1"] == "who"
    cut = data + data[-240:][:180] + TAG  # a last frame that was cut off
    assert mpeg.parse(cut).tags["TPE1"] == "who"
    assert mpeg.parse(TAG).tags["TIT2"] == "name" and mpeg.parse(TAG).skipped == 0
