"""Substring removal, quality statistics and media columns against plain Python."""

import numpy as np
import pytest
from brute import payload, stats, substring
from text_cases import SF, frame

from locusmill.llm import mpeg, queries, rules
from locusmill.llm import substring as sub


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("kind", ["small", "odd"])
def test_substring(spark, request, kind):
    docs = request.getfixturevalue(kind)
    out = sub.substring_digest(frame(spark, docs))
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(substring(docs), key=str)


def test_substring_lengths(spark, small):
    out = sub.substring_dedup(frame(spark, small), length=6, seed_words=2)
    assert rows(out, "doc_id", "n_words", "n_removed") == sorted((r[:3] for r in substring(small, 6)), key=str)


def test_maximal_repeats(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(base)), (2, " ".join(["a", "b", *base[10:40], "c"])), (3, "no repeat here")]
    out = sub.maximal_repeats(frame(spark, docs))
    assert rows(out, "doc_id", "start_word", "end_word", "source_id", "source_start") == [(2, 2, 32, 1, 10)]


@pytest.mark.parametrize("kind", ["small", "odd"])
def test_stats(spark, request, kind):
    docs = request.getfixturevalue(kind)
    out = rules.text_stats(frame(spark, docs))
    assert rows(out, "doc_id", *rules.STATS) == sorted(((d, *stats(t)) for d, t in docs), key=str)


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sub.substring_digest(none).count() == 0
    assert mpeg.media_columns(none).count() == 0
    assert rules.quality_digest(none, labels).count() == 0


def test_rules_learned():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = ((x[:, 2] > 0.8) & (x[:, 4] > 0.3)) | (x[:, 6] > 0.95)
    found = rules.learn_rules(x, bad)
    hit = np.any([r.holds(x) for r in found], axis=0)
    assert (hit == bad).mean() > 0.97 and hit[~bad].mean() < 0.02
    assert rules.learn_rules(x[:0], bad[:0]) == [] and rules.learn_rules(x, np.zeros(3000, bool)) == []


def test_rules_on_held_out_labels(spark):
    """Rules from half of the labels judge the other half, as numbers and as a Spark expression alike."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet").select("doc_id", "quality")
    found = rules.fit_rules(docs, labels.where("doc_id % 2 = 0"))
    held = rules.quality(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), found, keep=("doc_id", "quality"))
    table = held.select("quality", "kept", "base_failed").toPandas()
    judged = table[~table.base_failed]
    good, poor = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() > 0.98 and poor.kept.mean() < 0.3


def test_rule_query(spark, small):
    out = queries.QUERIES["op9_quality_rules"](spark, SF)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {d for d, _ in small}
    for d, t in small:
        n, _, _, _, twice = stats(t)
        assert got[d].base_failed == (n < 50 or 100 * twice > 50 * n)
        assert not (got[d].base_failed and got[d].kept)


@pytest.mark.parametrize("kind", ["small", "odd"])
def test_media(spark, request, kind):
    docs = request.getfixturevalue(kind)
    out = mpeg.media_columns(frame(spark, docs))
    assert rows(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(
        ((d, *payload(t)) for d, t in docs), key=str
    )


def test_stream_survives_damage():
    data = mpeg.write(bytes(range(192)) * 21, "title")
    whole = mpeg.parse(data)
    assert (len(whole.offsets), whole.samples, whole.hertz) == (6, 6 * 1152, 48000)
    assert whole.table["frames"] == 6 and whole.table["bytes"] + whole.offsets[0] - 240 == len(data)
    assert whole.tags == {"TIT2": "title"} and whole.duration_ms == 144 and not whole.skipped
    assert mpeg.payload_of(data, whole) == bytes(range(192)) * 21
    junk = b"\x00\xff\xfb junk" + data[whole.offsets[0]:]
    assert mpeg.parse(junk).samples == whole.samples and mpeg.parse(junk).skipped == 8
    hole = bytearray(data)
    hole[whole.offsets[2] + 10] ^= 1  # side information under the checksum
    assert mpeg.parse(bytes(hole)).bad_checks == 1 and len(mpeg.parse(bytes(hole)).offsets) == 5
    old = data + b"TAG" + b"name".ljust(30, b"\0") + bytes(95)
    assert mpeg.parse(old).samples == whole.samples
    assert mpeg.parse(b"").samples == 0 and mpeg.parse(b"\xff" * 999).offsets == []


def test_headers():
    cbr = mpeg.header(0xFFFB9064)  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz
    assert (cbr.size, cbr.samples, cbr.channels, cbr.protected) == (417, 1152, 2, False)
    assert mpeg.header(0xFFFF9064 & ~0x20000) is not None and mpeg.header(0xFFFBF064) is None
    assert mpeg.header(0x12345678) is None
    assert mpeg.crc16(b"123456789") == 0xAEE7
