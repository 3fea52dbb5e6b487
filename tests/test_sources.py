"""Scans of small files in every layout, with the faults they must report."""

import hashlib
import json
import math

import numpy as np
import pytest

from locusmill.operators.checks import CheckFailed
from locusmill.sources import bed, store, text


def put(folder, name, content):
    path = folder / name
    path.write_text(content)
    return str(path)


def test_bim_fam_map(spark, tmp_path):
    bim = text.scan_bim(spark, put(tmp_path, "a.bim", "1 m1 0.5 100 A G\n\n X  m2\t0 7 C T\n")).orderBy("marker_idx").collect()
    assert [tuple(r) for r in bim] == [(0, "1", "m1", 0.5, 100, "A", "G"), (1, "X", "m2", 0.0, 7, "C", "T")]
    path = put(tmp_path, "a.fam", "f i 0 0 1 -9\ns s 0 0 2 -9\n")
    assert [r.sample_id for r in text.scan_fam(spark, path).orderBy("sample_idx").collect()] == ["f_i", "s_s"]
    assert [r.sample_id for r in text.scan_fam(spark, path, "individual").orderBy("sample_idx").collect()] == ["i", "s_s"]
    assert text.scan_map(spark, put(tmp_path, "m.map", "1 m1 0.1 55\n")).first().pos == 55


def test_dosage_table(spark, tmp_path):
    path = put(tmp_path, "d.txt", "Id m0 m1 m2\ns1 0 1 2\ns2 3 NA .\n")
    got = {(r.sample_id, r.marker_id): r.dosage for r in text.scan_dosage_table(spark, path).collect()}
    assert got[("s1", "m2")] == 2 and [got[("s2", f"m{i}")] for i in range(3)] == [None] * 3
    for name, body, message in [
        ("w.txt", "Id m0 m1\ns1 0\n", "wrong number of calls"), ("c.txt", "Id m0\ns1 7\n", "unknown dosage"),
        ("t.txt", "Id m0\ns1 x\n", "unknown dosage"),
    ]:
        with pytest.raises(Exception, match=message):
            text.scan_dosage_table(spark, put(tmp_path, name, body)).collect()
    with pytest.raises(CheckFailed, match="duplicate"):
        text.scan_dosage_table(spark, put(tmp_path, "u.txt", "Id m0\ns1 0\ns1 1\n"))


def test_compact_calls(spark, tmp_path):
    path = put(tmp_path, "c.txt", "a 0125\nb 11 11\nc 2222\n")
    wanted = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = {(r.sample_id, r.marker_idx): r.dosage for r in text.scan_compact_calls(spark, path, 4, wanted).collect()}
    assert [got[("a", i)] for i in range(4)] == [0, 1, 2, None] and len(got) == 8
    with pytest.raises(CheckFailed, match="missing"):
        text.scan_compact_calls(spark, path, 4, spark.createDataFrame([("z",)], "sample_id string"))
    with pytest.raises(Exception, match="wrong call length"):
        text.scan_compact_calls(spark, path, 5).collect()
    with pytest.raises(Exception, match="unknown call"):
        text.scan_compact_calls(spark, put(tmp_path, "x.txt", "a 0129\n"), 4).collect()
    with pytest.raises(CheckFailed, match="duplicate"):
        text.scan_compact_calls(spark, put(tmp_path, "d.txt", "a 01\na 11\n"), 2)


def test_annotation(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "Id\tAllele1\tAllele2\tMAF\nm1\ta\tg\t0.1\n")
    columns = {"marker_id": "Id", "a1": "Allele1", "a2": "Allele2"}
    assert tuple(text.scan_marker_annotation(spark, path, columns).first()) == ("m1", "A", "G")
    with pytest.raises(CheckFailed, match="lacks"):
        text.scan_marker_annotation(spark, path, {"marker_id": "Id", "chrom": "Chromosome"})
    with pytest.raises(CheckFailed, match="duplicate"):
        text.scan_marker_annotation(spark, put(tmp_path, "b.csv", "Id,A\nm,1\nm,2\n"), {"marker_id": "Id"}, ",")


def test_phenotypes_and_sniffing(spark, tmp_path):
    path = put(tmp_path, "p.tsv", "sample_id\tBW\tLE\na\t1.5\tNA\nb\tNaN\t2\n")
    got = {r.sample_id: (r.BW, r.LE) for r in text.scan_phenotypes(spark, path, ["BW", "LE"]).collect()}
    assert got == {"a": (1.5, None), "b": (None, 2.0)}
    for body in ("sample_id\tBW\n", "sample_id\tBW\na\tx\n", "sample_id\tLE\na\t1\n"):
        with pytest.raises(CheckFailed):
            text.scan_phenotypes(spark, put(tmp_path, f"q{len(body)}.tsv", body), ["BW"])
    names = {"sample_id": ["id"], "survival": ["SL", "survival"]}
    for name, body in [("w.txt", "ID SL\na 1\n"), ("c.txt", "ID,Survival\na,1\n")]:
        assert tuple(text.scan_sniffed_table(spark, put(tmp_path, name, body), names).first()) == ("a", "1")
    with pytest.raises(CheckFailed):
        text.scan_sniffed_table(spark, put(tmp_path, "n.txt", "ID other\na 1\n"), names)


def test_genes_ids_folds_context(spark, tmp_path):
    lengths, genes = text.scan_gene_annotation(
        spark, put(tmp_path, "g.bed", "1\t0\t100\tchromosome\n1\t5\t9\tgene-a\n1\t5\t9\tother\n"))
    assert [tuple(r) for r in lengths.collect()] == [("1", 100)] and [tuple(r) for r in genes.collect()] == [("1", 5, 9)]
    ids = put(tmp_path, "ids.txt", " b \n\na\n")
    assert [r.sample_id for r in text.scan_id_list(spark, ids, 2).orderBy("ord").collect()] == ["b", "a"]
    with pytest.raises(CheckFailed):
        text.scan_id_list(spark, ids, 3)
    with pytest.raises(CheckFailed, match="duplicate"):
        text.scan_id_list(spark, put(tmp_path, "dup.txt", "a\na\n"))
    for seed in (1, 2):
        put(tmp_path, f"cv_splits_{seed}.csv", f"fold,sample_id,split\n0,s{seed},train\n")
    assert sorted(tuple(r) for r in text.scan_folds(spark, f"{tmp_path}/cv_splits_*.csv").collect()) == [
        (1, 0, "s1", "train"), (2, 0, "s2", "train")]
    folder = tmp_path / "pca" / "seed_3" / "fold_4"
    folder.mkdir(parents=True)
    put(folder, "pca_scores.csv", "sample_id,split,PC1,PC2\na,val,0.5,-1\n")
    got = text.scan_context(spark, f"{tmp_path}/pca/*/*/pca_scores.csv", 2).first()
    assert (got.seed, got.fold, got.sample_id, got.pcs) == (3, 4, "a", [0.5, -1.0])
    with pytest.raises(CheckFailed):
        text.scan_context(spark, f"{tmp_path}/pca/*/*/pca_scores.csv", 3)


def test_manifest_and_binding(spark, tmp_path):
    body = {"seed": 1, "fold": 0, "fit_IDs": ["a", "b", "c"], "algorithm": {"k": 8}, "files_SHA256": {"x": "00"}}
    put(tmp_path, "m.json", json.dumps(body, indent=1)[:-1] + ', "missing_values": NaN}')
    manifests = text.scan_manifest_json(spark, f"{tmp_path}/m.json")
    row = manifests.first()
    assert row.algorithm.k == 8 and math.isnan(row.missing_values) and row.file_path.endswith("m.json")
    listed = text.manifest_ids(manifests, "fit_IDs")
    expected = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate("acb")], "seed long, fold long, ord int, sample_id string")
    assert sorted(r.ord for r in text.binding_check(listed, expected).collect()) == [1, 2]


def packed(codes, n):
    width = -(-n // 4)
    full = np.zeros((len(codes), width * 4), dtype=np.uint8)
    full[:, :n] = codes
    quads = full.reshape(len(codes), width, 4)
    return bed.MAGIC + (quads << (np.arange(4, dtype=np.uint8) * 2)).sum(axis=2).astype(np.uint8).tobytes()


@pytest.mark.parametrize("n", [1, 4, 7, 10])
def test_packed_calls(spark, tmp_path, n):
    codes = np.random.default_rng(n).integers(0, 4, (23, n))
    path = tmp_path / "c.bed"
    path.write_bytes(packed(codes, n))
    for allele, table in ((2, [0, None, 1, 2]), (1, [2, None, 1, 0])):
        rows = bed.scan_bed(spark, str(path), n, allele, 4).orderBy("marker_idx").collect()
        assert [r.codes for r in rows] == [[table[c] for c in row] for row in codes]
    part = bed.scan_bed(spark, str(path), n, 2, 4)
    assert [r.marker_idx for r in part.where("marker_idx >= 20").orderBy("marker_idx").collect()] == [20, 21, 22]
    assert sorted(r.marker_idx for r in part.where("marker_idx IN (3, 17, 99)").collect()) == [3, 17]
    assert part.where("marker_idx < 8 AND marker_idx > 2").count() == 5
    assert part.where("marker_idx = 5").count() == 1 and part.where("marker_idx > 90").count() == 0


def test_filter_reaches_the_reader(spark, tmp_path):
    codes = np.zeros((40, 4), dtype=np.uint8)
    path = tmp_path / "c.bed"
    path.write_bytes(packed(codes, 4))
    whole = bed.scan_bed(spark, str(path), 4, 2, 4)
    assert whole.rdd.getNumPartitions() == 10
    assert whole.where("marker_idx >= 32").rdd.getNumPartitions() == 2


def test_packed_faults(spark, tmp_path):
    good = packed(np.zeros((3, 5), dtype=np.uint8), 5)
    for name, data, message in [("m", b"\x00" + good[1:], "packed call file"), ("t", good[:-1], "truncated")]:
        path = tmp_path / name
        path.write_bytes(data)
        with pytest.raises(Exception, match=message):
            bed.scan_bed(spark, str(path), 5, 2).collect()
    with pytest.raises(ValueError, match="count_allele"):
        bed.scan_bed(spark, str(tmp_path / "m"), 5, 3)
    fam = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "sample_idx int, sample_id string")
    path = tmp_path / "g"
    path.write_bytes(good)
    wanted = spark.createDataFrame([("s3",)], "sample_id string")
    assert bed.bed_calls(bed.scan_bed(spark, str(path), 5, 1), fam, wanted).count() == 3


def test_store(spark, tmp_path):
    calls = spark.createDataFrame([(s, m, (s + m) % 3) for s in range(20) for m in range(10)], "sample_id long, marker_idx long, dosage int")
    markers = spark.createDataFrame([(m, str(m % 2)) for m in range(10)], "marker_idx long, chrom string")
    path = str(tmp_path / "store")
    store.sink_calls(calls, markers, path, 4)
    back = store.scan_calls(spark, path)
    assert back.count() == 200 and back.where("chrom = '1'").count() == 100
    subset = store.scan_calls(spark, path, [3, 4])
    assert subset.count() == 40
    plan = subset._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(marker_idx" in plan
    with pytest.raises(Exception):
        store.sink_calls(calls, markers, path)


def test_table_round_trip(spark, tmp_path):
    values = [0.1 + 0.2, 1e-17, 123456789.123456789]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    store.sink_table(df, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), header=True, schema="i int, v double").orderBy("i").collect()
    assert [r.v for r in back] == values
    with pytest.raises(Exception):
        store.sink_table(df, str(tmp_path / "t"))


def test_file_hashes(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in "abc":
        (folder / name).write_bytes(name.encode())
    digest = {n: hashlib.sha256(n.encode()).hexdigest() for n in "abc"}
    expected = spark.createDataFrame([("a", digest["a"]), ("b", digest["a"]), ("d", digest["a"])], "name string, sha256 string")
    bad = store.verify_file_manifest(spark, str(folder), expected)
    assert sorted(r.name for r in bad.collect()) == ["b", "c", "d"]


def test_packed_scan_in_a_plain_session(spark):
    """Without the setting for filters of Python sources the scan still works, and takes a marker range."""
    from locusmill.plans.session import scratch_path
    from locusmill.sources import bed
    from locusmill.sources.packed_sink import sink_packed

    calls = spark.range(40).selectExpr("id % 10 AS sample_idx", "id div 10 AS marker_idx", "cast(id % 3 AS int) AS dosage")
    path = scratch_path(spark, "plain").removeprefix("file:")
    sink_packed(calls, 10, 4, path, partitions=3)
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        assert bed.scan_bed(spark, path, 10, 2).where("marker_idx >= 1").count() == 3
        assert [r[0] for r in bed.scan_bed(spark, path, 10, 2, markers=(1, 3)).select("marker_idx").collect()] == [1, 2]
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("n_samples, count_allele", [(10, 2), (9001, 1)])
def test_packed_store_round_trip(spark, tmp_path, n_samples, count_allele):
    """Calls over several chunks and parts come back; absent and NULL calls are missing."""
    from locusmill.sources import bed
    from locusmill.sources.packed_sink import sink_packed

    calls = spark.range(7 * n_samples).selectExpr(
        f"id % {n_samples} AS sample_idx", f"id div {n_samples} AS marker_idx",
        "CASE WHEN id % 5 < 3 THEN cast(id % 5 AS int) END AS dosage").where("marker_idx <> 4 AND sample_idx % 7 <> 3")
    path = str(tmp_path / "store")
    sink_packed(calls, n_samples, 7, path, count_allele, partitions=3)
    assert len(list((tmp_path / "store").glob("*.bed"))) > 1
    rows = {r.marker_idx: r.codes for r in bed.scan_bed(spark, path, n_samples, count_allele, 2).collect()}
    wanted = {(r.marker_idx, r.sample_idx): r.dosage for r in calls.collect()}
    assert sorted(rows) == list(range(7))
    assert all(rows[m] == [wanted.get((m, s)) for s in range(n_samples)] for m in rows)
    assert [r[0] for r in bed.scan_bed(spark, path, n_samples, count_allele).where("marker_idx IN (1, 5)").select("marker_idx").collect()] == [1, 5]
    with pytest.raises(Exception, match="exists"):
        sink_packed(calls, n_samples, 7, path, count_allele)
    with pytest.raises(Exception, match="n_samples"):
        bed.scan_bed(spark, path, n_samples + 1, count_allele).count()


@pytest.mark.parametrize("extra, what", [((3, 2, 1), "two calls"), ((10, 0, 1), "out of range"), ((0, 9, 1), "out of range"), ((0, 0, 3), "out of range")])
def test_packed_store_leaves_nothing_behind(spark, tmp_path, extra, what):
    """A job that fails in one task publishes nothing and removes the files of the others."""
    from locusmill.sources import bed
    from locusmill.sources.packed_sink import sink_packed

    schema = "sample_idx long, marker_idx long, dosage int"
    calls = spark.createDataFrame([(s, m, 1) for s in range(10) for m in range(8) if (s, m) != (0, 0)] + [extra], schema)
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match=what):
        sink_packed(calls, 10, 8, path, partitions=4)
    assert not list((tmp_path / "store").glob("*"))
    with pytest.raises(Exception, match="manifest"):
        bed.scan_bed(spark, path, 10, 2).count()


def test_packed_store_drops_files_of_lost_attempts(tmp_path):
    from locusmill.sources.packed_sink import PackedWriter, WrittenPart

    options = {"path": str(tmp_path), "n_samples": "4", "n_markers": "2", "count_allele": "2"}
    writer = PackedWriter(options)
    for name in ("a", "b"):
        (tmp_path / f"{writer.run}-{name}.bed").write_bytes(b"")
    with pytest.raises(ValueError, match="2 markers"):
        writer.commit([WrittenPart(f"{writer.run}-a.bed", 0, 1), None])
    writer.commit([WrittenPart(f"{writer.run}-a.bed", 0, 2), WrittenPart(None, 0, 0)])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([f"{writer.run}-a.bed", "manifest.json"])


def _export_tables(spark, calls=((2, 5, 1), (2, 9, 2), (10, 7, 0), (10, 9, None))):
    return (
        spark.createDataFrame(list(calls), "sample_id long, marker_idx long, dosage int"),
        spark.createDataFrame([(9, "c"), (5, "a"), (7, "b")], "marker_idx long, marker_id string"),
        spark.createDataFrame([(10, 0.1, None), (2, 1 / 3, 2.0), (3, 1e-300, 0.0)], "sample_id long, y double, z double"),
    )


def test_export_dosage(spark, tmp_path):
    from locusmill.sources import store

    path = str(tmp_path / "out")
    header = store.export_dosage(*_export_tables(spark), path)
    lines = lambda part: [r.value for r in spark.read.text(f"{path}/{part}").collect()]
    assert header == "sample_id,a,b,c" and lines("header") == [header]
    assert sorted(lines("dosage")) == ["10,,0,", "2,1,,2", "3,,,"]
    assert sorted(lines("sample_ids")) == ["10", "2", "3"]
    back = spark.read.option("header", True).schema("sample_id long, y double, z double").csv(f"{path}/phenotypes")
    assert sorted(tuple(r) for r in back.collect()) == [(2, 1 / 3, 2.0), (3, 1e-300, 0.0), (10, 0.1, None)]
    with pytest.raises(Exception, match="(?i)exists"):
        store.export_dosage(*_export_tables(spark), path)


@pytest.mark.parametrize("calls, what", [
    ([(2, 5, 1), (2, 5, 1)], "duplicate call"), ([(4, 5, 1)], "unknown sample"),
    ([(2, 6, 1)], "unknown marker"), ([(2, 5, 3)], "unknown dosage"),
])
def test_export_refuses(spark, tmp_path, calls, what):
    from locusmill.sources import store

    with pytest.raises(Exception, match=what):
        store.export_dosage(*_export_tables(spark, calls), str(tmp_path / "out"))
