"""Files written and read back, snapshots, and streams that run twice."""

import json

import pytest
from pyspark.sql import functions as F

from pluvion.schema import LEAN_LONG
from pluvion.sources import lean, manifest, vector, zonetext
from pluvion.streaming import ingest


def _lean(spark, rows):
    return spark.createDataFrame([(g, z, 1, v, m, p, s) for g, z, v, m, p, s in rows], LEAN_LONG)


def test_zone_files_round_trip(spark, tmp_path):
    header = spark.createDataFrame([("zone1", 0, 44), ("zone1", 1, 46), ("zone1", 2, 50), ("zone2", 0, 7)], "zone string, pos int, gridcode int")
    values = spark.createDataFrame(
        [("zone1", 0, "2024001", 1.25), ("zone1", 2, "2024001", 0.35), ("zone1", 1, "2024003", -2.0), ("zone2", 0, "2024002", 9.96)],
        "zone string, pos int, julian string, value double",
    )
    size = header.groupBy("zone").agg(F.count("*").cast("int").alias("size"))
    path = str(tmp_path / "zones")
    zonetext.write_zone_files(zonetext.header_lines(header), zonetext.zone_lines(values, size), path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "zones" / "zone=zone1").glob("*.txt")))
    assert text.splitlines() == ["NA,44,46,50", "2024001,1.2,0,0.3", "2024003,0,0,0"]
    back = zonetext.parse_zone_lines(zonetext.read_lines(spark, path + "/*"))
    got = {(r.julian, r.zone_id): r.value for r in back.collect()}
    assert got[("2024001", 44)] == 1.2 and got[("2024003", 46)] == 0.0 and got[("2024002", 7)] == 10.0 and len(got) == 7


def test_zone_text_oddities(spark, tmp_path):
    (tmp_path / "rain.txt").write_text("NA,1,2,3\n\n2024001,5,NA,x\n2024002,1\n2024003,1,2,3,4\n2024001,7,8,9\n")
    (tmp_path / "evap.txt").write_text("time,1\n2024001,5\n")
    out = zonetext.zone_lines_to_lean(zonetext.read_lines(spark, str(tmp_path)), "20260101T00", "20260101")
    got = {(r.gtime, r.zone_id): r.mean_value for r in out.collect()}
    assert got == {
        ("20240101T00", 1): 7.0, ("20240101T00", 2): 8.0, ("20240101T00", 3): 9.0,
        ("20240102T00", 1): 1.0, ("20240102T00", 2): 0.0, ("20240102T00", 3): 0.0,
        ("20240103T00", 1): 1.0, ("20240103T00", 2): 2.0, ("20240103T00", 3): 3.0,
    }
    assert {r.variable for r in out.collect()} == {1}


def test_header_skips_what_is_no_id(spark, tmp_path):
    (tmp_path / "rain.txt").write_text("NA,44,NA,46\n2024001,1,2,3\n")
    rows = zonetext.parse_zone_lines(zonetext.read_lines(spark, str(tmp_path))).collect()
    assert {r.zone_id: r.value for r in rows} == {44: 1.0, 46: 2.0}


def test_large_file_keeps_its_header(spark, tmp_path):
    """Splitting a file into many read tasks must not lose the first line."""
    lines = ["NA,1,2"] + [f"{2000000 + i // 366 * 1000 + i % 366 + 1},{i},{i + 1}" for i in range(4000)]
    (tmp_path / "rain.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = zonetext.parse_zone_lines(zonetext.read_lines(spark, str(tmp_path)))
        assert rows.count() == 8000
        assert rows.where("zone_id = 2 AND julian = '2000001'").head().value == 1.0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_model_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("time,9,10\n2024-01-02,1,abc\n20240103,0,4\n1/4/2024,5\n\n")
    got = {(r.gtime, r.zone_id): r.value for r in zonetext.parse_model_lines(zonetext.read_lines(spark, str(tmp_path))).collect()}
    assert got == {("20240102T00", "9"): 1.0, ("20240103T00", "9"): 0.0, ("20240103T00", "10"): 4.0}


def test_lean_snapshots(spark, tmp_path):
    rows = [("20240101T00", 1, 1, 2.0, "20240102T00", "20240101"), ("20240101T00", 1, 9, 2.0, "20240102T00", "20240101")]
    first = lean.append_snapshot(spark, _lean(spark, rows + rows), None, str(tmp_path / "a"))
    assert first.count() == 2
    rerun = [(g, z, v, m, "20240103T00", s) for g, z, v, m, _, s in rows]
    second = lean.append_snapshot(spark, _lean(spark, rows + rerun), str(tmp_path / "a"), str(tmp_path / "b"))
    assert second.count() == 4
    key = ["gtime", "zone_id", "variable", "source_date"]
    assert lean.append_snapshot(spark, _lean(spark, rerun), str(tmp_path / "a"), str(tmp_path / "c"), key).count() == 2
    with pytest.raises(ValueError):
        lean.append_snapshot(spark, first, str(tmp_path / "a"), str(tmp_path / "a"))
    path = lean.write_csv(second, str(tmp_path / "csv"), "20260101_0000")
    assert lean.read_csv(spark, path).count() == 2
    lean.write_parquet(second, str(tmp_path / "p"), ["variable", "source_date"])
    assert lean.read_parquet(spark, str(tmp_path / "p")).count() == 4
    with pytest.raises(ValueError):
        lean.normalise(second.drop("mean_value"))


def test_feature_files(spark, tmp_path):
    feats = [
        {"type": "Feature", "properties": {"linkno": 1, "stream_order": 2}, "geometry": {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 1.5]]}},
        {"type": "Feature", "properties": {"linkno": 2, "stream_order": 5}, "geometry": {"type": "MultiLineString", "coordinates": [[[0.0, 0.0]], [[2.0, 2.0], [3.0, 3.0]]]}},
        {"type": "Feature", "properties": {"linkno": 3, "stream_order": 5}, "geometry": {"type": "Point", "coordinates": [0.0, 0.0]}},
    ]
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}, indent=1))
    seg = vector.read_feature_collections(spark, str(tmp_path / "r.geojson"))
    got = {r.linkno: [tuple(p) for p in r.coords] for r in seg.collect()}
    assert got == {1: [(0.0, 0.0), (1.0, 1.5)], 2: [(0.0, 0.0), (2.0, 2.0), (3.0, 3.0)]}
    vector.write_features(vector.segments_to_features(seg.withColumn("n", F.lit(1)), "n"), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.txt") for x in p.read_text().splitlines()]
    assert {f["properties"]["linkno"] for f in lines} == {1, 2}


def test_manifest_helpers(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "name string, size int")
    b = spark.createDataFrame([("x", 1), ("y", 5)], "name string, size int")
    assert {r.name: r.status for r in manifest.manifest_status(a, b).collect()} == {"x": "skip", "y": "upload", "z": "upload"}
    years = spark.createDataFrame([("fc_2019_run",), ("none",)], "f string").select(manifest.infer_year(F.col("f")).alias("y"))
    assert [r.y for r in years.collect()] == [2019, None]


def test_stream_append_is_idempotent(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [("20240101T00", i, 1, float(i), "p", "20240101") for i in range(5)]
    _lean(spark, rows).coalesce(1).write.parquet(src)
    read = lambda: ingest.file_stream(spark, src, LEAN_LONG)
    ingest.append_new_rows(read(), table, str(tmp_path / "c1"), ["source_date"]).awaitTermination()
    _lean(spark, rows[:2] + [("20240102T00", 9, 1, None, "p", "20240102")]).coalesce(1).write.mode("append").parquet(src)
    ingest.append_new_rows(read(), table, str(tmp_path / "c1"), ["source_date"]).awaitTermination()
    assert spark.read.parquet(table).count() == 6
    ingest.append_new_rows(read(), table, str(tmp_path / "c2"), ["source_date"]).awaitTermination()
    assert spark.read.parquet(table).count() == 6
