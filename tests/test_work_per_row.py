"""Work that once grew with the square of a row's length, a group or a neighbourhood."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.operators import align, graph, hydro, quantiles
from pluvion.plans import risk
from pluvion.sources import zonetext


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


def test_zone_cells_carry_no_lines(spark):
    """a cell of a zone line holds the file and the day, not the whole line."""
    lines = spark.createDataFrame([("a/rain.txt", 0, "NA,4,x,6"), ("a/rain.txt", 1, "2024001,1.5,,7,8"), ("a/rain.txt", 2, "2024002")], "file string, pos int, value string")
    cells = zonetext.parse_zone_lines(lines)
    carried = re.findall(r"Generate .*\[(file#[^\]]*)\], false", plan(cells))
    assert carried and not any("_parts" in c or "_ids" in c for c in carried)
    assert sorted((r.julian, r.zone_id, r.value) for r in cells.collect()) == [("2024001", 4, 1.5), ("2024001", 6, 0.0)]


def test_river_summary_lists_its_members(spark):
    """F3"""
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "node long, next long")
    point = "struct<lon: double, lat: double>"
    seg = edges.select(F.col("node").alias("linkno"), F.lit(1).alias("stream_order"), F.expr(f"array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 1D, 'lat', 0D))").cast(f"array<{point}>").alias("coords"))
    out = graph.river_summary(seg, edges, graph.trace_chains(edges.withColumn("pos", F.col("node")), "pos"))
    assert sorted(r.all_linknos for r in out.collect()) == ["3;2;1", "4"]


def test_hydrograph_expressions_are_worked_out_once(spark):
    """F5"""
    df = spark.createDataFrame([(20.0,)], "area double")
    shape = hydro.triangle("fixed", hydro.concentration_hours(F.col("area")), 0.5)
    assert str(shape).lower().count("power(") == 1
    flow = [float(i % 5) for i in range(48)]
    row = df.select(shape.alias("u"), hydro.convolve_arrays(F.array(*map(F.lit, flow)), shape).alias("q")).head()
    assert row.q == pytest.approx(list(np.convolve(flow, row.u)[:48])) and sum(row.u) == pytest.approx(1.0)
    ends = df.select(hydro.convolve_arrays(F.array(F.lit(2.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("q")).head().q
    assert ends == [0.0, 0.0]


def test_forcing_sums_nothing_over_targets_and_steps(spark):
    """F6"""
    rows = [(r, c, day, float(10 * r + c + day) if (r, c, day) != (0, 1, 2) else None) for r in range(3) for c in range(3) for day in (1, 2) if (r, c, day) != (2, 2, 1)]
    grid = spark.createDataFrame(rows, "row int, col int, day int, value double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.25, 0.75), (3, 1.5, 1.5), (4, 1.0, 1.0)], "id int, lat double, lon double")
    out = align.apply_weights(grid, align.bilinear_weights(pts, "id", 0.0, 0.0, 1.0, 3, 3), "id", ["value"], ["day"])
    assert "sum(" not in plan(out)
    want = {(1, 1): 6.5, (1, 2): None, (2, 1): 4.25, (2, 2): None, (3, 1): None, (3, 2): 18.5, (4, 1): 12.0, (4, 2): 13.0}
    assert {(r.id, r.day): r.value for r in out.collect()} == pytest.approx(want)


def test_crop_evidence_is_worked_out_once():
    """F7, F9, F10"""
    crop = str(risk.infer_crop(F.col("water"), F.col("leafy"), F.col("phase")))
    assert (crop.count("water"), crop.count("leafy")) == (1, 1)
    agri = str(risk.agricultural_risk(F.col("met"), F.col("cropped")))
    assert (agri.count("met"), agri.count("cropped")) == (1, 1)


def test_peaks_write_no_pairs(spark, monkeypatch):
    """F8"""
    draw = random.Random(4)
    points = [(r, c, float(draw.randrange(200))) for r in range(25) for c in range(25)]
    written, cut = [], graph.cut_lineage

    def counted(df):
        made = cut(df)
        written.append(made.count())
        return made

    monkeypatch.setattr(graph, "cut_lineage", counted)
    got = {(r.row, r.col) for r in graph.suppress_neighbours(spark.createDataFrame(points, "row long, col long, acc double"), "acc", 5).collect()}
    want = []
    for r, c, _ in sorted(points, key=lambda p: (-p[2], p[0], p[1])):
        if all(abs(r - a) > 5 or abs(c - b) > 5 for a, b in want):
            want.append((r, c))
    assert got == set(want) and max(written) <= len(points)
    twice = spark.createDataFrame([(1, 1, 5.0), (1, 1, 7.0)], "row long, col long, acc double")
    with pytest.raises(RuntimeError):
        graph.suppress_neighbours(twice, "acc", 5)


def test_buckets_are_found_by_halving(spark, monkeypatch):
    """no pass over the cuts for every row."""
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 1)
    df = spark.range(700).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 701).cast("double").alias("v"))
    out = quantiles.with_value_buckets(df, ["k"], "v")
    assert not re.search(r"\bfilter\(_cuts|\bfilter\(slice\(_cuts", plan(out))
    rows = sorted((r.k, r.v, r._bucket) for r in out.collect())
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0]) and len({r[2] for r in rows}) > 300
