"""Operators against brute force on small fixtures."""

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pluvion.functions import formats, statistics
from pluvion.functions.dates import filename_date, julian_to_gtime, mixed_date_to_gtime
from pluvion.operators import align, filters, graph, hydro, polygons, quantiles, temporal, zonal
from pluvion.plans import spi
from pluvion.schema import fill_to_null, missing_to_null, require_columns


def test_hot_group_quantiles_and_medians(spark):
    """One group with most rows, many ties, and tiny groups give exact ranks."""
    rng = np.random.default_rng(3)
    frame = pd.concat(
        [
            pd.DataFrame({"g": 1, "v": rng.normal(size=20000).round(2), "w": rng.random(20000).round(3)}),
            pd.DataFrame({"g": 2, "v": [5.0], "w": [1.0]}),
            pd.DataFrame({"g": 3, "v": [7.0] * 500 + [9.0] * 501, "w": 1.0}),
            pd.DataFrame({"g": 4, "v": [1.0, 2.0], "w": [0.0, 0.0]}),
        ]
    )
    df = spark.createDataFrame(frame)
    probs = [0.0, 0.05, 0.333, 0.5, 0.99, 1.0]
    got = {(r.g, r.q): r.quantile for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, part in frame.groupby("g"):
        for q in probs:
            assert got[(g, q)] == pytest.approx(np.quantile(part.v, q), abs=1e-12)
    med = {r.g: r.median for r in quantiles.weighted_median(df, ["g"], "v", "w").collect()}
    for g, part in frame.groupby("g"):
        part = part.sort_values("v", kind="stable")
        cw = part.w.cumsum().to_numpy()
        want = None if cw[-1] <= 0 else part.v.iloc[int(np.searchsorted(cw.round(9), round(0.5 * cw[-1], 9)))]
        assert med[g] == want


@settings(max_examples=200, deadline=None)
@given(st.floats(min_value=1e-6, max_value=1e7, allow_nan=False))
def test_tenths_round_like_the_binary_value(value):
    a, b = value * 8.0, value * 2.0
    s = a + b
    t = s - a
    err = (a - (s - t)) + (b - t)
    low = math.floor(s)
    up = s - low > 0.5 or (s - low == 0.5 and (err > 0 or (err == 0 and low % 2)))
    n = low + (1 if up else 0)
    assert f"{n // 10}.{n % 10}" == f"{value:.1f}"


def test_zone_value_text(spark):
    values = [0.25, 0.15, 0.35, 0.05, 49.05, 2.5, 0.04, -1.0, 0.0, float("nan"), None, 1234567.85]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", formats.zone_value_text(F.col("v")).alias("t")).collect()}
    for i, v in enumerate(values):
        want = f"{v:.1f}" if v is not None and v > 0 else "0"
        assert got[i] == want
    gauge = df.select(formats.gauge_value_text(F.col("v")).alias("t")).collect()
    assert gauge[9].t == gauge[10].t == "0.0" and gauge[0].t == "0.2"


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (-9999.0, 2.0), (3.0, None)], "a double, b double")
    assert missing_to_null(df).where("a IS NULL").count() == 1
    assert df.select(fill_to_null(F.col("a")).alias("x")).where("x IS NULL").count() == 2
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, ["a", "missing"])


def test_dates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(julian_to_gtime(F.lit("2024060"))) == "20240229T00"
    assert one(mixed_date_to_gtime(F.lit("3/7/2024"))) == "20240307T00"
    assert one(mixed_date_to_gtime(F.lit("3/7/24"))) == "3/7/24T00"
    assert str(one(filename_date(F.lit("et250722.bil")))) == "2025-07-22"
    assert str(one(filename_date(F.lit("data.2025.0628.tif")))) == "2025-06-28"
    assert one(filename_date(F.lit("data.2025.9928.tif"))) is None


def test_gamma_and_normal_functions(spark):
    shapes = [0.3, 1.0, 2.5, 9.0, 80.0]
    rows = [(a, s, x) for a in shapes for s in (0.5, 2.0) for x in (0.01, 0.4, 1.0, 3.0, 20.0, 150.0)]
    df = spark.createDataFrame(rows, "a double, s double, x double")
    for r in statistics.with_gamma_cdf(df, F.col("x"), F.col("a"), F.col("s"), "p").collect():
        top = min(r.x / r.s, 60 + 5 * r.a)
        if r.a < 1:  # substitution t = u^(1/a) removes the pole of the density at 0
            u = np.linspace(0, top**r.a, 400001)
            want = np.trapezoid(np.exp(-(u ** (1 / r.a))), u) / r.a / math.gamma(r.a)
        else:
            t = np.linspace(0, top, 400001)
            logs = (r.a - 1) * np.log(np.maximum(t, 1e-300)) - t - math.lgamma(r.a)
            want = np.trapezoid(np.exp(logs), t)
        assert r.p == pytest.approx(want, abs=2e-5)
    exact = [(k, x, 1 - math.exp(-x) * sum(x**i / math.factorial(i) for i in range(k))) for k in (1, 2, 7, 8, 9, 30) for x in (0.3, 2.0, 7.9, 25.0, 60.0)]
    odd = [(None, 1.0), (0.0, 1.0), (-1.0, 1.0), (2.0, None), (2.0, float("nan")), (2.0, -3.0), (2.0, 0.0), (2.0, 1e308), (2.0, float("inf"))]
    whole = spark.createDataFrame([(float(k), x, w) for k, x, w in exact] + [(a, x, None) for a, x in odd], "a double, x double, w double")
    rows = statistics.with_gamma_cdf(whole, F.col("x"), F.col("a"), F.lit(1.0), "p").collect()
    for r in rows[: len(exact)]:
        assert r.p == pytest.approx(r.w, abs=1e-11)
    assert [None if math.isnan(r.p) else r.p for r in rows[len(exact) :]] == [None] * 5 + [0.0, 0.0, 1.0, 1.0]
    ps = [1e-250, 1e-20, 1e-9, 0.001, 0.02425, 0.3, 0.5, 0.500001, 0.9, 0.97575, 0.999999, 1 - 1e-15]
    q = statistics.with_normal_quantile(spark.createDataFrame([(v,) for v in ps + [0.0, 1.0, None, 2.0]], "p double"), F.col("p"), "z").collect()
    for v, r in zip(ps, q):
        assert r.z == pytest.approx(NormalDist().inv_cdf(v), rel=1e-9, abs=1e-12)
    assert [r.z for r in q[len(ps) : len(ps) + 2]] == [-math.inf, math.inf] and all(math.isnan(r.z) for r in q[-2:])
    z = [-9.0, -7.5, -3.0, -0.5, 0.0, 0.7, 2.0, 6.5, 8.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").withColumn("p", statistics.normal_cdf(F.col("z"))).collect()
    for r in got:
        assert r.p == pytest.approx(NormalDist().cdf(r.z), rel=1e-9, abs=1e-15)


def test_precipitation_index_by_hand(spark):
    rng = random.Random(5)
    values = [round(rng.gammavariate(2.0, 30.0), 3) if rng.random() > 0.1 else 0.0 for _ in range(240)]
    df = spark.createDataFrame([(1, 24000 + i, v) for i, v in enumerate(values)], "cell int, m int, rain double")
    got = {r.m: r.spi for r in spi.index(df, ["cell"], "m", "rain", 3, 24000, 24179).collect()}
    acc = {24000 + i: np.mean(values[i - 2 : i + 1]) for i in range(2, 240)}
    for m in (24002, 24100, 24239):
        same = [v for k, v in acc.items() if k % 12 == m % 12 and k <= 24179]
        wet = [v for v in same if v > 0]
        a = math.log(np.mean(wet)) - np.mean(np.log(wet))
        shape = (1 + math.sqrt(1 + 4 * a / 3)) / (4 * a)
        p0 = 1 - len(wet) / len(same)
        x = acc[m] / (np.mean(wet) / shape)
        g = sum(math.exp((shape + n) * math.log(x) - x - math.lgamma(shape + n + 1)) for n in range(int(x + 40 * math.sqrt(x) + 200)))
        assert got[m] == pytest.approx(NormalDist().inv_cdf(p0 + (1 - p0) * g), abs=1e-9)
    assert got[24000] is None and got[24001] is None
    plan = spi.index(df, ["cell"], "m", "rain", 3, 24000, 24179)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def _greedy(points, distance):
    kept = []
    for r, c, v in sorted(points, key=lambda p: (-p[2], p[0], p[1])):
        if all(abs(r - a) > distance or abs(c - b) > distance for a, b, _ in kept):
            kept.append((r, c, v))
    return kept


def test_neighbour_suppression(spark):
    rng = random.Random(11)
    cells = {(rng.randrange(40), rng.randrange(40)) for _ in range(400)}
    pts = [(r, c, float(rng.randrange(60))) for r, c in cells]
    df = spark.createDataFrame(pts, "row int, col int, acc double")
    got = {(r.row, r.col) for r in graph.suppress_neighbours(df, "acc", 5).collect()}
    want = _greedy(pts, 5)
    assert got == {(r, c) for r, c, _ in want}
    top = graph.suppress_neighbours(df, "acc", 5, keep=3).collect()
    assert [(r.row, r.col) for r in top] == [(r, c) for r, c, _ in want[:3]]


def _walk(edges, node):
    path, seen = [node], {node}
    while edges[node] is not None:
        node = edges[node]
        if node in seen:
            return path, node
        seen.add(node)
        path.append(node)
    return path, None


def test_random_networks(spark):
    """Random functional graphs with cycles, long chains and a busy outlet."""
    rng = random.Random(2)
    n = 300
    edges = {i: (i - 1 if i % 3 else max(0, i - 40)) for i in range(1, n)}
    edges[0] = None
    for i in (50, 120, 121, 200):
        edges[i] = i + rng.randrange(1, 30)
    edges[10], edges[16], edges[150], edges[151] = 11, 20, 151, 150
    for i in range(260, 300):
        edges[i] = 7
    df = spark.createDataFrame([(k, v, float(k % 7)) for k, v in edges.items()], "node long, next long, area double")
    walks = {k: _walk(edges, k) for k in edges}
    ends = {r.node: (r.last, r.hops) for r in graph.follow_downstream(df).collect()}
    for k, (path, loop) in walks.items():
        assert ends[k] == ((None, None) if loop is not None else (path[-1], len(path) - 1))
    rings = {k for k, (path, loop) in walks.items() if loop == k}
    cyc = {r.node: r.cycle for r in graph.cycle_members(df).collect()}
    assert set(cyc) == rings and len(rings) >= 4
    fixed = graph.break_cycles(df.withColumn("dem", F.col("node").cast("double")), "dem")
    assert graph.cycle_members(fixed.select("node", "next")).count() == 0
    clean = {r.node: r.next for r in fixed.collect()}
    area = dict.fromkeys(clean, 0.0)
    for k in clean:
        for step in _walk(clean, k)[0]:
            area[step] += k % 7
    got = {r.node: r.upstream_area for r in graph.upstream_area(fixed, "area").collect()}
    assert got == pytest.approx(area)
    members = graph.upstream_members(fixed, fixed.where("node IN (0, 7, 40)")).collect()
    for outlet in (0, 7, 40):
        want = {k for k in clean if outlet in _walk(clean, k)[0]}
        assert {r.node for r in members if r.outlet == outlet} == want
    with pytest.raises(ValueError, match="cycle"):
        graph.MAX_ROUNDS, keep = 12, graph.MAX_ROUNDS
        try:
            graph.fold_upstream(df, {"s": "area"}, "sum")
        finally:
            graph.MAX_ROUNDS = keep


def test_chains_give_cycles_their_own_rivers(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, None, 2), (3, 4, 3), (4, 3, 4), (5, 2, 5)], "node long, next long, pos int")
    got = {r.node: r.river_id for r in graph.trace_chains(df, "pos").collect()}
    assert got[1] == got[2] == 0 and got[5] == 1
    assert got[3] == got[4] or {got[3], got[4]} == {2, 3}


def test_numbering_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id")
    got = [r.n for r in graph.number_rows(df, [F.col("k"), F.col("id")], "n", 1).orderBy("k", "id").collect()]
    assert got == list(range(1, 1001))


def _touches(x1, y1, x2, y2, west, south, size):
    """Whether a segment meets a closed square, by dense sampling plus end points."""
    for t in np.linspace(0, 1, 4001):
        x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
        if west - 1e-12 <= x <= west + size + 1e-12 and south - 1e-12 <= y <= south + size + 1e-12:
            return True
    return False


def test_touched_cells(spark):
    ring = [(0.13, 0.17), (1.41, 0.33), (1.18, 1.57), (0.31, 1.22)]
    df = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in ring])], "id int, ring array<struct<lon double, lat double>>")
    got = {(r.row, r.col) for r in polygons.touched_cells(df, "id", "ring", 0.25).collect()}
    want = set()
    closed = ring + ring[:1]
    for row in range(-1, 8):
        for col in range(-1, 8):
            w, s = col * 0.25, row * 0.25
            edge = any(_touches(*a, *b, w, s, 0.25) for a, b in zip(closed, closed[1:]))
            cx, cy = w + 0.125, s + 0.125
            odd = sum((a[1] > cy) != (b[1] > cy) and cx < (b[0] - a[0]) * (cy - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(closed, closed[1:])) % 2
            if edge or odd:
                want.add((row, col))
    assert got == want


def test_hot_tile_join(spark):
    """Most points fall in one tile; the tiled join still finds each of them."""
    pts = spark.range(5000).select("id", (F.lit(0.5) + F.col("id") % 10 * 0.001).alias("lon"), F.lit(0.5).alias("lat"))
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    poly = spark.range(3).select(F.col("id").alias("zone"), ring.alias("ring"))
    assert polygons.points_in_polygons(pts, poly, "zone", "ring", 0.3).count() == 15000


def test_rating_table_is_close_to_the_exact_depth(spark):
    depths = [0.0005, 0.05, 0.7, 1.3, 1.99]
    c = hydro.CULVERT
    rows = [(d, hydro.section_flow(d, c["width"], c["n"], c["slope"]), 10.0) for d in depths]
    out = hydro.rating_stage(spark.createDataFrame(rows, "d double, q double, bed double"), "q", "bed", c["width"], c["n"], c["slope"], c["height"])
    for r in out.collect():
        assert r.stage == pytest.approx(10.0 + r.d, abs=2e-4)


def test_storm_profile():
    p = hydro.storm_profile()
    assert len(p) == 48 and sum(p) == pytest.approx(1.0) and p.index(max(p)) in (6, 7)


def test_convolution_matches_numpy(spark):
    rng = np.random.default_rng(1)
    flow = {k: rng.random(40) for k in (1, 2)}
    uh = {k: rng.random(6) for k in (1, 2)}
    f = spark.createDataFrame([(k, i, float(v)) for k, s in flow.items() for i, v in enumerate(s)], "k2 int, step int, q double")
    o = spark.createDataFrame([(k, i, float(v)) for k, s in uh.items() for i, v in enumerate(s)], "k2 int, k int, u double")
    got = {(r.k2, r.step): r.q for r in hydro.convolve(f, o, ["k2"], "step", "q").collect()}
    for k in flow:
        want = np.convolve(flow[k], uh[k])[:40]
        assert [got[(k, i)] for i in range(40)] == pytest.approx(list(want))


def test_bounded_asof_and_errors(spark):
    have = spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-01-20", 9.0)], "k int, day string, v double").withColumn("day", F.to_date("day"))
    want = spark.createDataFrame([(1, "2024-01-07"), (1, "2024-01-12"), (1, "2024-01-20")], "k int, day string").withColumn("day", F.to_date("day"))
    got = {str(r.day): r.value for r in align.bounded_asof(want, have, ["k"], "day", "v", 7).collect()}
    assert got == {"2024-01-07": 5.0, "2024-01-12": None, "2024-01-20": 9.0}
    with pytest.raises(Exception, match="no step at or before"):
        align.latest_on_or_before(have, "day", F.lit("2020-01-01").cast("date")).collect()


def test_onset_needs_two_more_bins(spark):
    bins = [("2024-01-01", 30.0), ("2024-01-11", 5.0), ("2024-01-21", 5.0), ("2024-01-31", 40.0), ("2024-02-10", 15.0), ("2024-02-20", 10.0), ("2024-03-01", 90.0)]
    df = spark.createDataFrame([(1, d, v) for d, v in bins], "z int, bin string, v double").withColumn("bin", F.to_date("bin"))
    d = lambda s: F.lit(s).cast("date")
    first = temporal.first_onset(df, ["z"], "bin", "v", d("2024-01-01"), d("2024-12-31"))
    assert str(first.head().onset) == "2024-01-31"
    late = temporal.first_onset(df, ["z"], "bin", "v", d("2024-02-25"), d("2024-12-31"))
    assert late.head().onset is None


def test_season_codes_of_a_late_december(spark):
    months = ["2019-12", "2020-01", "2020-02", "2020-03"]
    df = spark.createDataFrame([(m + "-01",) for m in months], "month string").withColumn("month", F.to_date("month"))
    got = {str(r.month)[:7]: r.season for r in temporal.season_codes(df, "month").collect()}
    assert got == {"2019-12": "DJF", "2020-01": "NDJ", "2020-02": "DJF", "2020-03": "JFM"}


def test_zonal_method_fallback_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (1, 4.0), (2, None)], "z int, value double")
    got = {r.z: r.mean_value for r in zonal.zonal_reduce(df, ["z"], method="unknown").collect()}
    assert got == {1: 3.0, 2: None}
    std = {r.z: r.mean_value for r in zonal.zonal_reduce(df, ["z"], method="std").collect()}
    assert std[1] == pytest.approx(1.0)


def test_feature_switches(spark):
    df = spark.createDataFrame([(None, "mild", 0.4, 0.6)], "val double, label string, x_p1 double, x_p2 double")
    picked = filters.first_available(
        df, ("absent", lambda c: c), ("val", lambda c: c), ("label", lambda c: F.when(c == "mild", 2.0)), default=F.lit(1.0)
    )
    assert df.select(picked.alias("v")).head().v == 2.0
    assert filters.soft_columns(df, "x", 3) is None
    assert df.select(filters.soft_columns(df, "x", 2).alias("v")).head().v == [0.4, 0.6]


def test_region_without_points(spark):
    df = spark.createDataFrame([(10.0, 350.0), (20.0, 40.0)], "lat double, lon double")
    box = ((9.0, 11.0), (-12.0, -9.0))
    assert [r.lon for r in filters.region_subset(df, *box).collect()] == [-10.0]
    far = ((80.0, 81.0), (0.0, 1.0))
    assert filters.region_subset(df, *far).count() == 0
    assert filters.region_subset(df, *far, all_if_empty=True).count() == 2


def test_bilinear_corners_and_edges(spark):
    grid = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3) if (r, c) != (2, 2)], "row int, col int, value double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 1.5, 1.5), (4, 2.5, 0.0), (5, 0.25, 1.75)], "id int, lat double, lon double")
    inside = align.apply_weights(grid, align.bilinear_weights(pts, "id", 0.0, 0.0, 1.0, 3, 3), "id", ["value"])
    assert {r.id: r.value for r in inside.collect()} == {1: 5.5, 2: 11.0, 3: None, 5: pytest.approx(4.25)}
    wide = align.apply_weights(grid, align.bilinear_weights(pts, "id", 0.0, 0.0, 1.0, 3, 3, extrapolate=True), "id", ["value"])
    assert {r.id: r.value for r in wide.collect()}[4] == pytest.approx(25.0)
