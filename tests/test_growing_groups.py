"""Quantiles, nearest values and snapping where groups, axes and distances grow with the data."""

import random

import numpy as np
import pytest

from pluvion.operators import align, quantiles
from pluvion.operators.polygons import snap_outlets


@pytest.mark.parametrize("rows, finest", [(1, 64), (3, 64), (7, 1024), (10**6, 1024)])
def test_quantiles_over_many_buckets(spark, monkeypatch, rows, finest):
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", rows)
    monkeypatch.setattr(quantiles, "FINEST", finest)
    draw = np.random.default_rng(3)
    groups = {"a": np.round(draw.gamma(1.0, 50.0, 900), 1), "b": np.repeat([1.0, 2.0, 5.0], [300, 1, 2]), "c": np.array([4.0])}
    frame = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.913, 1.0]
    got = {(r.k, r.q): r.quantile for r in quantiles.exact_quantiles(frame, ["k"], "v", probs).collect()}
    assert got == pytest.approx({(k, q): float(np.quantile(v, q)) for k, v in groups.items() for q in probs})
    whole = {r.q: r.quantile for r in quantiles.exact_quantiles(frame, [], "v", probs).collect()}
    every = np.concatenate(list(groups.values()))
    assert whole == pytest.approx({q: float(np.quantile(every, q)) for q in probs})


def test_nearest_value(spark):
    draw = random.Random(2)
    axis = sorted({draw.randrange(5000) / 2 for _ in range(120)})
    wanted = [(i, draw.randrange(-400, 12000) / 4) for i in range(600)] + [(1000 + i, 77.25) for i in range(300)] + [(2000, None)]
    points = spark.createDataFrame(wanted, "id long, x double").repartition(4)
    values = spark.createDataFrame([(v,) for v in axis] * 2 + [(None,)], "c double").repartition(4)
    got = {r.id: r.c for r in align.nearest_value(points, "x", values, "c", "id").collect()}
    assert got == {i: None if x is None else min(axis, key=lambda c: (abs(c - x), c)) for i, x in wanted}
    empty = align.nearest_value(points, "x", values.where("c > 1e9"), "c", "id").collect()
    assert len(empty) == len(wanted) and all(r.c is None for r in empty)


def test_snapping_reaches_over_the_whole_extent(spark):
    square = [{"lon": a, "lat": b} for a, b in [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    polygons = spark.createDataFrame([(1, square)], "key long, ring array<struct<lon: double, lat: double>>")
    outlets = spark.createDataFrame([(1, 5.0, 5.0), (2, 90_000.0, 3.0), (3, None, 1.0)], "outlet long, lon double, lat double")
    got = {r.outlet: (r.key, r.inside) for r in snap_outlets(outlets, polygons, "outlet", "key", "ring", 5.0).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (None, None)}
