"""Edge tiles, spans and nearest polygons against all edges."""

import math
import random

import pytest

from pluvion.operators import graph, polygons

RING = "key long, ring array<struct<lon: double, lat: double>>"


def shapes(draw, nice):
    """Rings of 3 to 9 corners, some of them large or crossing themselves; ``nice`` ones have corners on quarter units."""
    out = []
    for key in range(14):
        x, y, size = draw.uniform(-8, 8), draw.uniform(-8, 8), draw.choice([0.4, 2.0, 9.0])
        corners = [(x + draw.uniform(-size, size), y + draw.uniform(-size, size)) for _ in range(draw.randint(3, 9))]
        if nice:
            corners = [(round(a * 4) / 4, round(b * 4) / 4) for a, b in corners]
        out.append((key, corners + corners[:1] if key % 3 == 0 else corners))
    return out + [(50, [(1.0, 1.0)]), (51, []), (52, None)]


def frame(spark, given):
    return spark.createDataFrame([(k, None if r is None else [{"lon": a, "lat": b} for a, b in r]) for k, r in given], RING)


def sides(ring):
    closed = list(ring or []) + list((ring or [])[:1])
    return [(a, b) for a, b in zip(closed, closed[1:]) if a != b]


def holds(ring, x, y):
    hit = 0
    for (x1, y1), (x2, y2) in sides(ring):
        hit += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return hit % 2 == 1


def apart(ring, x, y):
    out = math.inf
    for (x1, y1), (x2, y2) in sides(ring):
        dx, dy = x2 - x1, y2 - y1
        t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        out = min(out, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return out


@pytest.mark.parametrize("nice, tile", [(False, 0.3), (True, 0.25), (True, 5.0)])
def test_points_in_polygons(spark, nice, tile):
    draw = random.Random(3)
    given = shapes(draw, nice)
    spots = [(draw.uniform(-12, 12), draw.uniform(-12, 12)) for _ in range(500)]
    if nice:
        spots += [(round(a * 4) / 4, round(b * 4) / 4) for a, b in spots]
    spots += [p for _, r in given for p in r or []] if nice else []
    points = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spots)] + [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, float("inf"), 0.0)], "id long, lon double, lat double")
    got = {(r.id, r.key) for r in polygons.points_in_polygons(points, frame(spark, given), "key", "ring", tile).collect()}
    assert got == {(i, k) for i, (a, b) in enumerate(spots) for k, r in given if holds(r, a, b)}
    assert polygons.points_in_polygons(points.limit(0), frame(spark, given), "key", "ring", tile).count() == 0
    assert polygons.points_in_polygons(points, frame(spark, []), "key", "ring", tile).count() == 0


def test_index_rows_follow_edges_and_spans(spark):
    square = lambda n: frame(spark, [(1, [(0.1, 0.1), (n + 0.2, 0.1), (n + 0.2, n + 0.2), (0.1, n + 0.2)])])
    rows = [polygons.tile_index(square(n), "key", "ring", 1.0).count() for n in (64, 128, 256)]
    assert rows[2] < 2.6 * rows[1] < 2.6 * 2.6 * rows[0] and rows[2] < 256 * 40
    edges = polygons.tile_index(square(64), "key", "ring", 1.0).selectExpr("sum(size(edges)) as n").first().n
    assert edges < 64 * 5


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_touched_cells_and_coverage(spark, parts):
    draw = random.Random(9)
    given = shapes(draw, parts == 3)
    cell = 0.5
    fine = cell / parts
    got = polygons.touched_cells(frame(spark, given), "key", "ring", fine)
    cells = {}
    for r in got.collect():
        cells.setdefault(r.key, set()).add((r.row, r.col))
    assert got.count() == sum(map(len, cells.values()))
    for key, ring in given:
        inner = {(i, j) for i in range(-int(20 / fine), int(20 / fine)) for j in range(-int(20 / fine), int(20 / fine)) if key < 4 and holds(ring, (j + 0.5) * fine, (i + 0.5) * fine)} if parts < 5 else set()
        assert inner <= cells.get(key, set())
        for i, j in cells.get(key, set()):
            x, y = (j + 0.5) * fine, (i + 0.5) * fine
            assert holds(ring, x, y) or apart(ring, x, y) <= fine * 0.7072
        for corner in ring or []:
            if len(set(ring)) > 1:
                assert (math.floor(corner[1] / fine), math.floor(corner[0] / fine)) in cells[key]
    want = {}
    for i, j in set().union(*cells.values()):
        want[i // parts, j // parts] = want.get((i // parts, j // parts), 0) + 1 / parts**2
    shares = {(r.row, r.col): r.fraction for r in polygons.coverage_fraction(frame(spark, given), "key", "ring", cell, parts).collect()}
    assert shares == pytest.approx(want)
    with pytest.raises(ValueError):
        polygons.coverage_fraction(frame(spark, given), "key", "ring", cell, 63)


def test_polygons_within_and_nearest(spark):
    draw = random.Random(4)
    given = shapes(draw, False)
    spots = [(draw.uniform(-30, 30), draw.uniform(-30, 30)) for _ in range(60)] + [(4000.0, -9000.0), (-1e5, 2.0)]
    points = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spots)] + [(-1, None, 0.0)], "id long, lon double, lat double")
    near = {(r.id, r.key): r.distance for r in polygons.polygons_within(points, frame(spark, given), "id", "key", "ring", 1.5).collect()}
    want = {(i, k): 0.0 if holds(r, a, b) else apart(r, a, b) for i, (a, b) in enumerate(spots) for k, r in given}
    assert near == pytest.approx({p: v for p, v in want.items() if v <= 1.5})
    got = {r.id: (r.key, r.distance) for r in polygons.nearest_polygons(points, frame(spark, given), "id", "key", "ring", 0.7).collect()}
    assert set(got) == set(range(len(spots)))
    for i, (a, b) in enumerate(spots):
        best = min((apart(r, a, b), k) for k, r in given)
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0])
    snapped = {r.id: (r.key, r.inside) for r in polygons.snap_outlets(points, frame(spark, given), "id", "key", "ring", 2.0).collect()}
    for i, (a, b) in enumerate(spots):
        inside = [k for k, r in given if holds(r, a, b)]
        assert snapped[i] == ((min(inside), True) if inside else (got[i][0], False))
    assert snapped[-1] == (None, None)
    assert polygons.nearest_polygons(points, frame(spark, []), "id", "key", "ring", 1.0).count() == 0


def test_nearest_meets_few_tiles_however_many_polygons(spark, monkeypatch):
    seen, kept = [], polygons.cut_lineage

    def counted(df):
        made = kept(df)
        if set(made.columns) == {"id", "lon", "lat", "tx", "ty"}:
            seen[-1].append(made.count())
        return made

    monkeypatch.setattr(polygons, "cut_lineage", counted)
    for n in (10, 30):
        squares = [(i * n + j, [(i, j), (i + 0.5, j), (i + 0.5, j + 0.5), (i, j + 0.5)]) for i in range(n) for j in range(n)]
        points = spark.createDataFrame([(k, -3.0 - k, n / 2) for k in range(5)], "id long, lon double, lat double")
        seen.append([])
        found = polygons.nearest_polygons(points, frame(spark, [(k, [(float(a), float(b)) for a, b in r]) for k, r in squares]), "id", "key", "ring", 0.5).collect()
        assert len(found) == 5
    assert max(seen[1]) <= 2 * max(seen[0]) and max(seen[1]) < 5 * 60


def test_smart_snap_takes_the_best_basin_in_reach(spark):
    box = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    polys = frame(spark, [(1, box(0.0, 0.0)), (2, box(1.0, 0.0)), (3, box(2.0, 0.0)), (4, box(9.0, 9.0))])
    edges = spark.createDataFrame([(1, None, 5.0), (2, 1, 10.0), (3, 2, 100.0), (4, None, 1.0)], "node long, next long, area double")
    sites = [(1, 0.95, 0.5, 12.0), (2, 1.9, 0.5, 108.0), (3, 1.9, 0.5, None), (4, 20.0, 20.0, 7.0), (5, 0.2, 0.2, None)]
    points = spark.createDataFrame(sites, "site long, lon double, lat double, target double")
    out = {r.site: (r.node, r.n_candidates) for r in graph.smart_snap(points, polys, edges, "site", "key", "ring", "area", "target", 0.3).collect()}
    assert out == {1: (2, 2), 2: (2, 2), 3: (2, 2), 4: (4, 0), 5: (1, 1)}
