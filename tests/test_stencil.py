"""The halo stencil against differences over the whole grid."""

import random

import pytest

from pluvion.operators import terrain


@pytest.mark.parametrize("block", [1, 3, 64])
def test_gradients_over_blocks(spark, block):
    draw = random.Random(6)
    cells = {(r, c): None if draw.random() < 0.05 else draw.uniform(0, 9) for r in range(2, 13) for c in range(-4, 7) if draw.random() < 0.93}
    grid = spark.createDataFrame([(r, c, z, f"x{r}") for (r, c), z in cells.items()], "row long, col long, z double, note string").repartition(3)
    rows, cols = [r for r, _ in cells], [c for _, c in cells]

    def difference(at, step, low, high):
        before, after = (cells.get((at[0] + s * step[0], at[1] + s * step[1])) for s in (-1, 1))
        h, place = cells[at], at[0] if step[0] else at[1]
        a, b, size = (after, h, 10.0) if place == low else (h, before, 10.0) if place == high else (after, before, 20.0)
        return None if a is None or b is None else (a - b) / size

    got = {(r.row, r.col): r for r in terrain.gradients(grid, "z", 10.0, block).collect()}
    assert set(got) == set(cells)
    for at, r in got.items():
        assert r.note == f"x{at[0]}"
        assert r.dy == pytest.approx(difference(at, (1, 0), min(rows), max(rows)))
        assert r.dx == pytest.approx(difference(at, (0, 1), min(cols), max(cols)))
    assert terrain.gradients(grid.limit(0), "z", 10.0, block).count() == 0


def test_slope_shuffles_once(spark):
    grid = spark.range(100).selectExpr("id div 10 as row", "id % 10 as col", "cast(id as double) as z")
    plan = terrain.slope(grid, "z", 1.0)._jdf.queryExecution().sparkPlan().toString()
    full = terrain.slope(grid, "z", 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and full.split("Subqueries")[0].count("Exchange hashpartitioning(_br") == 1
