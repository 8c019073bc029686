"""Polygons cut into tiles by their edges, without a geometry engine.

A ring becomes edges, and each edge the tiles that it crosses; nothing copies a
ring. Tiles without an edge lie wholly inside or outside, so the inside comes as
spans of a row of tiles. Rows grow with the edges and the spans, not with the
tiles of a polygon's box.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvion.session import cut_lineage

#: Tiles lie off the round numbers that coordinates tend to have, by another share in x than in y, so that no ring
#: with round corners runs through a tile's corner, whatever its slope.
OFFSET_X, OFFSET_Y = 0.3819660112501051, 0.7548776662466927
#: An edge belongs to a tile that it comes this near to, as a part of the tile's side.
NEAR = 1e-9
#: A block of the next level is this many times as long; the levels of spans.
FANOUT = 8


def ring_edges(polygons: DataFrame, key: str, ring: str, carry: Sequence[str] = ()) -> DataFrame:
    """``(key, *carry, x1, y1, x2, y2)``: the edges of each ring, closed if need be, those without length left out."""
    points = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.col(ring)).otherwise(F.concat(F.col(ring), F.array(F.element_at(ring, 1))))
    pairs = F.zip_with(
        F.slice("_pts", F.lit(1), F.size("_pts") - 1), F.slice("_pts", F.lit(2), F.size("_pts") - 1),
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")),
    )
    closed = polygons.where(F.size(ring) > 1).select(key, *carry, points.alias("_pts"))
    return closed.select(key, *carry, F.inline(pairs)).where("x1 <> x2 or y1 <> y2")


def crossed_tiles(edges: DataFrame, tile: float, off_x: float = OFFSET_X, off_y: float = OFFSET_Y) -> DataFrame:
    """``edges`` with ``tx`` and ``ty``: one row for each tile that an edge crosses or touches."""
    at = lambda v, off: F.floor(v / tile - off).cast("bigint")
    pad = tile * NEAR
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("ty", F.explode(F.sequence(at(low - pad, off_y), at(high + pad, off_y))))
    south = (F.col("ty") + off_y) * tile
    # The part of the edge in the row: from where it enters to where it leaves.
    x_at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    flat = F.col("y1") == F.col("y2")
    enter = F.when(flat, F.col("x1")).otherwise(x_at(F.greatest(low, F.least(high, south))))
    leave = F.when(flat, F.col("x2")).otherwise(x_at(F.greatest(low, F.least(high, south + tile))))
    return rows.withColumn("tx", F.explode(F.sequence(at(F.least(enter, leave) - pad, off_x), at(F.greatest(enter, leave) + pad, off_x))))


def line_crossings(edges: DataFrame, tile: float, offset: float, keep: Sequence[str]) -> DataFrame:
    """``(*keep, ty, x)``: where edges cross the lines ``y = (ty + offset) tile``, each end counted half-open."""
    at = lambda v: F.floor(v / tile - offset).cast("bigint")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("ty", F.explode(F.sequence(at(low), at(high) + 1)))
    y = (F.col("ty") + offset) * tile
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return rows.where((F.col("y1") > y) != (F.col("y2") > y)).select(*keep, "ty", x.alias("x"))


def tile_index(polygons: DataFrame, key: str, ring: str, tile: float, carry: Sequence[str] = ()) -> DataFrame:
    """``(key, *carry, ty, level, bx, edges, odd)``: the index that a point is looked up in.

    At level -1 a row is a tile with the edges in it; ``odd`` tells whether its
    south-east corner lies inside. At level ``l`` a row is a block of ``FANOUT ** l``
    tiles that lie wholly inside. A span of tiles is cut into its largest aligned
    blocks, so it costs a few rows whatever its length.
    """
    edges = ring_edges(polygons, key, ring, carry)
    edge = F.struct("x1", "y1", "x2", "y2")
    border = crossed_tiles(edges, tile).groupBy(key, *carry, "ty", "tx").agg(F.collect_list(edge).alias("edges"))
    corner = ((F.col("tx") + 1 + OFFSET_X) * tile).alias("x")
    asked = border.select(key, *carry, "ty", corner, F.lit(0).alias("_hit"), "tx", "edges")
    crossings = line_crossings(edges, tile, OFFSET_Y, [key, *carry]).select(
        key, *carry, "ty", "x", F.lit(1).alias("_hit"), F.lit(None).cast("bigint").alias("tx"), F.lit(None).cast(border.schema["edges"].dataType).alias("edges")
    )
    east = Window.partitionBy(key, "ty").orderBy(F.col("x").desc(), "_hit").rowsBetween(Window.unboundedPreceding, 0)
    row = Window.partitionBy(key, "ty").orderBy("tx")
    marked = asked.unionByName(crossings).withColumn("odd", F.sum("_hit").over(east) % 2 == 1).where("_hit = 0")
    marked = marked.withColumn("_stop", F.lead("tx").over(row) - 1)
    inner = F.when(F.col("odd") & (F.col("_stop") > F.col("tx")), aligned_blocks(F.col("tx") + 1, F.col("_stop"))).otherwise(F.array().cast("array<struct<level:int,bx:bigint>>"))
    own = F.struct(F.lit(-1).alias("level"), F.col("tx").alias("bx"))
    cells = marked.withColumn("_cell", F.explode(F.concat(F.array(own), inner)))
    level = F.col("_cell.level")
    return cells.select(key, *carry, "ty", level.alias("level"), F.col("_cell.bx").alias("bx"), F.when(level < 0, F.col("edges")).alias("edges"), "odd")


def aligned_blocks(start: Column, stop: Column) -> Column:
    """The largest aligned blocks that the numbers from ``start`` to ``stop`` consist of, as an array of (level, number)."""
    top = F.floor(F.log(float(FANOUT), (stop - start + 1).cast("double")) + 1e-9).cast("int")

    def of(level: Column) -> Column:
        size = F.pow(F.lit(float(FANOUT)), level).cast("bigint")
        low, high = F.ceil(start / size), F.floor((stop + 1) / size) - 1
        first, last = F.ceil(start / (size * FANOUT)) * FANOUT, F.floor((stop + 1) / (size * FANOUT)) * FANOUT - 1
        run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        numbers = F.when(first > last, run(low, high)).otherwise(F.concat(run(low, first - 1), run(last + 1, high)))
        return F.transform(numbers, lambda n: F.struct(level.cast("int").alias("level"), n.alias("bx")))

    return F.flatten(F.transform(F.sequence(F.lit(0), top), of))


def _inside(x: Column, y: Column, tile: float) -> Column:
    """Whether a point lies inside, from the index row of its tile: the corner's side, and the edges between it and the point."""
    east, south = (F.col("bx") + 1 + OFFSET_X) * tile, (F.col("ty") + OFFSET_Y) * tile

    def along(e):  # on the way west from the tile's side to the point
        cut = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < cut) & ~(east < cut)

    def up(e):  # on the way up the tile's side from the corner
        cut = (e["y2"] - e["y1"]) * (east - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]
        return ((e["x1"] > east) != (e["x2"] > east)) & ((cut > south) != (cut > y))

    crossed = F.col("odd").cast("int") + F.size(F.filter("edges", along)) + F.size(F.filter("edges", up))
    return F.col("edges").isNull() | (crossed % 2 == 1)


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, key: str, ring: str, tile: float, lon: str = "lon", lat: str = "lat", carry: Sequence[str] = ()
) -> DataFrame:
    """All (point, polygon) pairs where the polygon holds the point, by the even-odd rule.

    A point meets the edges of its own tile and the blocks above it, one
    equality join in all. Points with NULL or non-finite coordinates and rings
    of fewer than two points hold nothing.
    """
    index = tile_index(polygons, key, ring, tile, carry)
    wide = F.array_max(F.transform(ring, lambda p: p["lon"])) - F.array_min(F.transform(ring, lambda p: p["lon"]))
    longest = F.log(float(FANOUT), F.greatest(F.max(wide) / tile, F.lit(1.0)))
    top = polygons.agg(F.coalesce(F.floor(longest + 1e-9).cast("int"), F.lit(0)).alias("v")).scalar()
    at = lambda c, off: F.floor(F.col(c) / tile - off).cast("bigint")
    finite = (F.abs(lon) < float("inf")) & (F.abs(lat) < float("inf"))
    placed = points.where(finite).withColumns({"_tx": at(lon, OFFSET_X), "ty": at(lat, OFFSET_Y)}).withColumn("level", F.explode(F.sequence(F.lit(-1), top)))
    size = F.pow(F.lit(float(FANOUT)), F.greatest("level", F.lit(0))).cast("bigint")
    placed = placed.withColumn("bx", F.floor(F.col("_tx") / size)).drop("_tx")
    found = placed.join(index, ["ty", "level", "bx"]).where(_inside(F.col(lon), F.col(lat), tile))
    return found.drop("ty", "level", "bx", "edges", "odd")


# ---------------------------------------------------------------- rasters

def centre_spans(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """``(key, row, start, stop)``: columns whose cell centres lie inside, as spans of a row, from the ring's crossings of the centre line."""
    found = line_crossings(ring_edges(polygons, key, ring), cell, 0.5, [key])
    line = Window.partitionBy(key, "ty").orderBy("x")
    # The first column whose centre is not west of x, told by the centres themselves.
    guess = F.floor(F.col("x") / cell - 0.5).cast("bigint")
    west_of = lambda n: (n + F.lit(0.5)) * cell < F.col("x")
    first = F.when(~west_of(guess), guess).when(~west_of(guess + 1), guess + 1).otherwise(guess + 2)
    spans = found.withColumns({"start": first, "_n": F.row_number().over(line)}).withColumn("stop", F.lead("start").over(line) - 1)
    return spans.where("_n % 2 = 1 and start <= stop").select(key, F.col("ty").alias("row"), "start", "stop")


def edge_cells(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """``(key, row, col)``: the cells that a polygon's edges meet, sides and corners included.

    Cells that the polygon's box only touches from the east or north are left out.
    """
    at = lambda c, f: F.floor(f(F.transform(ring, lambda p: p[c])) / cell)
    boxed = polygons.withColumns({"_w": at("lon", F.array_min), "_e": at("lon", F.array_max), "_s": at("lat", F.array_min), "_n": at("lat", F.array_max)})
    west, south = F.col("tx") * cell, F.col("ty") * cell
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Clip the edge to the cell by the two slabs and see whether a part is left.
    ta, tb = (west - F.col("x1")) / F.when(dx != 0, dx), (west + cell - F.col("x1")) / F.when(dx != 0, dx)
    ua, ub = (south - F.col("y1")) / F.when(dy != 0, dy), (south + cell - F.col("y1")) / F.when(dy != 0, dy)
    off_x = (dx == 0) & ~F.col("x1").between(west, west + cell)
    off_y = (dy == 0) & ~F.col("y1").between(south, south + cell)
    zero, one = F.lit(0.0), F.lit(1.0)
    start = F.greatest(zero, F.coalesce(F.least(ta, tb), zero), F.coalesce(F.least(ua, ub), zero))
    end = F.least(one, F.coalesce(F.greatest(ta, tb), one), F.coalesce(F.greatest(ua, ub), one))
    rows = crossed_tiles(ring_edges(boxed, key, ring, ["_w", "_e", "_s", "_n"]), cell, 0.0, 0.0).where(~off_x & ~off_y & (start <= end))
    rows = rows.where("tx between _w and _e and ty between _s and _n")
    return rows.select(key, F.col("ty").alias("row"), F.col("tx").alias("col")).distinct()


def touched_spans(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """``(key, row, start, stop)``: cells that a polygon's edges or inside touch; spans may overlap."""
    edges = edge_cells(polygons, key, ring, cell).select(key, "row", F.col("col").alias("start"), F.col("col").alias("stop"))
    return edges.unionByName(centre_spans(polygons, key, ring, cell))


def touched_cells(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """``(key, row, col)``: every grid cell that an edge or the inside of a polygon touches; a cell counts when an edge meets it or its centre lies inside."""
    inner = centre_spans(polygons, key, ring, cell).select(key, "row", F.explode(F.sequence("start", "stop")).alias("col"))
    return edge_cells(polygons, key, ring, cell).unionByName(inner).distinct()


def coverage_fraction(polygons: DataFrame, key: str, ring: str, cell: float, parts: int = 5) -> DataFrame:
    """Share of the ``parts`` x ``parts`` sub-cells of each cell that any polygon touches.

    A span of sub-cells becomes one bit mask for each cell that it runs
    through; masks of all polygons are put together by row and cell.
    """
    if not 1 <= parts <= 62:
        raise ValueError("parts must be between 1 and 62")
    spans = touched_spans(polygons, key, ring, cell / parts)
    cells = spans.withColumn("col", F.explode(F.sequence(F.floor(F.col("start") / parts), F.floor(F.col("stop") / parts))))
    low = F.greatest(F.col("start") - F.col("col") * parts, F.lit(0))
    high = F.least(F.col("stop") - F.col("col") * parts, F.lit(parts - 1))
    ones = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))
    masks = cells.groupBy("row", "col").agg(F.bit_or(ones(high + 1) - ones(low)).alias("_m"))
    return masks.groupBy(F.floor(F.col("row") / parts).alias("row"), "col").agg(
        (F.sum(F.bit_count("_m")) / F.lit(float(parts * parts))).alias("fraction")
    ).select("row", "col", "fraction")


# ---------------------------------------------------------------- distances

def segment_distance(x: Column, y: Column) -> Column:
    """Distance from a point to the edge ``(x1, y1, x2, y2)`` of the row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.coalesce(((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.when(length > 0, length), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - F.col("x1") - t * dx, 2) + F.pow(y - F.col("y1") - t * dy, 2))


def polygons_within(points: DataFrame, polygons: DataFrame, point: str, key: str, ring: str, radius: float) -> DataFrame:
    """``(point, key, distance)``: polygons within ``radius`` of each point, 0 for those that hold it.

    A point visits the nine tiles of side ``radius`` around it, and in them the
    edges only.
    """
    step = F.sequence(F.lit(-1), F.lit(1))
    at = lambda c, off: F.floor(F.col(c) / radius - off).cast("bigint")
    finite = (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf"))
    around = points.where(finite).select(point, "lon", "lat", F.explode(step).alias("_i"), at("lon", OFFSET_X).alias("_a"), at("lat", OFFSET_Y).alias("_b"))
    around = around.withColumn("_j", F.explode(step)).select(point, "lon", "lat", (F.col("_a") + F.col("_i")).alias("tx"), (F.col("_b") + F.col("_j")).alias("ty"))
    tiles = crossed_tiles(ring_edges(polygons, key, ring), radius)
    near = around.join(tiles, ["tx", "ty"]).withColumn("distance", segment_distance(F.col("lon"), F.col("lat"))).where(F.col("distance") <= radius)
    held = points_in_polygons(points.select(point, "lon", "lat"), polygons, key, ring, radius)
    both = near.select(point, key, "distance").unionByName(held.select(point, key, F.lit(0.0).alias("distance")))
    return both.groupBy(point, key).agg(F.min("distance").alias("distance"))


def nearest_polygons(points: DataFrame, polygons: DataFrame, point: str, key: str, ring: str, tile: float) -> DataFrame:
    """``(point, key, distance)``: the polygon whose ring is nearest to each point, the lower key in a tie.

    Tiles with edges are put together four at a time into a pyramid; every tile
    of it knows a point of an edge. A search starts at the first level at which
    the nine tiles around a point hold an edge, so however far the polygons are,
    it starts with a few tiles. From there it goes down a level at a time: what
    the known points promise is an upper bound, and tiles farther away than it
    are dropped. Each round is a join on tiles; only the number of levels
    reaches the driver.
    """
    rings = ring_edges(polygons, key, ring)
    tiles = cut_lineage(crossed_tiles(rings, tile))
    finite = (F.abs("lon") < float("inf")) & (F.abs("lat") < float("inf"))
    at = lambda c, off: F.floor(F.col(c) / tile - off).cast("bigint")
    asked = cut_lineage(points.where(finite).select(point, "lon", "lat", at("lon", OFFSET_X).alias("_tx"), at("lat", OFFSET_Y).alias("_ty")))
    box = tiles.select("tx", "ty").unionByName(asked.select(F.col("_tx").alias("tx"), F.col("_ty").alias("ty"))).agg(
        (F.max("tx") - F.min("tx")).alias("w"), (F.max("ty") - F.min("ty")).alias("h")
    ).first()
    if tiles.isEmpty():
        return asked.select(point, F.lit(None).cast(polygons.schema[key].dataType).alias(key), F.lit(None).cast("double").alias("distance")).limit(0)
    top = math.ceil(math.log2(max(box.w, box.h, 1) + 1)) + 2
    centre = lambda c, off: (F.col(c) + off + 0.5) * tile
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((centre("tx", OFFSET_X) - F.col("x1")) * dx + (centre("ty", OFFSET_Y) - F.col("y1")) * dy) / (dx * dx + dy * dy)))
    known = F.struct((F.col("x1") + t * dx).alias("x"), (F.col("y1") + t * dy).alias("y"))
    layer = tiles.groupBy("tx", "ty").agg(F.min(known).alias("known")).select(F.lit(0).alias("level"), "tx", "ty", "known")
    layers = [cut_lineage(layer)]
    for level in range(1, top + 1):
        half = lambda c: F.floor(F.col(c) / 2).alias(c)
        layers.append(cut_lineage(layers[-1].groupBy(half("tx"), half("ty")).agg(F.min("known").alias("known")).select(F.lit(level).alias("level"), "tx", "ty", "known")))
    pyramid = layers[0]
    for layer in layers[1:]:
        pyramid = pyramid.unionByName(layer)
    step = F.sequence(F.lit(-1), F.lit(1))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level").cast("bigint"))

    def around(rows: DataFrame) -> DataFrame:
        spread = rows.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
        return spread.withColumns({"tx": up("_tx") + F.col("_i"), "ty": up("_ty") + F.col("_j")}).drop("_i", "_j")

    levels = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    first = around(levels).join(pyramid.select("level", "tx", "ty"), ["level", "tx", "ty"]).groupBy(point, "lon", "lat", "_tx", "_ty").agg(F.min("level").alias("level"))
    # Nine tiles two levels up reach farther than any edge in the nine tiles found.
    starts = cut_lineage(first.withColumn("level", F.least(F.col("level") + 2, F.lit(top))))
    open_ = None
    for level in range(top, -1, -1):
        met = around(starts.where(F.col("level") == level)).select(point, "lon", "lat", "tx", "ty")
        if open_ is not None:
            child = F.explode(F.array(*[F.struct((F.col("tx") * 2 + a).alias("tx"), (F.col("ty") * 2 + b).alias("ty")) for a in (0, 1) for b in (0, 1)]))
            met = met.unionByName(open_.select(point, "lon", "lat", child.alias("_c")).select(point, "lon", "lat", "_c.tx", "_c.ty"))
        side = tile * 2.0**level
        gap = lambda c, p, off: F.greatest((F.col(c) + off / 2**level) * side - F.col(p), F.col(p) - (F.col(c) + 1 + off / 2**level) * side, F.lit(0.0))
        least = F.sqrt(F.pow(gap("tx", "lon", OFFSET_X), 2) + F.pow(gap("ty", "lat", OFFSET_Y), 2))
        most = F.sqrt(F.pow(F.col("known.x") - F.col("lon"), 2) + F.pow(F.col("known.y") - F.col("lat"), 2))
        seen = met.join(layers[level].select("tx", "ty", "known"), ["tx", "ty"]).withColumns({"_least": least, "_most": most})
        bound = F.min("_most").over(Window.partitionBy(point))
        open_ = cut_lineage(seen.withColumn("_bound", bound).where(F.col("_least") <= F.col("_bound") * (1 + 1e-9) + tile * NEAR).select(point, "lon", "lat", "tx", "ty"))
    last = open_.join(tiles, ["tx", "ty"]).withColumn("distance", segment_distance(F.col("lon"), F.col("lat")))
    return last.groupBy(point).agg(F.min(F.struct("distance", key)).alias("_m")).select(point, F.col(f"_m.{key}").alias(key), F.col("_m.distance").alias("distance"))


def snap_outlets(outlets: DataFrame, polygons: DataFrame, outlet: str, key: str, ring: str, tile: float) -> DataFrame:
    """Polygon that holds each outlet (the lowest key of several), else the nearest one; ``inside`` tells which."""
    held = points_in_polygons(outlets.select(outlet, "lon", "lat"), polygons, key, ring, tile).groupBy(outlet).agg(F.min(key).alias(key))
    found = cut_lineage(held.withColumn("inside", F.lit(True)))
    loose = outlets.join(found, outlet, "left_anti")
    near = nearest_polygons(loose, polygons, outlet, key, ring, tile).select(outlet, key, F.lit(False).alias("inside"))
    return outlets.select(outlet).join(found.unionByName(near), outlet, "left")
