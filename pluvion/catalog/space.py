"""Spatial joins, regridding and lookups on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.operators import align, graph, polygons, spatial, terrain, zonal

QUERIES, ORACLES, query = bind.area()

# ---- customers as points, nations as four-cornered zones that overlap a little

POINT_SQL = """
pts AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * 10 AS lon, (c_custkey * 104729 % 10009) / 10009.0::DOUBLE * 10 AS lat, c_mktsegment AS seg FROM customer),
zones AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * 2.0::DOUBLE AS x, (n_nationkey // 5) * 2.0::DOUBLE AS y FROM nation),
ring AS (SELECT zone, [{'x': x - 0.3, 'y': y + 0.4}, {'x': x + 1.0, 'y': y - 0.5}, {'x': x + 2.2, 'y': y + 0.7}, {'x': x + 1.1, 'y': y + 2.3}, {'x': x - 0.3, 'y': y + 0.4}] AS r FROM zones),
edge AS (SELECT zone, r[i].x AS x1, r[i].y AS y1, r[i + 1].x AS x2, r[i + 1].y AS y2 FROM ring, generate_series(1, 4) t(i)),
hit AS (SELECT id, zone FROM pts, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, zone HAVING count(*) % 2 = 1)
"""


def points(spark, d):
    k = F.col("c_custkey")
    return bind.table(spark, d, "customer").select(
        k.alias("id"),
        ((k * 7919 % 10007) / F.lit(10007.0) * 10).alias("lon"),
        ((k * 104729 % 10009) / F.lit(10009.0) * 10).alias("lat"),
    )


def zones(spark, d):
    k = F.col("n_nationkey")
    x, y = (k % 5) * F.lit(2.0), F.floor(k / 5) * F.lit(2.0)
    pt = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    return bind.table(spark, d, "nation").select(
        k.alias("zone"), F.array(pt(-0.3, 0.4), pt(1.0, -0.5), pt(2.2, 0.7), pt(1.1, 2.3)).alias("ring"),
        (x + 1.0).alias("centre_lon"), (y + 0.7).alias("centre_lat"), (x + 1.0).alias("rep_lon"), (y + 0.7).alias("rep_lat"),
    )


@query("spatial_pip", bind.with_sql("SELECT id, zone FROM hit", POINT_SQL))
def spatial_pip(spark, d):
    return polygons.points_in_polygons(points(spark, d), zones(spark, d), "zone", "ring", 1.0).select("id", "zone")


@query("rasterise_last", bind.with_sql("SELECT id, max(zone) AS zone FROM hit GROUP BY id", POINT_SQL))
def rasterise_last(spark, d):
    z = zones(spark, d).withColumn("seq", F.col("zone"))
    return spatial.rasterise(points(spark, d), z, "zone", "ring", "seq", 1.0, ["id"])


@query(
    "point_count_by_tile",
    bind.with_sql("SELECT zone, count(*) AS n, round(avg(lon), 6) AS mean_lon FROM pts JOIN hit USING (id) GROUP BY zone", POINT_SQL),
)
def point_count_by_tile(spark, d):
    hits = polygons.points_in_polygons(points(spark, d), zones(spark, d), "zone", "ring", 0.37)
    return hits.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("mean_lon"))


@query(
    "outlet_snap",
    bind.with_sql(
        """, far AS (SELECT p.id, zone, lon, lat, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM pts p, edge WHERE p.id NOT IN (SELECT id FROM hit)),
        t AS (SELECT *, least(greatest(((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy), 0), 1) AS u FROM far),
        dd AS (SELECT id, zone, min(sqrt(power(lon - x1 - u * dx, 2) + power(lat - y1 - u * dy, 2))) AS d FROM t GROUP BY id, zone)
        SELECT id, min(zone) AS zone, true AS inside FROM hit GROUP BY id UNION ALL SELECT id, arg_min(zone, (d, zone)), false FROM dd GROUP BY id""",
        POINT_SQL,
    ),
)
def outlet_snap(spark, d):
    return polygons.snap_outlets(points(spark, d), zones(spark, d), "id", "zone", "ring", 0.4)


_NEAR_SQL = """
far AS (SELECT p.id, zone, lon, lat, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM pts p, edge),
t AS (SELECT *, least(greatest(((lon - x1) * dx + (lat - y1) * dy) / (dx * dx + dy * dy), 0), 1) AS u FROM far),
ring_d AS (SELECT id, zone, min(sqrt(power(lon - x1 - u * dx, 2) + power(lat - y1 - u * dy, 2))) AS d FROM t GROUP BY id, zone),
dist AS (SELECT id, zone, CASE WHEN hit.id IS NULL THEN d ELSE 0 END AS d FROM ring_d LEFT JOIN hit USING (id, zone))
"""


@query("polygons_near", bind.with_sql("SELECT id, zone, round(d, 9) AS distance FROM dist WHERE d <= 0.5", POINT_SQL, _NEAR_SQL))
def polygons_near(spark, d):
    out = polygons.polygons_within(points(spark, d), zones(spark, d), "id", "zone", "ring", 0.5)
    return out.withColumn("distance", F.round("distance", 9))


@query(
    "smart_snap",
    bind.with_sql(
        """, flow AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey >= 5 THEN n_nationkey - 5 END AS nxt, (n_nationkey * 17 % 29 + 3)::DOUBLE AS area FROM nation),
        up AS (SELECT a.node, sum(b.area) AS area FROM flow a JOIN flow b ON b.node >= a.node AND (b.node - a.node) % 5 = 0 GROUP BY a.node),
        cand AS (SELECT id, zone FROM dist WHERE d <= 0.2), n AS (SELECT id, count(*) AS n FROM cand GROUP BY id),
        every AS (SELECT * FROM cand UNION ALL SELECT id, arg_min(zone, (d, zone)) FROM dist WHERE id NOT IN (SELECT id FROM cand) GROUP BY id),
        score AS (SELECT id, zone, CASE WHEN id % 3 = 0 THEN -area ELSE abs(ln(area / (20 + id % 60))) END AS s FROM every JOIN up ON up.node = zone)
        SELECT id, arg_min(zone, (s, zone)) AS node, coalesce(any_value(n), 0) AS n_candidates FROM score LEFT JOIN n USING (id) GROUP BY id""",
        POINT_SQL, _NEAR_SQL,
    ),
)
def smart_snap(spark, d):
    k = F.col("n_nationkey")
    flow = bind.table(spark, d, "nation").select(k.alias("node"), F.when(k >= 5, k - 5).alias("next"), (k * 17 % 29 + 3).cast("double").alias("area"))
    sites = points(spark, d).withColumn("target", F.when(F.col("id") % 3 != 0, (F.col("id") % 60 + 20).cast("double")))
    return graph.smart_snap(sites, zones(spark, d), flow, "id", "zone", "ring", "area", "target", 0.2)


@query(
    "zone_cells",
    bind.with_sql(
        """, c AS (SELECT zone, "row", col FROM (SELECT zone, x, unnest(range(CAST(floor((y - 0.5e0) / 0.125e0) AS BIGINT), CAST(floor((y + 2.3e0) / 0.125e0) AS BIGINT) + 1)) AS "row" FROM zones),
          LATERAL (SELECT unnest(range(CAST(floor((x - 0.3e0) / 0.125e0) AS BIGINT), CAST(floor((x + 2.2e0) / 0.125e0) AS BIGINT) + 1)) AS col) q),
        inner_cells AS (SELECT c.zone, "row", col FROM c JOIN edge USING (zone) WHERE (y1 > ("row" + 0.5e0) * 0.125e0) <> (y2 > ("row" + 0.5e0) * 0.125e0)
          AND (col + 0.5e0) * 0.125e0 < (x2 - x1) * (("row" + 0.5e0) * 0.125e0 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
        slab AS (SELECT zone, "row", col, (col * 0.125e0 - x1) / (x2 - x1) AS ta, (col * 0.125e0 + 0.125e0 - x1) / (x2 - x1) AS tb, ("row" * 0.125e0 - y1) / (y2 - y1) AS ua, ("row" * 0.125e0 + 0.125e0 - y1) / (y2 - y1) AS ub FROM c JOIN edge USING (zone)),
        met AS (SELECT DISTINCT zone, "row", col FROM slab WHERE greatest(0, least(ta, tb), least(ua, ub)) <= least(1, greatest(ta, tb), greatest(ua, ub)))
        SELECT zone, "row", count(*) AS n_cells, min(col) AS first_col, max(col) AS last_col FROM (SELECT * FROM inner_cells UNION SELECT * FROM met) GROUP BY zone, 2""",
        POINT_SQL,
    ),
)
def zone_cells(spark, d):
    cells = polygons.touched_cells(zones(spark, d), "zone", "ring", 0.125)
    return cells.groupBy("zone", "row").agg(F.count("*").alias("n_cells"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


@query(
    "site_match",
    bind.with_sql(
        """, m AS (SELECT a.id, b.id AS entry, sqrt(power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2)) AS d FROM pts a JOIN pts b ON abs(a.lon - b.lon) <= 0.2 AND abs(a.lat - b.lat) <= 0.2
             WHERE a.seg = 'BUILDING' AND b.seg <> 'BUILDING')
        SELECT id, arg_min(entry, (d, entry)) AS entry, round(min(d), 9) AS distance FROM m WHERE d <= 0.2 GROUP BY id""",
        POINT_SQL,
    ),
)
def site_match(spark, d):
    kind = bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    p = points(spark, d).join(kind, "id")
    entries = p.where("c_mktsegment <> 'BUILDING'").withColumnRenamed("id", "entry")
    out = spatial.nearest_site(p.where("c_mktsegment = 'BUILDING'"), entries, "id", "entry", 0.2)
    return out.withColumn("distance", F.round("distance", 9))


@query(
    "empty_zone_fallback",
    bind.with_sql(
        """, cells AS (SELECT lat, lon, v FROM (SELECT DISTINCT round(lat * 2) / 2 AS lat FROM pts) a, (SELECT DISTINCT round(lon * 2) / 2 AS lon FROM pts) b,
              (SELECT 1) c, LATERAL (SELECT a.lat * 10 + b.lon AS v) q),
        red AS (SELECT zone, round(avg(lat), 6) AS value FROM hit JOIN pts USING (id) WHERE zone % 3 <> 0 GROUP BY zone),
        nl AS (SELECT zone, arg_min(lat, (abs(lat - (y + 0.7)), lat)) AS lat FROM zones, (SELECT DISTINCT lat FROM cells) GROUP BY zone),
        no AS (SELECT zone, arg_min(lon, (abs(lon - (x + 1.0)), lon)) AS lon FROM zones, (SELECT DISTINCT lon FROM cells) GROUP BY zone)
        SELECT zone, round(coalesce(value, v), 6) AS value FROM zones LEFT JOIN red USING (zone) JOIN nl USING (zone) JOIN no USING (zone) LEFT JOIN cells USING (lat, lon)""",
        POINT_SQL,
    ),
)
def empty_zone_fallback(spark, d):
    p = points(spark, d)
    half = lambda c: F.rint(F.col(c) * 2) / 2
    rows, cols = p.select(half("lat").alias("lat")).distinct(), p.select(half("lon").alias("lon")).distinct()
    across = cols.agg(F.collect_set("lon")).scalar()  # half degrees: 721 at most
    cells = rows.select("lat", F.explode(across).alias("lon")).withColumn("v", F.col("lat") * 10 + F.col("lon"))
    hits = polygons.points_in_polygons(p, zones(spark, d), "zone", "ring", 1.0).where("zone % 3 <> 0")
    reduced = hits.groupBy("zone").agg(F.round(F.avg("lat"), 6).alias("value"))
    out = zonal.fill_empty_zones(zones(spark, d), reduced, cells, "zone", "value", "v")
    return out.select("zone", F.round("value", 6).alias("value"))


@query(
    "domain_clip",
    bind.with_sql(
        """, rep AS (SELECT a.zone, x + 1.0 AS px, y + 0.7 AS py FROM zones a),
        inside AS (SELECT rep.zone FROM rep, edge e WHERE e.zone IN (6, 7, 8, 12) AND (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
                   GROUP BY rep.zone, e.zone HAVING count(*) % 2 = 1)
        SELECT id, zone FROM hit WHERE zone IN (SELECT zone FROM inside)""",
        POINT_SQL,
    ),
)
def domain_clip(spark, d):
    z = zones(spark, d)
    domain = z.where("zone IN (6, 7, 8, 12)").select(F.col("zone").alias("dom"), "ring")
    kept = spatial.representative_inside(z, domain, "zone", "dom", "ring", 1.0)
    return polygons.points_in_polygons(points(spark, d), kept, "zone", "ring", 1.0).select("id", "zone")


@query(
    "overlap_share",
    bind.with_sql(
        """, b AS (SELECT id, min(zone) AS basin FROM hit GROUP BY id), c AS (SELECT id, max(zone) % 5 AS country FROM hit GROUP BY id),
        n AS (SELECT basin, count(*) AS n FROM b GROUP BY basin)
        SELECT basin, country, count(*) AS n_shared, round(count(*) / any_value(n.n), 9) AS share FROM b JOIN c USING (id) JOIN n USING (basin) GROUP BY basin, country""",
        POINT_SQL,
    ),
)
def overlap_share(spark, d):
    hits = polygons.points_in_polygons(points(spark, d), zones(spark, d), "zone", "ring", 1.0)
    basins = hits.groupBy("id").agg(F.min("zone").alias("basin"))
    countries = hits.groupBy("id").agg((F.max("zone") % 5).alias("country"))
    out = spatial.overlap_shares(basins, countries, "basin", "country", ["id"])
    return out.withColumn("share", F.round("share", 9))


@query(
    "building_coverage",
    bind.with_sql(
        """, h AS (SELECT lon, lat, 0.02e0 + (id % 5) * 0.01e0 AS s FROM pts),
        c AS (SELECT DISTINCT fr, fc FROM h, LATERAL (SELECT unnest(generate_series(CAST(floor(lat / 0.02e0) AS BIGINT), CAST(floor((lat + s) / 0.02e0) AS BIGINT))) AS fr) a,
              LATERAL (SELECT unnest(generate_series(CAST(floor(lon / 0.02e0) AS BIGINT), CAST(floor((lon + s) / 0.02e0) AS BIGINT))) AS fc) b)
        SELECT CAST(floor(fr / 5) AS BIGINT) AS "row", CAST(floor(fc / 5) AS BIGINT) AS col, round(count(*) / 25.0::DOUBLE, 6) AS fraction FROM c GROUP BY 1, 2""",
        POINT_SQL,
    ),
)
def building_coverage(spark, d):
    p = points(spark, d)
    size = 0.02 + (F.col("id") % 5) * 0.01
    pt = lambda dx, dy: F.struct((F.col("lon") + size * dx).alias("lon"), (F.col("lat") + size * dy).alias("lat"))
    houses = p.select("id", F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1)).alias("ring"))
    out = polygons.coverage_fraction(houses, "id", "ring", 0.1)
    return out.withColumn("fraction", F.round("fraction", 6))


@query(
    "extent_snap",
    bind.with_sql(
        """SELECT round(floor(min(lon) / 0.25) * 0.25, 6) AS west, round(floor(min(lat) / 0.25) * 0.25, 6) AS south, round(ceil(max(lon) / 0.25) * 0.25, 6) AS east, round(ceil(max(lat) / 0.25) * 0.25, 6) AS north,
          CAST(round((ceil(max(lon) / 0.25) * 0.25 - floor(min(lon) / 0.25) * 0.25) / 0.25) AS BIGINT) AS n_cols, CAST(round((ceil(max(lat) / 0.25) * 0.25 - floor(min(lat) / 0.25) * 0.25) / 0.25) AS BIGINT) AS n_rows FROM pts""",
        POINT_SQL,
    ),
)
def extent_snap(spark, d):
    out = spatial.snapped_extent(points(spark, d), "lon", "lat", 0.25)
    return out.select(*[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")], "n_cols", "n_rows")


@query(
    "utm_zones",
    bind.with_sql(
        """SELECT id, CAST(CASE WHEN lat - 5 >= 0 THEN 32600 ELSE 32700 END + floor((lon * 36 - 180 + 180) / 6) + 1 AS INTEGER) AS epsg,
          round(abs(lat) * 111.0e0 * cos(radians((0 + lat) * 0.5)) * lon * 111.0e0, 3) AS box_km2 FROM pts""",
        POINT_SQL,
    ),
)
def utm_zones(spark, d):
    p = points(spark, d)
    z = F.lit(0.0)
    return p.select(
        "id", terrain.utm_zone(F.col("lon") * 36 - 180, F.col("lat") - 5).alias("epsg"),
        F.round(terrain.box_area_km2(z, z, F.col("lon"), F.col("lat")), 3).alias("box_km2"),
    )


# ---- regridding: suppliers as a regular grid of 10 columns

_SRC = """
src AS (SELECT s_suppkey // 10 AS "row", s_suppkey % 10 AS col, CASE WHEN s_suppkey % 17 <> 3 THEN s_acctbal END AS value FROM supplier),
tgt AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * 2.4 - 5.1 AS lat, (c_custkey * 104729 % 10009) / 10009.0::DOUBLE * 2.4 + 29.9 AS lon FROM customer)
"""


def _source(spark, d):
    k = F.col("s_suppkey")
    return bind.table(spark, d, "supplier").select(
        F.floor(k / 10).cast("int").alias("row"), (k % 10).cast("int").alias("col"), F.when(k % 17 != 3, F.col("s_acctbal")).alias("value")
    )


def _targets(spark, d):
    k = F.col("c_custkey")
    return bind.table(spark, d, "customer").select(
        k.alias("id"), ((k * 7919 % 10007) / F.lit(10007.0) * 2.4 - 5.1).alias("lat"), ((k * 104729 % 10009) / F.lit(10009.0) * 2.4 + 29.9).alias("lon")
    )


def _bilinear_sql(inside: bool) -> str:
    keep = "WHERE y BETWEEN 0 AND 9 AND x BETWEEN 0 AND 9" if inside else ""
    return f""", p AS (SELECT id, (lat + 5) / 0.25e0 AS y, (lon - 30) / 0.25e0 AS x FROM tgt), q AS (SELECT * FROM p {keep}),
    f AS (SELECT id, least(greatest(floor(y), 0), 8) AS r, least(greatest(floor(x), 0), 8) AS c, y, x FROM q),
    w AS (SELECT id, r + dr AS "row", c + dc AS col, (CASE dr WHEN 1 THEN y - r ELSE 1 - (y - r) END) * (CASE dc WHEN 1 THEN x - c ELSE 1 - (x - c) END) AS w
          FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dr, dc))
    SELECT id, CASE WHEN count(value) = count(*) THEN round(sum(w * value), 6) END AS value FROM w LEFT JOIN src USING ("row", col) WHERE w <> 0 GROUP BY id"""


@query("bilinear_regrid", bind.with_sql(_bilinear_sql(True), _SRC))
def bilinear_regrid(spark, d):
    weights = align.bilinear_weights(_targets(spark, d), "id", -5.0, 30.0, 0.25, 10, 10)
    out = align.apply_weights(_source(spark, d), weights, "id", ["value"])
    return out.withColumn("value", F.round("value", 6))


@query("bilinear_extrapolate", bind.with_sql(_bilinear_sql(False), _SRC))
def bilinear_extrapolate(spark, d):
    weights = align.bilinear_weights(_targets(spark, d), "id", -5.0, 30.0, 0.25, 10, 10, extrapolate=True)
    out = align.apply_weights(_source(spark, d), weights, "id", ["value"])
    return out.withColumn("value", F.round("value", 6))


@query(
    "nearest_align",
    bind.with_sql(
        """, n AS (SELECT id, least(greatest(ceil((lat + 5) / 0.25e0 - 0.5), 0), 9) AS "row", least(greatest(ceil((lon - 30) / 0.25e0 - 0.5), 0), 9) AS col FROM tgt)
        SELECT id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, value FROM n LEFT JOIN src USING ("row", col)""",
        _SRC,
    ),
)
def nearest_align(spark, d):
    placed = _targets(spark, d).select(
        "id", align.nearest_on_regular_axis(F.col("lat"), -5.0, 0.25, 10).alias("row"), align.nearest_on_regular_axis(F.col("lon"), 30.0, 0.25, 10).alias("col")
    )
    return placed.join(_source(spark, d), ["row", "col"], "left").select("id", "row", "col", "value")


@query(
    "nearest_irregular",
    """WITH ax AS (SELECT DISTINCT s_acctbal AS v FROM supplier)
    SELECT c_custkey, (SELECT arg_min(v, (abs(v - c_acctbal), v)) FROM ax) AS nearest FROM customer""",
)
def nearest_irregular(spark, d):
    axis = bind.table(spark, d, "supplier").select(F.col("s_acctbal").alias("nearest")).distinct()
    return align.nearest_value(bind.table(spark, d, "customer"), "c_acctbal", axis, "nearest", "c_custkey")


@query(
    "snap_join",
    bind.with_sql(
        """SELECT t.id, s.value FROM tgt t JOIN src s ON CAST(round(t.lat * 10) AS BIGINT) = CAST(round((-5.0 + 0.1 * s."row") * 10) AS BIGINT)
           AND CAST(round(t.lon * 10) AS BIGINT) = CAST(round((30.0 + 0.1 * s.col) * 10) AS BIGINT)""",
        _SRC,
    ),
)
def snap_join(spark, d):
    keys = lambda df, lat, lon: df.withColumns({"a": align.snap(lat), "b": align.snap(lon)})
    t = keys(_targets(spark, d), F.col("lat"), F.col("lon"))
    s = keys(_source(spark, d), F.col("row") * 0.1 - 5.0, F.col("col") * 0.1 + 30.0)
    return t.join(s, ["a", "b"]).select("id", "value")


@query(
    "block_resample",
    """WITH c AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_retailprice AS v FROM part)
    SELECT CAST(r // 4 AS INTEGER) AS "row", CAST(c // 4 AS INTEGER) AS col, round(avg(v), 6) AS mean_value, max(v) AS max_value FROM c GROUP BY 1, 2""",
)
def block_resample(spark, d):
    k = F.col("p_partkey")
    fine = bind.table(spark, d, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), F.col("p_retailprice").alias("v"))
    mean = align.block_resample(fine, "row", "col", 4, "v").withColumnRenamed("v", "mean_value")
    top = align.block_resample(fine, "row", "col", 4, "v", "max").withColumnRenamed("v", "max_value")
    return mean.join(top, ["row", "col"]).withColumn("mean_value", F.round("mean_value", 6))


@query(
    "code_lookup",
    """SELECT p_partkey, coalesce(r_name, 'UNKNOWN') AS region_name, p_size FROM part LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON r_regionkey = p_size % 7""",
)
def code_lookup(spark, d):
    parts = bind.table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") % 7).alias("r_regionkey"))
    names = bind.table(spark, d, "region").where("r_regionkey <> 3").withColumnRenamed("r_name", "region_name")
    return align.lookup(parts, names, ["r_regionkey"], {"region_name": "UNKNOWN"}).select("p_partkey", "region_name", "p_size")


@query(
    "idw_interp",
    """WITH g AS (SELECT r_regionkey AS gauge, r_regionkey * 3000.0::DOUBLE AS x, r_regionkey * r_regionkey * 1000.0::DOUBLE AS y, 10.0::DOUBLE + r_regionkey * 7 AS rain FROM region),
    c AS (SELECT p_partkey AS id, (p_partkey % 50) * 300.0::DOUBLE AS x, (p_partkey // 50) * 300.0::DOUBLE AS y FROM part),
    w AS (SELECT id, rain, 1 / power(greatest(power(c.x - g.x, 2) + power(c.y - g.y, 2), 1e6), 2) AS w FROM c, g)
    SELECT id, round(sum(w * rain) / sum(w), 9) AS rain FROM w GROUP BY id""",
)
def idw_interp(spark, d):
    r, k = F.col("r_regionkey"), F.col("p_partkey")
    gauges = bind.table(spark, d, "region").select(
        r.alias("gauge"), (r * F.lit(3000.0)).alias("x"), (r * r * F.lit(1000.0)).alias("y"), (F.lit(10.0) + r * 7).alias("rain")
    )
    cells = bind.table(spark, d, "part").select(k.alias("id"), ((k % 50) * F.lit(300.0)).alias("x"), (F.floor(k / 50) * F.lit(300.0)).alias("y"))
    out = spatial.inverse_distance(cells, gauges, ["id"], "x", "y", "rain")
    return out.withColumn("rain", F.round("rain", 9))
