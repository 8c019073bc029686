"""Land surface, rainfall-runoff and stage operators on the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.operators import hydro, terrain
from pluvion.plans import events, landsurface

QUERIES, ORACLES, query = bind.area()

# ---- parts as land cells of a 50-column grid

LAND_SQL = """
land AS (SELECT p_partkey AS cell, p_partkey // 50 AS "row", p_partkey % 50 AS col, CASE WHEN p_partkey % 53 <> 7 THEN p_retailprice + p_partkey * 37 % 101 END AS dem,
   [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 110][p_size % 12 + 1] AS worldcover, 20.0::DOUBLE + p_size AS sand, 15.0::DOUBLE + p_size % 7 AS silt, 10.0::DOUBLE + p_partkey % 45 AS clay,
   CASE WHEN p_partkey % 19 <> 0 THEN (p_partkey * 31 % 300)::DOUBLE END AS bedrock_cm, (p_partkey * 7919 % 5003)::DOUBLE AS upa, [1, 2, 4, 8, 16, 32, 64, 128, 0, 255][p_size % 10 + 1] AS d8 FROM part)
"""


def land(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda vals, i: F.element_at(F.array(*[F.lit(v) for v in vals]), (i + 1).cast("int"))
    return bind.table(spark, d, "part").select(
        k.alias("cell"),
        F.floor(k / 50).alias("row"),
        (k % 50).alias("col"),
        F.when(k % 53 != 7, F.col("p_retailprice") + k * 37 % 101).alias("dem"),
        pick((10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 110), s % 12).alias("worldcover"),
        (F.lit(20.0) + s).alias("sand"),
        (F.lit(15.0) + s % 7).alias("silt"),
        (F.lit(10.0) + k % 45).alias("clay"),
        F.when(k % 19 != 0, (k * 31 % 300).cast("double")).alias("bedrock_cm"),
        (k * 7919 % 5003).cast("double").alias("upa"),
        pick((1, 2, 4, 8, 16, 32, 64, 128, 0, 255), s % 10).alias("d8"),
    )


_SLOPE = """
h AS (SELECT cell, "row", col, dem, coalesce(dem, 0) AS z, (SELECT max("row") FROM land) AS mr FROM land),
g AS (SELECT a.cell, a.dem,
   CASE WHEN a."row" = 0 THEN dn.z - a.z WHEN a."row" = a.mr THEN a.z - up.z ELSE (dn.z - up.z) / 2 END / 1000e0 AS dy,
   CASE WHEN a.col = 0 THEN rt.z - a.z WHEN a.col = 49 THEN a.z - lf.z ELSE (rt.z - lf.z) / 2 END / 1000e0 AS dx
  FROM h a LEFT JOIN h up ON up."row" = a."row" - 1 AND up.col = a.col LEFT JOIN h dn ON dn."row" = a."row" + 1 AND dn.col = a.col
   LEFT JOIN h lf ON lf."row" = a."row" AND lf.col = a.col - 1 LEFT JOIN h rt ON rt."row" = a."row" AND rt.col = a.col + 1),
sl AS (SELECT cell, CASE WHEN dem IS NOT NULL THEN least(greatest(sqrt(dy * dy + dx * dx), 1e-4), 1) END AS slope FROM g)
"""


@query("hillslope", bind.with_sql("SELECT cell, round(slope, 9) AS slope FROM sl", LAND_SQL, _SLOPE))
def hillslope(spark, d):
    return terrain.slope(land(spark, d), "dem", 1000.0).select("cell", F.round("slope", 9).alias("slope"))


def _class_sql(values: dict[int, float], default: str) -> str:
    return "CASE worldcover " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {default} END::DOUBLE"


# The same numbers as the operator's tables, written out here a second time.
_LAND_SQL_CLASSES = {
    "n_surface": _class_sql({10: 0.15, 20: 0.1, 30: 0.05, 40: 0.04, 50: 0.02, 60: 0.03, 70: 0.03, 80: 0.01, 90: 0.1, 95: 0.08, 100: 0.03}, "0.05"),
    "n_river": _class_sql({10: 0.05, 20: 0.04, 30: 0.035, 40: 0.035, 50: 0.03, 60: 0.03, 80: 0.03, 90: 0.04}, "0.035"),
    "kext": _class_sql({10: 0.65, 20: 0.6, 30: 0.5, 40: 0.55, 50: 0.6, 60: 0.5, 80: 0.5, 90: 0.55}, "0.55"),
    "rooting_depth": _class_sql({10: 2000, 20: 1000, 30: 600, 40: 800, 50: 200, 60: 100, 90: 500}, "500"),
    "path_frac": _class_sql({40: 0.05, 50: 0.6, 60: 0.1}, "0"),
    "leaf_storage": _class_sql({10: 0.12, 20: 0.08, 30: 0.04, 40: 0.05, 50: 0.02, 60: 0.01, 90: 0.06}, "0.04"),
    "wood_storage": _class_sql({10: 0.5, 20: 0.2, 40: 0.05, 90: 0.1}, "0"),
    "lai_base": _class_sql({10: 5.0, 20: 2.5, 30: 1.5, 40: 2.0, 50: 0.5, 60: 0.2, 90: 2.0}, "NULL"),
    "water_frac": _class_sql({80: 1}, "0"),
}
_LAND_SQL_CONSTANTS = {
    "cfmax": 3.75653, "g_cfmax": 5.3, "tt": 0.0, "tti": 2.0, "ttm": 0.0, "g_tt": 1.3, "g_sifrac": 0.002, "whc": 0.1, "cf_soil": 0.038,
    "infilt_cap_path": 5.0, "infilt_cap_soil": 600.0,
}
_LAND_SQL_LAYERS = ", ".join(
    f"CASE WHEN ok THEN round(7.5 + 6.5 * least(greatest(1 / (1 + least(greatest(0.131 + 0.00125 * s * 100 - 0.00207 * c * 100, 0.1), 0.5)), 0.05), 0.2) * {f}, 9) END AS c_{i}, "
    f"CASE WHEN ok THEN round(least(greatest(kb * exp(-f * {depth}), 1), 5000), 6) END AS kv_{i}"
    for i, (f, depth) in enumerate(((1.0, 25), (0.95, 125), (0.9, 300), (0.85, 750)), 1)
)
_LAND_OUT = f"""
, ld AS (SELECT *, dem IS NOT NULL AS ok, coalesce(dem IS NOT NULL AND upa >= 10, false) AS rv, sand / 100 / ((sand + clay + silt) / 100) AS s, clay / 100 / ((sand + clay + silt) / 100) AS c,
        CASE WHEN sand / 100 > 0.6 THEN 2000.0 WHEN clay / 100 > 0.4 THEN 50.0 ELSE 500.0 END AS kb, least(greatest(0.001 + 0.003 * clay / 100, 0.0003), 0.01) AS f,
        CASE WHEN bedrock_cm IS NULL THEN 2000.0 ELSE least(greatest(bedrock_cm * 10, 300), 2500) END AS th,
        CAST(CASE WHEN dem IS NULL THEN NULL WHEN "row" = 0 OR col = 0 OR col = 49 OR "row" = (SELECT max("row") FROM land) THEN 5
          ELSE CASE d8 WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 8 THEN 1 WHEN 16 THEN 4 WHEN 32 THEN 7 WHEN 64 THEN 8 WHEN 128 THEN 9 ELSE 5 END END AS INTEGER) AS ldd FROM land),
best AS (SELECT arg_min(cell, (-upa, "row", col)) AS cell FROM ld WHERE ldd = 5)
SELECT cell, ldd, rv AS river, round(slope, 9) AS slope, CASE WHEN ok THEN 1e0 END AS subcatchment, CASE WHEN cell = (SELECT cell FROM best) THEN 1e0 END AS gauge, CASE WHEN cell = (SELECT cell FROM best) THEN 1e0 END AS pit,
  CAST(CASE WHEN ok THEN worldcover END AS INTEGER) AS landuse,
  CASE WHEN rv THEN round(least(greatest(1.22 * power(upa, 0.557), 30), 500), 6) END AS river_width, CASE WHEN rv THEN round(least(greatest(0.27 * power(upa, 0.39), 1), 5), 6) END AS river_depth,
  CASE WHEN rv THEN round(dem - least(greatest(0.27 * power(upa, 0.39), 1), 5), 6) END AS river_bed, CASE WHEN rv THEN round(least(greatest(slope, 1e-5), 0.1), 9) END AS river_slope, CASE WHEN rv THEN 1414e0 END AS river_length,
  CASE WHEN rv THEN CAST((upa >= 10)::INT + (upa >= 50)::INT + (upa >= 100)::INT + (upa >= 500)::INT + (upa >= 1000)::INT + (upa >= 2000)::INT + (upa >= 3000)::INT + (upa >= 4000)::INT AS INTEGER) END AS stream_order,
  CASE WHEN ok THEN round(least(greatest(0.332 - 0.0007251 * s * 100 + 0.1276 * log10(c * 100 + 1), 0.35), 0.55), 9) END AS theta_s,
  CASE WHEN ok THEN round(least(greatest(0.01 + 0.003 * c * 100, 0.05), 0.25), 9) END AS theta_r, {_LAND_SQL_LAYERS},
  CASE WHEN ok THEN th END::DOUBLE AS soil_thickness, CASE WHEN ok THEN least(greatest(th * 0.5, 100), 1500) END::DOUBLE AS soil_rooting_depth, CASE WHEN ok THEN kb END::DOUBLE AS ksat, CASE WHEN ok THEN round(f, 9) END AS decay,
  CASE WHEN ok THEN round(least(greatest(th / f, 50), 1500), 6) END AS m_param,
  {", ".join(f"CASE WHEN {'rv' if n == 'n_river' else 'ok'} THEN {c} END AS {n}" for n, c in _LAND_SQL_CLASSES.items())},
  {", ".join(f"CASE WHEN ok THEN {v!r}::DOUBLE END AS {n}" for n, v in _LAND_SQL_CONSTANTS.items())}
FROM ld JOIN sl USING (cell)
"""


@query("land_surface", bind.with_sql(_LAND_OUT, LAND_SQL, _SLOPE))
def land_surface(spark, d):
    t = landsurface.parameter_table(land(spark, d), 1000.0)
    digits = {"slope": 9, "river_width": 6, "river_depth": 6, "river_bed": 6, "river_slope": 9, "river_length": 6, "theta_s": 9, "theta_r": 9, "m_param": 6, "decay": 9}
    digits |= {f"c_{i}": 9 for i in range(1, 5)} | {f"kv_{i}": 6 for i in range(1, 5)}
    given = set(land(spark, d).columns) - {"cell"}
    t = t.withColumns({"river": F.coalesce("river", F.lit(False)), "stream_order": F.col("stream_order").cast("int")})
    return t.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in t.columns if c not in given])


@query(
    "leaf_area_months",
    bind.with_sql(
        """SELECT cell, CAST(m AS INTEGER) AS month, round(CASE WHEN b * f > 0 THEN b * f ELSE 1.0 END, 9) AS lai
        FROM (SELECT cell, CASE worldcover WHEN 10 THEN 5.0 WHEN 20 THEN 2.5 WHEN 30 THEN 1.5 WHEN 40 THEN 2.0 WHEN 50 THEN 0.5 WHEN 60 THEN 0.2 WHEN 90 THEN 2.0 END::DOUBLE AS b FROM land),
          (SELECT unnest(generate_series(1, 12)) AS m, unnest([0.85e0, 0.9e0, 0.95e0, 1e0, 0.95e0, 0.8e0, 0.65e0, 0.55e0, 0.65e0, 0.8e0, 0.9e0, 0.9e0]) AS f)""",
        LAND_SQL,
    ),
)
def leaf_area_months(spark, d):
    base = land(spark, d).select("cell", terrain.land_parameters(F.col("worldcover"))["lai_base"].alias("b"))
    out = terrain.monthly_leaf_area(base, ["cell"], "b")
    return out.withColumn("lai", F.round("lai", 9))


@query(
    "main_outlet",
    bind.with_sql(
        """, p AS (SELECT cell, upa, CASE WHEN d8 IN (0, 255) THEN 5 ELSE 1 END AS ldd FROM land)
        SELECT arg_max(cell, (upa, -cell)) AS cell, max(upa) AS upa FROM p WHERE ldd = 5""",
        LAND_SQL,
    ),
)
def main_outlet(spark, d):
    cells = land(spark, d).withColumn("ldd", F.when(F.col("d8").isin(0, 255), 5).otherwise(1))
    return terrain.main_outlet(cells, "cell", "ldd", "upa")


@query(
    "stream_order_bands",
    bind.with_sql(
        """SELECT CAST((upa >= 10)::INT + (upa >= 50)::INT + (upa >= 100)::INT + (upa >= 500)::INT + (upa >= 1000)::INT + (upa >= 2000)::INT + (upa >= 3000)::INT + (upa >= 4000)::INT AS INTEGER) AS stream_order, count(*) AS n FROM land GROUP BY 1""",
        LAND_SQL,
    ),
)
def stream_order_bands(spark, d):
    return land(spark, d).groupBy(terrain.stream_order(F.col("upa")).cast("int").alias("stream_order")).agg(F.count("*").alias("n"))


@query(
    "parameter_repair",
    bind.with_sql(
        """, w AS (SELECT cell, upa > 2000 AS river, CASE WHEN cell % 4 <> 0 THEN clay END AS river_width, CASE WHEN cell % 5 <> 0 THEN sand WHEN cell % 2 = 0 THEN 0.0 END AS theta FROM land)
        SELECT cell, coalesce(river_width, CASE WHEN river THEN (SELECT median(river_width) FROM w WHERE river) ELSE 0.0 END) AS river_width,
          CASE WHEN theta <> 0 THEN theta ELSE (SELECT median(theta) FROM w WHERE theta <> 0) END AS theta FROM w""",
        LAND_SQL,
    ),
)
def parameter_repair(spark, d):
    k = F.col("cell")
    w = land(spark, d).select(
        "cell", (F.col("upa") > 2000).alias("river"), F.when(k % 4 != 0, F.col("clay")).alias("river_width"),
        F.when(k % 5 != 0, F.col("sand")).when(k % 2 == 0, 0.0).alias("theta"),
    )
    fixed = terrain.repair_land(terrain.repair_river(w, "river", ["river_width"]), ["theta"])
    return fixed.select("cell", "river_width", "theta")


@query(
    "daily_roughness",
    """WITH c AS (SELECT p_partkey AS cell, p_size % 11 AS k FROM part), v AS (SELECT cell, [0.025e0, 0.08e0, 0.035e0, 0.055e0, 0.038e0, 0.045e0, 0.013e0, 0.028e0, 0.01e0][k + 1] AS n FROM c)
    SELECT cell, round(coalesce(n, (SELECT median(n) FROM v)), 9) AS roughness FROM v""",
)
def daily_roughness(spark, d):
    cells = bind.table(spark, d, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_size") % 11).alias("k"))
    return terrain.daily_roughness(cells, "k").select("cell", F.round("roughness", 9).alias("roughness"))


@query(
    "class_histogram",
    bind.with_sql("SELECT worldcover, count(*) AS n_cells, round(100.0 * count(*) / (SELECT count(*) FROM land), 9) AS pct FROM land GROUP BY worldcover", LAND_SQL),
)
def class_histogram(spark, d):
    return terrain.class_histogram(land(spark, d), "worldcover").withColumn("pct", F.round("pct", 9))


@query(
    "channel_burn",
    bind.with_sql(
        """, f AS (SELECT l_partkey AS cell, max(CASE l_linenumber WHEN 2 THEN 0.5e0 WHEN 3 THEN 1e0 WHEN 4 THEN 1.5e0 WHEN 5 THEN 2.5e0 WHEN 6 THEN 3.5e0 WHEN 7 THEN 4.5e0 ELSE 0.5e0 END) AS depth
             FROM lineitem WHERE l_quantity > 47 GROUP BY l_partkey),
        b AS (SELECT land.cell, dem, coalesce(depth, CASE WHEN clay = 12 THEN 0.3e0 ELSE 0e0 END) AS channel_depth FROM land LEFT JOIN f USING (cell))
        SELECT cell, channel_depth, round(dem - channel_depth, 6) AS burned, round(coalesce(greatest(dem - (dem - channel_depth), 0), 0), 6) AS initial_water,
          round(coalesce(greatest(dem - channel_depth + 1.25e0 - dem, 0), 0), 6) AS ground_depth FROM b""",
        LAND_SQL,
    ),
)
def channel_burn(spark, d):
    depth = terrain.code_lookup(F.col("l_linenumber"), terrain.ORDER_DEPTH, terrain.DEFAULT_DEPTH)
    footprint = bind.table(spark, d, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("cell"), depth.alias("depth"))
    cells = land(spark, d).select("cell", "dem", (F.col("clay") - 12).alias("hnd"))
    out = terrain.burn_channels(cells, footprint, ["cell"], "dem", "depth", "hnd")
    ground = terrain.depth_above_ground(F.lit(1.25), F.col("burned"), F.col("dem"))
    return out.select(
        "cell", "channel_depth", F.round("burned", 6).alias("burned"), F.round("initial_water", 6).alias("initial_water"), F.round(ground, 6).alias("ground_depth")
    )


@query(
    "order_lookup",
    """SELECT p_partkey, CASE k WHEN 2 THEN 15.0 WHEN 3 THEN 30.0 WHEN 4 THEN 60.0 WHEN 5 THEN 120.0 WHEN 6 THEN 180.0 WHEN 7 THEN 240.0 ELSE 15.0 END::DOUBLE AS width,
         round(0.001e0 * CASE k WHEN 3 THEN 95 WHEN 4 THEN 375 WHEN 5 THEN 1500 ELSE 24 END, 9) AS base_flow, least(greatest(p_size * 250 / 10000.0::DOUBLE, 0), 1) AS sealed
       FROM (SELECT *, p_size % 9 AS k FROM part)""",
)
def order_lookup(spark, d):
    k = F.col("p_size") % 9
    area = terrain.code_lookup(k, terrain.ORDER_UPSTREAM, terrain.DEFAULT_UPSTREAM)
    return bind.table(spark, d, "part").select(
        "p_partkey", terrain.code_lookup(k, terrain.ORDER_WIDTH, terrain.DEFAULT_WIDTH).alias("width"),
        F.round(hydro.base_flow(area, 0.001), 9).alias("base_flow"), terrain.sealed_fraction(F.col("p_size") * 250.0).alias("sealed"),
    )


# ---- rainfall, unit hydrographs and stage

# The shares written out: a twentieth over three steps, 65 % in the burst, 15 % in the decline, 15 % over 32 steps.
_PROFILE = (
    "[0.05e0 / 3, 0.05e0 / 3, 0.05e0 / 3, 0.04e0 * 0.65e0, 0.08e0 * 0.65e0, 0.14e0 * 0.65e0, 0.2e0 * 0.65e0, 0.2e0 * 0.65e0, 0.16e0 * 0.65e0, 0.11e0 * 0.65e0, 0.07e0 * 0.65e0, "
    "0.05e0 / 0.15e0 * 0.15e0, 0.04e0 / 0.15e0 * 0.15e0, 0.03e0 / 0.15e0 * 0.15e0, 0.02e0 / 0.15e0 * 0.15e0, 0.01e0 / 0.15e0 * 0.15e0, " + ", ".join(["0.15e0 / 32"] * 32) + "]"
)


@query(
    "storm_steps",
    f"""SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS step, round(o_totalprice / 1000 * {_PROFILE}[i] / 1000 / 1800 * 1e9 + 1e-8, 6) AS intensity FROM orders, generate_series(1, 48) t(i)""",
)
def storm_steps(spark, d):
    o = bind.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("rain"))
    out = hydro.rainfall_steps(o, ["o_orderkey"], "rain")
    return out.select("o_orderkey", "step", F.round(F.col("intensity") * 1e9 + 1e-8, 6).alias("intensity"))


_UH_SQL = """
tc AS (SELECT c_custkey AS id, 0.3e0 * power(5 + c_custkey % 97, 0.4e0) AS tc FROM customer),
fx AS (SELECT id, i AS k, CASE WHEN i * 0.5e0 <= tc THEN i * 0.5e0 / tc WHEN i * 0.5e0 <= 2 * tc THEN (2 * tc - i * 0.5e0) / tc ELSE 0 END AS r FROM tc, generate_series(0, 47) t(i)),
lg AS (SELECT id, i AS k, CASE WHEN i * 0.5e0 <= tc THEN i * 0.5e0 / tc WHEN i * 0.5e0 <= 2.67e0 * tc THEN (2.67e0 * tc - i * 0.5e0) / (2.67e0 * tc - tc) ELSE 0 END AS r FROM tc, generate_series(0, 200) t(i) WHERE i <= ceil(2.67e0 * tc / 0.5e0))
"""


def _tc(spark, d):
    return bind.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), hydro.concentration_hours(F.lit(5.0) + F.col("c_custkey") % 97).alias("tc")
    )


@query(
    "unit_hydrographs",
    bind.with_sql(
        """SELECT 'fixed' AS kind, id, CAST(k AS INTEGER) AS k, round(r / sum(r) OVER (PARTITION BY id), 9) AS u FROM fx
        UNION ALL SELECT 'long', id, CAST(k AS INTEGER), round(r / (sum(r) OVER (PARTITION BY id) * 0.5e0), 9) FROM lg""",
        _UH_SQL,
    ),
)
def unit_hydrographs(spark, d):
    tc = _tc(spark, d)
    both = None
    for kind in ("fixed", "long"):
        rows = hydro.ordinate_rows(tc, ["id"], hydro.triangle(kind, F.col("tc"), 0.5)).withColumn("kind", F.lit(kind))
        both = rows if both is None else both.unionByName(rows)
    return both.select("kind", "id", "k", F.round("u", 9).alias("u"))


@query(
    "unit_hydrograph_steps",
    bind.with_sql(
        """, cv AS (SELECT 'covering' AS kind, id, i AS k, CASE WHEN i * 0.5e0 <= tc THEN i * 0.5e0 / tc WHEN i * 0.5e0 <= 2 * tc THEN (2 * tc - i * 0.5e0) / tc ELSE 0 END AS r FROM tc, generate_series(0, 200) t(i) WHERE i <= ceil(2 * tc / 0.5e0)),
        n AS (SELECT id, greatest(3, CAST(ceil(2 * tc / 0.5e0) AS INTEGER)) AS n FROM tc),
        ix AS (SELECT 'indexed' AS kind, id, i AS k, CASE WHEN i <= n // 2 THEN i / (n // 2) ELSE (n - 1 - i) / (n - 1 - n // 2) END AS r FROM n, generate_series(0, 200) t(i) WHERE i < n)
        SELECT kind, id, CAST(k AS INTEGER) AS k, round(r / sum(r) OVER (PARTITION BY kind, id), 9) AS u FROM (SELECT * FROM cv UNION ALL SELECT * FROM ix)""",
        _UH_SQL,
    ),
)
def unit_hydrograph_steps(spark, d):
    tc = _tc(spark, d)
    both = None
    for kind in ("covering", "indexed"):
        rows = hydro.ordinate_rows(tc, ["id"], hydro.triangle(kind, F.col("tc"), 0.5)).withColumn("kind", F.lit(kind))
        both = rows if both is None else both.unionByName(rows)
    return both.select("kind", "id", "k", F.round("u", 9).alias("u"))


_HOURS = """
hr AS (SELECT user_id AS river, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS step, value FROM events),
q AS (SELECT river, step, sum(value) AS q FROM hr GROUP BY ALL)
"""


def _hourly(spark, d):
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return (
        bind.table(spark, d, "events")
        .select(F.col("user_id").alias("river"), hour.cast("bigint").alias("step"), "value")
        .groupBy("river", "step")
        .agg(F.sum("value").alias("q"))
    )


@query(
    "uh_convolution",
    bind.with_sql(
        """, u AS (SELECT river, i AS k, CASE WHEN i <= 2 + river % 3 THEN 1 / (3e0 + river % 3) ELSE 0 END AS u FROM (SELECT DISTINCT river FROM q), generate_series(0, 4) t(i)),
        f AS (SELECT q.river, q.step + u.k AS step, sum(q.q * u.u) AS v FROM q JOIN u ON u.river = q.river GROUP BY 1, 2)
        SELECT q.river, q.step, round(coalesce(v, 0), 6) AS q FROM q LEFT JOIN f ON f.river = q.river AND f.step = q.step""",
        _HOURS,
    ),
)
def uh_convolution(spark, d):
    flow = _hourly(spark, d)
    n = F.col("river") % 3
    shape = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i <= 2 + n, 1.0 / (3.0 + n)).otherwise(0.0))
    ordinates = hydro.ordinate_rows(flow.select("river").distinct(), ["river"], shape)
    return hydro.convolve(flow, ordinates, ["river"], "step", "q").withColumn("q", F.round("q", 6))


@query(
    "event_rain_totals",
    bind.with_sql(
        """SELECT river, round(sum(r) * 0.5, 6) AS total_mm, round(max(r), 6) AS peak_rate, count(*) FILTER (r > 20) AS wet_steps FROM (SELECT river, step, avg(value) AS r FROM hr GROUP BY river, step) GROUP BY river""",
        _HOURS,
    ),
)
def event_rain_totals(spark, d):
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)")
    rows = bind.table(spark, d, "events").select(F.col("user_id").alias("river"), hour.alias("step"), "value")
    out = hydro.event_totals(rows, ["river"], "step", "value", wet=20.0)
    return out.withColumns({c: F.round(c, 6) for c in ("total_mm", "peak_rate")})


@query(
    "padded_flow",
    """WITH f AS (SELECT l_suppkey AS river, CAST(l_linenumber AS INTEGER) AS step, sum(l_quantity) * 3.0 / 2.0 AS q FROM lineitem GROUP BY 1, 2)
    SELECT r.river, CAST(i AS INTEGER) AS step, coalesce(q, 0) AS q FROM (SELECT DISTINCT river FROM f) r, generate_series(0, 5) t(i) LEFT JOIN f ON f.river = r.river AND f.step + 1 = i""",
)
def padded_flow(spark, d):
    flow = (
        bind.table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("river"), F.col("l_linenumber").alias("step"))
        .agg(hydro.scale_flow(F.sum("l_quantity"), 3.0, 2.0).alias("q"))
    )
    return hydro.pad_first(flow, ["river"], "step", "q", 6)


@query(
    "wide_channel_stage",
    """SELECT o_orderkey, round(100 + power(greatest(q, 0) * 0.035e0 / (15 * sqrt(0.005e0)), 0.6e0), 6) AS event_stage, round(100 + least(power(greatest(q, 0) * 0.04e0 / (20 * sqrt(0.003e0)), 0.6e0), 15), 6) AS river_stage
       FROM (SELECT o_orderkey, o_totalprice / 50 - 200 AS q FROM orders)""",
)
def wide_channel_stage(spark, d):
    q, bed = F.col("o_totalprice") / 50 - 200, F.lit(100.0)
    e, r = hydro.EVENT_CHANNEL, hydro.RIVER_CHANNEL
    return bind.table(spark, d, "orders").select(
        "o_orderkey",
        F.round(hydro.wide_channel_stage(q, bed, e["n"], e["width"], e["slope"]), 6).alias("event_stage"),
        F.round(hydro.wide_channel_stage(q, bed, r["n"], r["width"], r["slope"], r["cap"]), 6).alias("river_stage"),
    )


_N, _S = hydro.CULVERT["n"], hydro.CULVERT["slope"]
_K = math.sqrt(_S) / _N


def _bisect_sql(width: float, top: float, rounds: int, lo: str = "0.001e0") -> str:
    """Normal depth by halving, written as one recursive query."""
    flow = f"{width}e0 * (lo + hi) / 2 * power({width}e0 * (lo + hi) / 2 / ({width}e0 + lo + hi), 2e0 / 3) * {_K!r}"
    return f"""SELECT id, q, {lo} AS lo, {top}e0 AS hi, 0 AS n FROM src UNION ALL
      SELECT id, q, CASE WHEN {flow} < q THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {flow} < q THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM b WHERE n < {rounds}"""


@query(
    "open_channel_stage",
    f"""WITH RECURSIVE src AS (SELECT c_custkey AS id, c_acctbal / 20 AS q FROM customer), b(id, q, lo, hi, n) AS ({_bisect_sql(5.0, 20.0, 60)})
    SELECT id, round(50 + CASE WHEN q > 0 THEN greatest((lo + hi) / 2, 0) ELSE 0 END, 2) AS stage, round(50 + CASE WHEN q > 0 THEN least((lo + hi) / 2, 1.5) ELSE 0 END, 2) AS capped FROM b WHERE n = 60""",
)
def open_channel_stage(spark, d):
    rows = bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 20).alias("q"), F.lit(50.0).alias("bed"))
    free = hydro.rating_stage(rows, "q", "bed", 5.0, _N, _S, 20.0)
    capped = F.least(F.col("stage"), F.col("bed") + hydro.STAGE_CAP)
    return free.select("id", F.round("stage", 2).alias("stage"), F.round(capped, 2).alias("capped"))


# Flow of the full culvert by hand: 3 m wide, 2 m high, slope 0.002, roughness 0.014.
_FULL = 6.0 * (6.0 / 7.0) ** (2.0 / 3.0) * math.sqrt(0.002) / 0.014


@query(
    "culvert_stage",
    f"""WITH RECURSIVE src AS (SELECT c_custkey AS id, c_acctbal / 300 AS q FROM customer), b(id, q, lo, hi, n) AS ({_bisect_sql(3.0, 2.0, 50)}),
    d AS (SELECT id, q, (lo + hi) / 2 AS d FROM b WHERE n = 50)
    SELECT id, round(10 + CASE WHEN q <= 0 THEN 0 WHEN q <= {_FULL!r} THEN d ELSE least(2 + power((q - {_FULL!r}) / (0.6e0 * 3 * sqrt(2 * 9.81e0)), 2e0 / 3), 10) END, 2) AS stage,
      round(10 + CASE WHEN q <= 0 THEN 0 WHEN q <= {_FULL!r} THEN d ELSE 1.5 END, 2) AS capped FROM d""",
)
def culvert_stage(spark, d):
    rows = bind.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 300).alias("q"), F.lit(10.0).alias("bed"))
    free = hydro.culvert_stage(rows, "q", "bed").select("id", F.round("stage", 2).alias("stage"))
    capped = hydro.culvert_stage(rows, "q", "bed", capped=True).select("id", F.round("stage", 2).alias("capped"))
    return free.join(capped, "id")


@query(
    "unit_conversion",
    """SELECT o_orderkey, round(o_totalprice / 1000 - 273.15e0, 6) AS celsius, round(greatest((o_totalprice - 100000) / 86400, 0) + 1e-9, 6) AS watts, round(greatest((o_totalprice - 100000) / 1e6 * 1000, 0), 6) AS mm FROM orders""",
)
def unit_conversion(spark, d):
    p = F.col("o_totalprice")
    r = lambda c, n: F.round(c, 6).alias(n)
    return bind.table(spark, d, "orders").select(
        "o_orderkey", r(hydro.to_units("2t", p / 1000), "celsius"), r(hydro.to_units("ssrd", p - 100000) + 1e-9, "watts"), r(hydro.to_units("tp", (p - 100000) / 1e6), "mm")
    )


@query(
    "deaccumulated",
    bind.with_sql(
        """, c AS (SELECT river, step, sum(q) OVER (PARTITION BY river ORDER BY step) AS cum FROM q), l AS (SELECT river, step, cum - lag(cum) OVER (PARTITION BY river ORDER BY step) AS q FROM c)
        SELECT river, step, round(q, 6) AS q FROM l WHERE q IS NOT NULL""",
        _HOURS,
    ),
)
def deaccumulated(spark, d):
    from pluvion.operators.temporal import running_total

    cum = running_total(_hourly(spark, d), ["river"], "step", F.col("q"), "cum").select("river", "step", F.col("cum").alias("q"))
    return hydro.deaccumulate(cum, ["river"], "step", "q").withColumn("q", F.round("q", 6))


@query(
    "event_hydrographs",
    bind.with_sql(
        f""", gg AS (SELECT r_regionkey * 3000.0::DOUBLE AS x, r_regionkey * r_regionkey * 1000.0::DOUBLE AS y, 10.0::DOUBLE + r_regionkey * 7 AS rain FROM region),
        en AS (SELECT c_custkey AS id, (c_custkey % 50) * 300.0::DOUBLE AS x, (c_custkey // 50) * 300.0::DOUBLE AS y, 5.0::DOUBLE + c_custkey % 97 AS area FROM customer),
        rn AS (SELECT id, area, sum(rain * w) / sum(w) AS rain FROM (SELECT id, area, rain, 1 / power(greatest(power(en.x - gg.x, 2) + power(en.y - gg.y, 2), 1e6), 2) AS w FROM en, gg) GROUP BY id, area),
        fl AS (SELECT id, i - 1 AS step, rain * {_PROFILE}[i] / 1000 / 1800 * 0.85e0 * area * 1e6 AS q FROM rn, generate_series(1, 48) t(i)),
        uh AS (SELECT id, k, r / sum(r) OVER (PARTITION BY id) AS u FROM fx),
        cv AS (SELECT fl.id, fl.step + uh.k AS step, sum(q * u) AS q FROM fl JOIN uh USING (id) WHERE fl.step + uh.k <= 47 GROUP BY 1, 2)
        SELECT id, CAST(step AS INTEGER) AS step, round(q, 6) AS q, round(100 + power(q * 0.035e0 / (15 * sqrt(0.005e0)), 0.6e0), 6) AS stage FROM cv""",
        _UH_SQL,
    ),
)
def event_hydrographs(spark, d):
    r, k = F.col("r_regionkey"), F.col("c_custkey")
    gauges = bind.table(spark, d, "region").select(
        r.alias("gauge"), (r * F.lit(3000.0)).alias("x"), (r * r * F.lit(1000.0)).alias("y"), (F.lit(10.0) + r * 7).alias("rain")
    )
    entries = bind.table(spark, d, "customer").select(
        k.alias("id"), ((k % 50) * F.lit(300.0)).alias("x"), (F.floor(k / 50) * F.lit(300.0)).alias("y"), (F.lit(5.0) + k % 97).alias("area_km2"), F.lit(100.0).alias("bed")
    )
    out = events.event_hydrographs(entries, gauges, "id")
    return out.select("id", "step", F.round("q", 6).alias("q"), F.round("stage", 6).alias("stage"))


@query(
    "event_table",
    bind.with_sql(
        """, b AS (SELECT s_nationkey AS zone, balance.cell, day, aet, pet FROM balance JOIN supplier ON s_suppkey = balance.cell WHERE s_nationkey <> 4),
        y AS (SELECT zone, cell, CAST(year(day) AS INTEGER) AS year, coalesce(sum(aet), 0) AS a, coalesce(sum(pet), 0) AS p FROM b GROUP BY ALL),
        z AS (SELECT zone, year, round_even(avg(CASE WHEN p > 1e-6 THEN least(greatest(100 * a / p, 0), 150) END), 1) AS wrsi, round_even(avg(a), 0) AS aet_mm, round_even(avg(p), 0) AS pet_mm FROM y GROUP BY ALL),
        n AS (SELECT zone, CAST(year(day) AS INTEGER) AS year, count(DISTINCT day) AS n_days FROM b GROUP BY ALL)
        SELECT n_nationkey AS zone, n_name AS event, CASE WHEN z.year IS NULL THEN 'MISSING' ELSE 'OK' END AS status, z.year, wrsi, aet_mm, pet_mm, n_days, coalesce(z.year IN (1995 + n_nationkey % 4, 1996 + n_nationkey % 4), false) AS event_year
        FROM nation LEFT JOIN z ON z.zone = n_nationkey LEFT JOIN n ON n.zone = z.zone AND n.year = z.year""",
        bind.BALANCE_SQL,
    ),
)
def event_table(spark, d):
    k = F.col("n_nationkey")
    registry = bind.table(spark, d, "nation").select(
        k.alias("zone"), F.col("n_name").alias("event"), F.array((k % 4 + 1995).cast("int"), (k % 4 + 1996).cast("int")).alias("event_years")
    )
    zones = bind.table(spark, d, "supplier").where("s_nationkey <> 4").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("zone"))
    return events.event_table(bind.balance(spark, d).join(zones, "cell"), registry, "zone", ["cell"], "day")
