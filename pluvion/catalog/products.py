"""Basin nodes, district evidence, index and forcing products on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.catalog.tables import LEAN_SQL, lean_rows
from pluvion.functions.statistics import normal_cdf
from pluvion.operators import align
from pluvion.plans import bias, evidence, forcing, nodes, spi, zonefiles
from pluvion.session import cut_lineage

QUERIES, ORACLES, query = bind.area()

# ---- suppliers as cells of a 10-column grid, nations as basins; some cells and basins lack data

NODE_SQL = """
cell AS (SELECT s_suppkey AS cell, s_nationkey AS zone_id, -5.0 + 0.25 * (s_suppkey // 10) AS lat, 30.0 + 0.25 * (s_suppkey % 10) AS lon,
   CASE WHEN s_nationkey % 6 <> 2 THEN greatest(s_acctbal, 0) / 80 END AS v, (s_suppkey * 7 % 10) / 20.0::DOUBLE AS crop FROM supplier),
zone AS (SELECT n_nationkey AS zone_id, -5.0 + 0.25 * (n_nationkey % 9) AS clat, 30.0 + 0.25 * (n_nationkey * 3 % 10) AS clon FROM nation)
"""


def _cells(spark, d):
    k = F.col("s_suppkey")
    return bind.table(spark, d, "supplier").select(
        k.alias("cell"), F.col("s_nationkey").alias("zone_id"), (F.floor(k / 10) * 0.25 - 5.0).alias("lat"), ((k % 10) * 0.25 + 30.0).alias("lon"),
        F.when(F.col("s_nationkey") % 6 != 2, F.greatest(F.col("s_acctbal"), F.lit(0.0)) / 80).alias("v"), ((k * 7 % 10) / F.lit(20.0)).alias("crop"),
    )


def _zones(spark, d):
    k = F.col("n_nationkey")
    return bind.table(spark, d, "nation").select(
        k.alias("zone_id"), ((k % 9) * 0.25 - 5.0).alias("centre_lat"), ((k * 3 % 10) * 0.25 + 30.0).alias("centre_lon")
    )


_NEAR = """
lats AS (SELECT DISTINCT lat FROM cell), lons AS (SELECT DISTINCT lon FROM cell),
dead AS (SELECT * FROM zone WHERE zone_id NOT IN (SELECT zone_id FROM cell WHERE v IS NOT NULL)),
near AS (SELECT zone_id, (SELECT arg_min(lat, (abs(lat - clat), lat)) FROM lats) AS lat, (SELECT arg_min(lon, (abs(lon - clon), lon)) FROM lons) AS lon FROM dead),
rows_ AS (SELECT zone_id, v, crop FROM cell WHERE zone_id IN (SELECT zone_id FROM cell WHERE v IS NOT NULL)
  UNION ALL SELECT near.zone_id, c.v, c.crop FROM near JOIN cell c ON c.lat = near.lat AND c.lon = near.lon)
"""


def _node_sql(source: str, klass: str, count: int, digits: int, extra: str) -> str:
    shares = ", ".join(f"coalesce(sum(crop) FILTER (k = {i}), 0) / nullif(sum(crop) FILTER (v IS NOT NULL), 0) AS s{i}" for i in range(1, count + 1))
    return f"""
kk AS (SELECT *, CASE WHEN v IS NOT NULL THEN {klass} END AS k FROM {source}),
st AS (SELECT zone_id, avg(crop) AS active, sum(crop) FILTER (v IS NOT NULL) AS tot, coalesce(min(v) FILTER (v IS NOT NULL AND crop >= 0.1), min(v)) AS low, {extra}, {shares} FROM kk GROUP BY zone_id),
cu AS (SELECT zone_id, v, sum(sum(crop)) OVER (PARTITION BY zone_id ORDER BY v) AS cw, sum(sum(crop)) OVER (PARTITION BY zone_id) AS tw FROM kk WHERE v IS NOT NULL GROUP BY zone_id, v),
md AS (SELECT zone_id, min(v) FILTER (tw > 0 AND round(cw, 9) >= round(tw / 2, 9)) AS med FROM cu GROUP BY zone_id),
fin AS (SELECT z.zone_id, st.*, CASE WHEN tot > 0 THEN med END AS m, least(1.0, active / 0.25) AS g FROM zone z LEFT JOIN st USING (zone_id) LEFT JOIN md USING (zone_id))
"""


@query(
    "wrsi_node",
    bind.with_sql(
        """SELECT zone_id, round_even(active, 4) AS crop_active_frac, round_even(m, 2) AS wrsi10_value, CASE WHEN m IS NULL OR m >= 80 THEN 'No_Stress' WHEN m >= 65 THEN 'Mild' WHEN m >= 50 THEN 'Moderate' ELSE 'Severe' END AS wrsi10_class,
          round_even(CASE WHEN tot > 0 THEN low END, 2) AS wrsi10_min, round_even(stress, 4) AS wrsi10_stress_prob, round_even(coalesce(s1 * g + 1 - g, 1), 4) AS w10_p1, round_even(coalesce(s2 * g, 0), 4) AS w10_p2,
          round_even(coalesce(s3 * g, 0), 4) AS w10_p3, round_even(coalesce(s4 * g, 0), 4) AS w10_p4 FROM fin""",
        NODE_SQL, _NEAR,
        _node_sql("rows_", "CASE WHEN v >= 80 THEN 1 WHEN v >= 65 THEN 2 WHEN v >= 50 THEN 3 ELSE 4 END", 4, 2,
                  "coalesce(sum(crop) FILTER (v < 80), 0) / nullif(sum(crop) FILTER (v IS NOT NULL), 0) AS stress"),
    ),
)
def wrsi_node(spark, d):
    cells = cut_lineage(_cells(spark, d).withColumnRenamed("v", "wrsi"))
    return nodes.wrsi_node(cells, _zones(spark, d), cells.drop("zone_id"))


@query(
    "vegetation_node",
    bind.with_sql(
        """SELECT zone_id, round_even(active, 4) AS crop_active_frac, round_even(m, 3) AS fpar_value, CASE WHEN m IS NULL THEN 'Unknown' WHEN m >= -0.5 THEN 'Healthy' WHEN m >= -1 THEN 'Mild' WHEN m >= -1.5 THEN 'Moderate' ELSE 'Severe_Decline' END AS fpar_class,
          round_even(CASE WHEN tot > 0 THEN low END, 3) AS fpar_min, round_even(crit, 4) AS fpar_critical_share, coalesce(crit > 0.25, false) AS fpar_warn, 'mfpard' AS fpar_guard,
          round_even(coalesce(s1 * g + 1 - g, 1), 4) AS fpar_p1, round_even(coalesce(s2 * g, 0), 4) AS fpar_p2, round_even(coalesce(s3 * g, 0), 4) AS fpar_p3, round_even(coalesce(s4 * g, 0), 4) AS fpar_p4, round_even(coalesce(s5 * g, 0), 4) AS fpar_p5 FROM fin""",
        NODE_SQL,
        "zc AS (SELECT zone_id, cell, v / -50 + 0.5 AS v, crop, cell % 4 AS j FROM cell)",
        _node_sql("zc", "CASE WHEN v >= -0.5 THEN 2 WHEN v >= -1 THEN 3 WHEN v >= -1.5 THEN 4 ELSE 5 END", 5, 3,
                  "coalesce(sum(crop) FILTER (v < -1 AND j >= 1), 0) / nullif(sum(crop) FILTER (v IS NOT NULL), 0) AS crit"),
    ),
)
def vegetation_node(spark, d):
    change = F.when(F.col("cell") % 4 == 0, -0.01).otherwise(-0.05)
    cells = _cells(spark, d).withColumn("z", F.col("v") / -50 + 0.5)
    cells = cells.withColumn("critical", nodes.critical_cells(F.col("z"), change, F.lit(0.4)))
    return nodes.vegetation_node(cells, _zones(spark, d), guard="mfpard")


_PHASE = """
cd AS (SELECT s_nationkey AS zone_id, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_tax <= 0.05 THEN l_quantity END AS precip, 10 + l_discount * 200 AS temp, (l_suppkey * 7 % 10) / 20.0::DOUBLE AS crop
       FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-06-30' - 150 AND DATE '1997-06-30'),
sr AS (SELECT zone_id, day, CASE WHEN sum(crop) > 0 THEN sum(precip * crop) / nullif(sum(crop) FILTER (precip IS NOT NULL), 0) ELSE avg(precip) END AS precip,
         CASE WHEN sum(crop) > 0 THEN sum(temp * crop) / sum(crop) ELSE avg(temp) END AS temp FROM cd GROUP BY zone_id, day),
e AS (SELECT min(day) AS d0, max(day) AS d1 FROM sr),
bn AS (SELECT z.zone_id, d0 + CAST(10 * k AS INTEGER) AS bin, coalesce(sum(precip), 0) AS p FROM e, generate_series(0, (d1 - d0) // 10) t(k), (SELECT DISTINCT zone_id FROM sr) z
       LEFT JOIN sr ON sr.zone_id = z.zone_id AND (sr.day - d0) // 10 = k GROUP BY z.zone_id, d0, k),
o AS (SELECT zone_id, min(bin) FILTER (p >= 140 AND f >= 250) AS onset FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY zone_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS f FROM bn) GROUP BY zone_id),
gd AS (SELECT sr.zone_id, onset, sum(greatest(temp - 10, 0)) AS gdd FROM sr JOIN o ON o.zone_id = sr.zone_id AND day >= onset GROUP BY sr.zone_id, onset),
ph AS (SELECT n_nationkey AS zone_id, onset, gdd, gdd / 1500 AS fr, gdd / 1500 <= 1 AS act FROM nation LEFT JOIN gd ON gd.zone_id = n_nationkey),
rp AS (SELECT *, CASE WHEN act THEN least(greatest((fr - 0.48e0) / 0.14e0, 0), 1) ELSE 0 END AS a, CASE WHEN act THEN least(greatest((fr - 0.63e0) / 0.14e0, 0), 1) ELSE 0 END AS b FROM ph)
"""


@query(
    "phase_node",
    bind.with_sql(
        """SELECT zone_id, '1997-06-30' AS target_date, coalesce(strftime(onset, '%Y-%m-%d'), '') AS onset_date, round_even(gdd, 1) AS gdd, round_even(fr, 3) AS stage_frac,
          ['Vegetative', 'Flowering', 'Maturation'][list_position([1 - a, a - b, b], list_max([1 - a, a - b, b]))] AS phase, coalesce(act, false) AS season_active,
          round_even(1 - a, 4) AS phase_p1, round_even(a - b, 4) AS phase_p2, round_even(b, 4) AS phase_p3 FROM rp""",
        _PHASE,
    ),
)
def phase_node(spark, d):
    q = bind.table(spark, d, "lineitem").join(
        bind.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone_id")), "l_suppkey"
    )
    daily = q.select(
        "zone_id", F.to_date("l_shipdate").alias("day"), F.when(F.col("l_tax") <= 0.05, F.col("l_quantity")).alias("precip"),
        (F.col("l_discount") * 200 + 10).alias("temp"), ((F.col("l_suppkey") * 7 % 10) / F.lit(20.0)).alias("crop"),
    )
    return nodes.phase_node(daily, _zones(spark, d), F.lit("1997-06-30").cast("date"), onset_mm=140.0, follow_mm=250.0)


# ---- district evidence: orders give the observed months, embeddings the forecast

_EVID = """
oc AS (SELECT o_custkey % 12 AS zone_id, CAST(o_custkey % 20 AS DOUBLE) - 10 AS lat, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m,
         least(greatest((o_totalprice - 250000) / 60000, -4), 4) AS spi FROM orders),
lm AS (SELECT max(m) AS m FROM oc),
om AS (SELECT zone_id, oc.m, sum(spi * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM oc, lm WHERE oc.m > lm.m - 6 GROUP BY zone_id, oc.m),
ob AS (SELECT zone_id, max(v) FILTER (om.m = lm.m) AS cur, CASE WHEN count(v) = 6 THEN regr_slope(v, om.m) END AS slope FROM om, lm GROUP BY zone_id),
fc AS (SELECT label AS zone_id, vec_id AS cell, CAST(vec_id % 20 AS DOUBLE) - 10 AS lat, 1 + (i - 1) % 8 AS lead, (i - 1) // 8 AS member, least(greatest(CAST(embedding[i] AS DOUBLE) * 10, -4), 4) AS spi, -0.5 - 0.01 * (vec_id % 50) AS rp
       FROM embeddings, unnest(generate_series(1, len(embedding))) t(i)),
pl AS (SELECT zone_id, cell, lat, lead, avg(CASE WHEN spi <= -1 THEN 1.0 ELSE 0.0 END) AS p, avg(spi) AS mean, min(spi) AS low, max(spi) AS high, stddev_pop(spi) AS sp, bool_or(spi <= rp) AS cr FROM fc WHERE member < 6 GROUP BY ALL),
pc AS (SELECT zone_id, cell, lat, max(p) AS pd, arg_min(p, lead) AS p1, arg_min(mean, lead) AS m1, arg_min(low, lead) AS l1, arg_min(high, lead) AS h1, arg_min(sp, lead) AS sp, min(low) AS em,
         CASE WHEN bool_or(cr) THEN 1.0 ELSE 0.0 END AS cr, cos(radians(lat)) AS w FROM pl GROUP BY zone_id, cell, lat),
fd AS (SELECT zone_id, sum(pd * w) / sum(w) AS pd, sum(p1 * w) / sum(w) AS p1, coalesce(sum(w) FILTER (pd >= 0.5), 0) / sum(w) AS sc, coalesce(sum(w) FILTER (cr >= 0.5), 0) / sum(w) AS hs, sum(sp * w) / sum(w) AS sp,
         sum(em * w) / sum(w) AS emm, min(em) AS emp, sum(m1 * w) / sum(w) AS m1, sum(l1 * w) / sum(w) AS l1, sum(h1 * w) / sum(w) AS h1, quantile_cont(em, 0.05) AS e5 FROM pc GROUP BY zone_id)
"""


@query(
    "district_evidence",
    bind.with_sql(
        """SELECT CAST(z AS INTEGER) AS zone_id, round_even(cur, 4) AS current_spi3, CASE WHEN cur IS NULL THEN 'Unknown' WHEN cur < -1.5 THEN 'Severe_Drought' WHEN cur < -1 THEN 'Moderate_Drought' WHEN cur < -0.5 THEN 'Mild_Drought' WHEN cur < 0.5 THEN 'Normal' ELSE 'Above_Normal' END AS current_spi3_category,
          CASE WHEN slope > 0.1 THEN 'Improving' WHEN slope < -0.1 THEN 'Deteriorating' ELSE 'Stable' END AS spi3_trend, round_even(slope, 4) AS trend_slope_spi_per_month, round_even(pd, 4) AS forecast_deficit_prob, round_even(p1, 4) AS deficit_prob_lead1,
          round_even(greatest(sc, hs), 4) AS spatial_coverage, round_even(sc, 4) AS spatial_cov_mean_p, round_even(hs, 4) AS hotspot_fraction, round_even(sp, 4) AS forecast_spread, round_even(e5, 4) AS ens_min_spi, round_even(emm, 4) AS ens_min_spi_mean,
          round_even(emp, 4) AS ens_min_spi_peak, round_even(m1, 4) AS ens_mean_lead1_spi, round_even(l1, 4) AS ens_min_lead1_spi, round_even(h1, 4) AS ens_max_lead1_spi,
          CASE WHEN sp IS NULL THEN 'Medium' WHEN sp < 0.5 THEN 'High' WHEN sp < 0.9 THEN 'Medium' ELSE 'Low' END AS forecast_agreement, '1998-12-01' AS target_date
        FROM (SELECT n_nationkey AS z FROM nation) LEFT JOIN ob ON ob.zone_id = z LEFT JOIN fd ON fd.zone_id = z""",
        _EVID,
    ),
)
def district_evidence(spark, d):
    o = bind.table(spark, d, "orders").select(
        (F.col("o_custkey") % 12).cast("int").alias("zone_id"), ((F.col("o_custkey") % 20).cast("double") - 10).alias("lat"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("m"), ((F.col("o_totalprice") - 250000) / 60000).alias("spi"), F.lit(False).alias("fallback"),
    )
    last = o.agg(F.max("m").alias("v")).scalar()
    pos = F.col("pos")
    f = bind.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("zone_id"), F.posexplode("embedding").alias("pos", "raw")).select(
        "zone_id", "cell", ((F.col("cell") % 20).cast("double") - 10).alias("lat"), (pos % 8 + 1).alias("lead"), F.floor(pos / 8).alias("member"),
        (F.col("raw").cast("double") * 10).alias("spi"), (-0.5 - 0.01 * (F.col("cell") % 50)).alias("rp"), F.lit(False).alias("fallback"),
    )
    cells = evidence.forecast_cells(f, -1.0, members=6)
    districts = bind.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"))
    out = evidence.district_evidence(districts, o, cells, last, F.lit("1998-12-01").cast("date"))
    return out.select(
        "zone_id", *evidence.ROUNDED, "current_spi3_category", "spi3_trend", "forecast_agreement", "target_date"
    )


_SEASON = """
rq AS (SELECT n_nationkey AS zone_id, make_date(CASE WHEN n_nationkey >= 20 THEN 1998 ELSE 1997 END, 1 + n_nationkey % 12, 1) AS init, ['MAM', 'JJA', 'OND', 'DJF'][1 + n_nationkey % 4] AS season,
         [5, 8, 11, 2][1 + n_nationkey % 4] AS anchor FROM nation),
rs AS (SELECT *, CASE WHEN (anchor - month(init) + 12) % 12 BETWEEN 1 AND 6 THEN (anchor - month(init) + 12) % 12 END AS lead, year(init) * 12 + month(init) - 1 AS im,
         (year(init) + CASE WHEN anchor < month(init) OR (season = 'DJF' AND anchor = month(init)) THEN 1 ELSE 0 END) * 12 + anchor - 1 AS tm FROM rq),
oc AS (SELECT o_custkey % 25 AS zone_id, CAST(o_custkey % 20 AS DOUBLE) - 10 AS lat, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m,
         least(greatest((o_totalprice - 250000) / 60000, -4), 4) AS spi FROM orders),
f0 AS (SELECT vec_id // 4 AS cell, 1997 * 12 + 3 * (vec_id % 4) AS im, 1 + (i - 1) % 8 AS lead, (i - 1) // 8 AS member, least(greatest(CAST(embedding[i] AS DOUBLE) * 10, -4), 4) AS spi
       FROM embeddings, unnest(generate_series(1, len(embedding))) t(i)),
rl AS (SELECT *, (SELECT max(m) FROM oc WHERE m <= tm) AS lm, (SELECT max(f0.im) FROM f0 WHERE f0.im <= rs.im) AS sm FROM rs),
om AS (SELECT rl.zone_id, oc.m, lm, sum(spi * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM oc JOIN rl ON rl.zone_id = oc.zone_id AND oc.m BETWEEN lm - 5 AND lm GROUP BY ALL),
ob AS (SELECT zone_id, max(v) FILTER (m = lm) AS cur, CASE WHEN count(v) = 6 THEN regr_slope(v, m) END AS slope FROM om GROUP BY zone_id),
pc AS (SELECT rl.zone_id, cell, CAST(cell % 20 AS DOUBLE) - 10 AS lat, avg(CASE WHEN cell % 11 <> 0 AND spi <= -0.3 - 0.01 * (cell % 50) - 0.05 * f0.lead THEN 1.0 ELSE 0.0 END) AS pd, avg(spi) AS m1, min(spi) AS em, max(spi) AS h1, stddev_pop(spi) AS sp,
         max(CASE WHEN cell % 11 <> 0 AND spi <= -0.3 - 0.01 * (cell % 50) - 0.05 * f0.lead THEN 1.0 ELSE 0.0 END) AS cr, cos(radians(CAST(cell % 20 AS DOUBLE) - 10)) AS w
       FROM f0 JOIN rl ON rl.zone_id = cell % 25 AND f0.im = sm AND f0.lead = rl.lead WHERE member < 6 GROUP BY rl.zone_id, cell),
fd AS (SELECT zone_id, sum(pd * w) / sum(w) AS pd, coalesce(sum(w) FILTER (pd >= 0.5), 0) / sum(w) AS sc, coalesce(sum(w) FILTER (cr >= 0.5), 0) / sum(w) AS hs, sum(sp * w) / sum(w) AS sp,
         sum(em * w) / sum(w) AS emm, min(em) AS emp, sum(m1 * w) / sum(w) AS m1, sum(h1 * w) / sum(w) AS h1, quantile_cont(em, 0.05) AS e5 FROM pc GROUP BY zone_id)
"""

_SEASON_COLUMNS = """zone_id, season, CAST(lead AS INTEGER) AS lead, round_even(cur, 4) AS current_spi3, CASE WHEN cur IS NULL THEN 'Unknown' WHEN cur < -1.5 THEN 'Severe_Drought' WHEN cur < -1 THEN 'Moderate_Drought' WHEN cur < -0.5 THEN 'Mild_Drought' WHEN cur < 0.5 THEN 'Normal' ELSE 'Above_Normal' END AS current_spi3_category,
  CASE WHEN slope > 0.1 THEN 'Improving' WHEN slope < -0.1 THEN 'Deteriorating' ELSE 'Stable' END AS spi3_trend, round_even(slope, 4) AS trend_slope_spi_per_month, round_even(pd, 4) AS forecast_deficit_prob, round_even(pd, 4) AS deficit_prob_lead1,
  round_even(greatest(sc, hs), 4) AS spatial_coverage, round_even(sc, 4) AS spatial_cov_mean_p, round_even(hs, 4) AS hotspot_fraction, round_even(sp, 4) AS forecast_spread, round_even(e5, 4) AS ens_min_spi, round_even(emm, 4) AS ens_min_spi_mean,
  round_even(emp, 4) AS ens_min_spi_peak, round_even(m1, 4) AS ens_mean_lead1_spi, round_even(emm, 4) AS ens_min_lead1_spi, round_even(h1, 4) AS ens_max_lead1_spi,
  CASE WHEN sp IS NULL THEN 'Medium' WHEN sp < 0.5 THEN 'High' WHEN sp < 0.9 THEN 'Medium' ELSE 'Low' END AS forecast_agreement, strftime(make_date(tm // 12, 1 + tm % 12, 1), '%Y-%m-%d') AS target_date"""


def _seasonal_inputs(spark, d):
    """Season requests of the nations, monthly cells, forecast starts of every third month and limits by cell and lead."""
    k, cell = F.col("n_nationkey"), F.col("cell")
    requests = bind.table(spark, d, "nation").select(
        k.alias("zone_id"), F.make_date(F.when(k >= 20, 1998).otherwise(1997), (k % 12 + 1).cast("int"), F.lit(1)).alias("init_date"),
        F.element_at(F.array(*map(F.lit, ("MAM", "JJA", "OND", "DJF"))), (k % 4 + 1).cast("int")).alias("season"),
    )
    obs = bind.table(spark, d, "orders").select(
        (F.col("o_custkey") % 25).alias("zone_id"), ((F.col("o_custkey") % 20).cast("double") - 10).alias("lat"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("m"), ((F.col("o_totalprice") - 250000) / 60000).alias("spi"), F.lit(False).alias("fallback"),
    )
    v, pos = F.col("vec_id"), F.col("pos")
    fcst = bind.table(spark, d, "embeddings").select(
        F.floor(v / 4).alias("cell"), (F.lit(1997 * 12) + 3 * (v % 4)).cast("int").alias("init_m"), F.posexplode("embedding").alias("pos", "raw")
    ).select(
        (cell % 25).alias("zone_id"), "cell", ((cell % 20).cast("double") - 10).alias("lat"), "init_m", (pos % 8 + 1).alias("lead"), F.floor(pos / 8).alias("member"),
        (F.col("raw").cast("double") * 10).alias("spi"), F.lit(False).alias("fallback"),
    )
    places = bind.table(spark, d, "embeddings").select(F.floor(v / 4).alias("cell")).distinct().where(cell % 11 != 0)
    limits = places.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(8))))
    limits = limits.withColumn("limit", F.lit(-0.3) - F.lit(0.01) * (cell % 50) - F.lit(0.05) * F.col("lead"))
    return requests, obs, fcst, limits


@query("seasonal_evidence", bind.with_sql(f"SELECT {_SEASON_COLUMNS} FROM rl LEFT JOIN ob USING (zone_id) LEFT JOIN fd USING (zone_id)", _SEASON))
def seasonal_evidence(spark, d):
    out = evidence.seasonal_evidence(*_seasonal_inputs(spark, d), members=6)
    return out.select(
        "zone_id", "season", "lead", *evidence.ROUNDED, "current_spi3_category", "spi3_trend", "forecast_agreement", "target_date"
    )


def _index(spark, d):
    monthly = (
        bind.series(spark, d)
        .groupBy("zone_id", (F.year("day") * 12 + F.month("day") - 1).alias("m"))
        .agg((F.sum("value") / 1e5).alias("rain"))
    )
    dry = monthly.withColumn("rain", F.when(F.col("zone_id") % 5 == F.col("m") % 7, 0.0).otherwise(F.col("rain")))
    return spi.index(dry, ["zone_id"], "m", "rain", 3, 1992 * 12, 1998 * 12 - 1)


_SPI_SQL = """
mo AS (SELECT zone_id, CAST(year(day) * 12 + month(day) - 1 AS INTEGER) AS m, sum(value) / 1e5 AS rain FROM series GROUP BY ALL),
dr AS (SELECT zone_id, m, CASE WHEN zone_id % 5 = m % 7 THEN 0e0 ELSE rain END AS rain FROM mo),
ac AS (SELECT zone_id, m, CASE WHEN count(rain) OVER w = 3 THEN avg(rain) OVER w END AS a FROM dr WINDOW w AS (PARTITION BY zone_id ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
ft AS (SELECT zone_id, m % 12 AS s, avg(CASE WHEN a > 0 THEN a END) AS mu, avg(CASE WHEN a > 0 THEN ln(a) END) AS l, avg(CASE WHEN a = 0 THEN 1e0 WHEN a > 0 THEN 0e0 END) AS d FROM ac WHERE m BETWEEN 23904 AND 23975 GROUP BY ALL),
sh AS (SELECT *, (1 + sqrt(1 + 4 * (ln(mu) - l) / 3)) / (4 * (ln(mu) - l)) AS k FROM ft WHERE ln(mu) - l > 1e-9),
x AS (SELECT ac.zone_id, ac.m, d, k, a, a / (mu / k) AS x FROM ac LEFT JOIN sh ON sh.zone_id = ac.zone_id AND sh.s = ac.m % 12),
pr AS (SELECT zone_id, m, sum(exp((k + n) * ln(x) - x - lgamma(k + n + 1))) AS g FROM x, LATERAL (SELECT unnest(generate_series(0, CAST(x + 40 * sqrt(x) + 200 AS BIGINT))) AS n) t WHERE a > 0 AND k IS NOT NULL GROUP BY ALL),
pb AS (SELECT zone_id, m, CASE WHEN a IS NOT NULL AND k IS NOT NULL THEN d + (1 - d) * coalesce(g, 0) END AS p FROM x LEFT JOIN pr USING (zone_id, m))
"""


def _ratio_sql(r: str, top: tuple, under: tuple) -> str:
    line = lambda cs: "(" * (len(cs) - 1) + f"{cs[0]!r}" + "".join(f" * {r} + {c!r})" for c in cs[1:])
    return f"({line(top)}) / ({line(under)})"


# Wichura's AS 241 in the middle and in the tails, another approximation than the operator's.
_AS241 = _ratio_sql(
    "(0.180625e0 - (p - 0.5e0) * (p - 0.5e0))",
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
_AS241_TAIL = _ratio_sql(
    "(sqrt(-ln(least(p, 1 - p))) - 1.6e0)",
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
_AS241_FAR = _ratio_sql(
    "(sqrt(-ln(least(p, 1 - p))) - 5e0)",
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


@query(
    "precipitation_index",
    bind.with_sql(
        f"""SELECT zone_id, m, round(CASE WHEN p IS NULL THEN NULL WHEN p <= 0 THEN -8.21e0 WHEN p >= 1 THEN 5e0 WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5e0) * {_AS241}
          ELSE CASE WHEN p < 0.5 THEN -1 ELSE 1 END * least(CASE WHEN -ln(least(p, 1 - p)) <= 25 THEN {_AS241_TAIL} ELSE {_AS241_FAR} END, CASE WHEN p < 0.5 THEN 8.21e0 ELSE 5e0 END) END, 4) AS spi FROM pb""",
        bind.SERIES_SQL, _SPI_SQL,
    ),
)
def precipitation_index(spark, d):
    # A probability in double precision does not tell values beyond five apart to four digits.
    return _index(spark, d).withColumn("spi", F.round(F.when(F.col("spi") > 5, 5.0).otherwise(F.col("spi")), 4))


@query("precipitation_probability", bind.with_sql("SELECT zone_id, m, round(p, 7) AS p FROM pb", bind.SERIES_SQL, _SPI_SQL))
def precipitation_probability(spark, d):
    return _index(spark, d).select("zone_id", "m", F.round(normal_cdf(F.col("spi")), 7).alias("p"))


@query("quantile_map")
def quantile_map(spark, d):
    li = bind.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cell"), "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("tp"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("obs")
    )
    hist = li.where("l_returnflag = 'A'")
    ref = li.where("l_returnflag = 'R'").select("cell", F.col("obs").alias("tp"))
    mapping = bias.train(ref, hist.select("cell", "tp"), ["cell"], "tp")
    out = bias.adjust(li.where("l_returnflag = 'N'"), mapping, ["cell"], "tp")
    return out.select("cell", "l_orderkey", "l_linenumber", "tp", F.round("corrected", 6).alias("corrected"))


_Q50 = ", ".join(repr((i + 0.5) / 50) for i in range(50))
ORACLES["quantile_map"] = f"""WITH h AS (SELECT l_suppkey AS cell, quantile_cont(l_quantity, [{_Q50}]) AS hq FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    r AS (SELECT l_suppkey AS cell, quantile_cont(l_quantity * (1 + l_tax), [{_Q50}]) AS rq FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    m AS (SELECT cell, hq, list_transform(range(1, 51), lambda i: rq[i] / hq[i]) AS f FROM h JOIN r USING (cell)),
    x AS (SELECT l_suppkey AS cell, l_orderkey, l_linenumber, l_quantity AS tp, hq, f, len(list_filter(hq, lambda v: v <= l_quantity)) AS i FROM lineitem LEFT JOIN m ON m.cell = l_suppkey WHERE l_returnflag = 'N')
    SELECT cell, l_orderkey, l_linenumber, tp, round(CASE WHEN hq IS NULL THEN tp WHEN i = 0 THEN tp * f[1] WHEN i >= 50 THEN tp * f[50] ELSE tp * (f[i] + (f[i + 1] - f[i]) * ((tp - hq[i]) / (hq[i + 1] - hq[i]))) END, 6) AS corrected FROM x"""


# ---- forcing: line items are hourly fields of a 10 x 10 grid, customers the model cells

_FORCE = """
dy AS (SELECT l_suppkey % 100 // 10 AS "row", l_suppkey % 10 AS col, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, sum(l_quantity / 1e4) * 1000 AS precip, avg(l_extendedprice / 200) - 273.15 AS temp, greatest(sum(l_discount / 100 - 0.0004) * -1000, 0) AS pet
       FROM lineitem GROUP BY ALL),
tg AS (SELECT c_custkey AS cell, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * 9 AS y, (c_custkey * 104729 % 10009) / 10009.0::DOUBLE * 9 AS x , c_mktsegment <> 'MACHINERY' AS keep FROM customer),
fl AS (SELECT *, least(floor(y), 8) AS r, least(floor(x), 8) AS c FROM tg),
wt AS (SELECT cell, keep, r + dr AS "row", c + dc AS col, (CASE dr WHEN 1 THEN y - r ELSE 1 - (y - r) END) * (CASE dc WHEN 1 THEN x - c ELSE 1 - (x - c) END) AS w FROM fl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dr, dc))
"""


@query(
    "model_forcing",
    bind.with_sql(
        """SELECT cell, strftime(day, '%Y-%m-%d') AS day, CASE WHEN count(*) = need THEN round(sum(w * precip), 6) END AS precip, CASE WHEN count(*) = need THEN round(sum(w * temp), 6) END AS temp, CASE WHEN count(*) = need THEN round(sum(w * pet), 6) END AS pet
        FROM (SELECT *, count(*) OVER (PARTITION BY cell) AS need FROM wt WHERE w <> 0) JOIN dy USING ("row", col) WHERE keep GROUP BY cell, day, need""",
        _FORCE,
    ),
)
def model_forcing(spark, d):
    k = F.col("l_suppkey")
    hourly = bind.table(spark, d, "lineitem").select(
        F.floor(k % 100 / 10).cast("int").alias("row"), (k % 10).cast("int").alias("col"), F.trunc("l_shipdate", "month").alias("time"),
        (F.col("l_quantity") / 1e4).alias("tp"), (F.col("l_extendedprice") / 200).alias("t2m"), (F.col("l_discount") / 100 - 0.0004).alias("pev"),
    )
    c = F.col("c_custkey")
    targets = bind.table(spark, d, "customer").select(
        c.alias("cell"), (F.col("c_mktsegment") != "MACHINERY").alias("keep"), ((c * 7919 % 10007) / F.lit(10007.0) * 9).alias("lat"), ((c * 104729 % 10009) / F.lit(10009.0) * 9).alias("lon")
    )
    weights = align.bilinear_weights(targets, "cell", 0.0, 0.0, 1.0, 10, 10)
    out = forcing.on_model_grid(forcing.daily_forcing(hourly), weights, targets.where("keep"))
    return out.select("cell", bind.day("day").alias("day"), *[F.round(v, 6).alias(v) for v in ("precip", "temp", "pet")])


@query(
    "fill_cleanup",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 10 < 0 THEN 0 ELSE l_quantity - 10 END AS precip, CASE WHEN l_tax = 0 THEN -9999.0 ELSE l_quantity - 10 END AS temp, CASE WHEN l_discount = 0 THEN 0 ELSE l_tax END AS pet FROM lineitem""",
)
def fill_cleanup(spark, d):
    q, fill = F.col("l_quantity") - 10, F.lit(-9999.0)
    rows = bind.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", q.alias("precip"), F.when(F.col("l_tax") == 0, fill).otherwise(q).alias("temp"),
        F.when(F.col("l_discount") == 0, fill).otherwise(F.col("l_tax")).alias("pet"),
    )
    return forcing.clean_fills(rows)


# ---- zone files of all zones

_ZF = """
hd AS (SELECT s_nationkey AS zone, s_suppkey AS zone_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier),
dv AS (SELECT source_date LIKE 'hc%' AS past, variable, zone_id, strftime(strptime(gtime[1:8], '%Y%m%d'), '%Y%j') AS julian, arg_max(mean_value, (gtime, source_date, processed_at, mean_value)) AS value FROM lv WHERE variable IN (1, 2, 3) GROUP BY ALL),
pv AS (SELECT dv.*, zone, pos FROM dv JOIN hd USING (zone_id)),
rn AS (SELECT past, zone, pos, julian, coalesce(sum(value) FILTER (variable = 1), 0) + coalesce(sum(value) FILTER (variable = 3), 0) AS value FROM pv WHERE variable IN (1, 3) GROUP BY ALL),
ev0 AS (SELECT past, zone, pos, julian, value FROM pv WHERE variable = 2),
lack AS (SELECT DISTINCT r.zone, r.julian FROM rn r WHERE NOT past AND NOT EXISTS (SELECT 1 FROM ev0 e WHERE NOT e.past AND e.zone = r.zone AND e.julian = r.julian)),
lst AS (SELECT zone, max(julian) AS last FROM ev0 WHERE NOT past GROUP BY zone),
ev AS (SELECT * FROM ev0 UNION ALL SELECT false, l.zone, e.pos, l.julian, e.value FROM lack l JOIN lst USING (zone) JOIN ev0 e ON e.zone = l.zone AND e.julian = lst.last AND NOT e.past),
al AS (SELECT 'rain.txt' AS file, * FROM rn UNION ALL SELECT 'evap.txt', * FROM ev),
cut AS (SELECT file, zone, min(julian) AS c FROM al WHERE NOT past GROUP BY file, zone),
mg AS (SELECT al.* FROM al LEFT JOIN cut USING (file, zone) WHERE NOT past OR c IS NULL OR julian < c),
dd AS (SELECT DISTINCT file, zone, julian FROM mg)
"""


@query(
    "zone_files",
    bind.with_sql(
        """SELECT d.zone, d.file, d.julian, d.julian || ',' || string_agg(CASE WHEN m.value > 0 THEN printf('%.1f', m.value) ELSE '0' END, ',' ORDER BY h.pos) AS line
        FROM dd d JOIN hd h ON h.zone = d.zone LEFT JOIN mg m ON m.file = d.file AND m.zone = d.zone AND m.julian = d.julian AND m.pos = h.pos GROUP BY d.zone, d.file, d.julian
        UNION ALL SELECT zone, f, '', 'NA,' || string_agg(CAST(zone_id AS VARCHAR), ',' ORDER BY pos) FROM hd, (VALUES ('rain.txt'), ('evap.txt')) t(f) GROUP BY zone, f""",
        LEAN_SQL,
        "lv AS (SELECT gtime, zone_id, CAST(variable % 4 AS INTEGER) AS variable, sum(mean_value) / 8 AS mean_value, max(processed_at) AS processed_at, source_date FROM lean GROUP BY gtime, zone_id, variable % 4, source_date)",
        _ZF,
    ),
)
def zone_files(spark, d):
    from pluvion.catalog.tables import _zone_header

    lean = (
        lean_rows(spark, d)
        .groupBy("gtime", "zone_id", (F.col("variable") % 4).alias("variable"), "source_date")
        .agg((F.sum("mean_value") / 8).alias("mean_value"), F.max("processed_at").alias("processed_at"))
    )
    header = _zone_header(spark, d)
    shapes = header.select("zone", F.col("gridcode").alias("GRIDCODE"), F.col("gridcode").alias("id"))
    return zonefiles.zone_file_lines(lean, header, shapes)
