"""Zonal reductions, ensemble statistics and exact quantiles on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.operators import ensemble, quantiles, zonal

QUERIES, ORACLES, query = bind.area()


def _zoned(spark, d):
    return zonal.attach_zones(bind.grid(spark, d), bind.cell_zone(spark, d), ["cell"])


_ZONAL = """
SELECT strftime(g.time, '%Y%m%dT00') AS gtime, CAST(z.zone_id AS INTEGER) AS zone_id, 1 AS zone_nu,
       g.variable, round({agg}, 6) AS mean_value, '20260101T00' AS processed_at, '20260101' AS source_date
FROM grid g JOIN cell_zone z USING (cell)
WHERE EXISTS (SELECT 1 FROM grid o WHERE o.variable = g.variable AND o.time = g.time AND o.value IS NOT NULL)
GROUP BY g.time, z.zone_id, g.variable
"""


def _zonal(method):
    def run(spark, d):
        reduced = zonal.zonal_reduce_live(
            bind.grid(spark, d), bind.cell_zone(spark, d), ["cell"], ["variable", "time"], method=method
        )
        lean = zonal.lean_table(reduced, "20260101T00", "20260101")
        return lean.withColumn("mean_value", F.round("mean_value", 6))

    return run


QUERIES["zonal_mean"] = _zonal("mean")
QUERIES["zonal_sum"] = _zonal("sum")
QUERIES["zonal_std"] = _zonal("std")
ORACLES["zonal_mean"] = bind.with_sql(_ZONAL.format(agg="avg(g.value)"), bind.GRID_SQL)
ORACLES["zonal_sum"] = bind.with_sql(_ZONAL.format(agg="sum(g.value)"), bind.GRID_SQL)
ORACLES["zonal_std"] = bind.with_sql(_ZONAL.format(agg="stddev_pop(g.value)"), bind.GRID_SQL)


@query(
    "null_step_filter",
    bind.with_sql(
        """SELECT variable, strftime(time, '%Y-%m-%d') AS day, count(*) AS n_rows, count(value) AS n_valid
        FROM grid g WHERE EXISTS (SELECT 1 FROM grid o WHERE o.variable = g.variable
              AND o.time = g.time AND o.value IS NOT NULL)
        GROUP BY variable, time""",
        bind.GRID_SQL,
    ),
)
def null_step_filter(spark, d):
    live = zonal.drop_empty_steps(bind.grid(spark, d), ["variable", "time"])
    return (
        live.groupBy("variable", "time")
        .agg(F.count("*").alias("n_rows"), F.count("value").alias("n_valid"))
        .select("variable", F.date_format("time", "yyyy-MM-dd").alias("day"), "n_rows", "n_valid")
    )


@query(
    "weighted_zonal_mean",
    bind.with_sql(
        """SELECT CAST(zone_id AS INTEGER) AS zone_id,
          round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))) FILTER (value IS NOT NULL), 6) AS mean_value,
          round(coalesce(sum(cos(radians(lat))) FILTER (value <= 10), 0)
            / sum(cos(radians(lat))) FILTER (value IS NOT NULL), 6) AS share_below,
          round(coalesce(sum(cos(radians(lat))) FILTER (value >= 40), 0)
            / sum(cos(radians(lat))) FILTER (value IS NOT NULL), 6) AS share_above
        FROM grid JOIN cell_zone USING (cell) GROUP BY zone_id""",
        bind.GRID_SQL,
    ),
)
def weighted_zonal_mean(spark, d):
    v, w = F.col("value"), zonal.latitude_weight(F.col("lat"))
    return _zoned(spark, d).groupBy("zone_id").agg(
        F.round(zonal.weighted_mean(v, w), 6).alias("mean_value"),
        F.round(zonal.threshold_share(v, w, 10.0, below=True), 6).alias("share_below"),
        F.round(zonal.threshold_share(v, w, 40.0), 6).alias("share_above"),
    )


@query(
    "zonal_quantile",
    bind.with_sql(
        """SELECT CAST(zone_id AS INTEGER) AS zone_id, q, round(CASE q WHEN 0.05 THEN quantile_cont(price, 0.05)
             WHEN 0.5 THEN quantile_cont(price, 0.5) ELSE quantile_cont(price, 0.95) END, 6) AS value
        FROM grid JOIN cell_zone USING (cell), (VALUES (0.05::DOUBLE), (0.5), (0.95)) t(q)
        WHERE value IS NOT NULL GROUP BY zone_id, q""",
        bind.GRID_SQL,
    ),
)
def zonal_quantile(spark, d):
    cells = _zoned(spark, d).where(F.col("value").isNotNull())
    out = quantiles.exact_quantiles(cells, ["zone_id"], "price", [0.05, 0.5, 0.95], "value")
    return out.withColumn("value", F.round("value", 6))


@query(
    "zonal_extremes",
    bind.with_sql(
        """SELECT CAST(zone_id AS INTEGER) AS zone_id, min(value) AS min_value, max(value) AS max_value
        FROM grid JOIN cell_zone USING (cell) GROUP BY zone_id""",
        bind.GRID_SQL,
    ),
)
def zonal_extremes(spark, d):
    return zonal.zonal_extremes(_zoned(spark, d), ["zone_id"], "value")


@query(
    "weighted_zone_series",
    bind.with_sql(
        """SELECT CAST(zone_id AS INTEGER) AS zone_id, strftime(time, '%Y-%m-%d') AS day,
          round(CASE WHEN sum(w) > 0 THEN sum(value * w) / nullif(sum(w) FILTER (value IS NOT NULL), 0)
               ELSE avg(value) END, 6) AS value
        FROM (SELECT *, CASE WHEN weight > 0.96 THEN weight ELSE 0 END AS w FROM grid) g
        JOIN cell_zone USING (cell) GROUP BY zone_id, time""",
        bind.GRID_SQL,
    ),
)
def weighted_zone_series(spark, d):
    zoned = _zoned(spark, d).withColumn("w", F.when(F.col("weight") > 0.96, F.col("weight")).otherwise(0.0))
    return zonal.weighted_series(zoned, ["zone_id", "time"], "value", "w").select(
        "zone_id", F.date_format("time", "yyyy-MM-dd").alias("day"), F.round("value", 6).alias("value")
    )


_WM = """
SELECT CAST(zone_id AS INTEGER) AS zone_id,
       min(value) FILTER (round(cw, 9) >= round(0.5 * tw, 9)) AS median
FROM (SELECT zone_id, value, sum(sum(w)) OVER (PARTITION BY zone_id ORDER BY value) AS cw,
             sum(sum(w)) OVER (PARTITION BY zone_id) AS tw
      FROM (SELECT zone_id, price AS value, weight AS w FROM grid JOIN cell_zone USING (cell)
            WHERE value IS NOT NULL) GROUP BY zone_id, value)
GROUP BY zone_id
"""


@query("weighted_median", bind.with_sql(_WM, bind.GRID_SQL))
def weighted_median(spark, d):
    cells = _zoned(spark, d).where(F.col("value").isNotNull())
    return quantiles.weighted_median(cells, ["zone_id"], "price", "weight")


_STRESS = "CASE WHEN value >= 40 THEN 1 WHEN value >= 25 THEN 2 WHEN value >= 12 THEN 3 ELSE 4 END"


def _classed(spark, d):
    v = F.col("value")
    klass = F.when(v >= 40, 1).when(v >= 25, 2).when(v >= 12, 3).when(v.isNotNull(), 4)
    return (
        _zoned(spark, d)
        .withColumn("klass", klass)
        .withColumn("crop", F.col("weight") - 0.85)
        .withColumn("crop", F.when(F.col("crop") > 0, F.col("crop")).otherwise(0.0))
    )


_CLASSED_SQL = f"""
classed AS (SELECT *, CASE WHEN value IS NOT NULL THEN {_STRESS} END AS klass,
              CASE WHEN weight - 0.85 > 0 THEN weight - 0.85 ELSE 0.0 END AS crop
            FROM grid JOIN cell_zone USING (cell))
"""


@query(
    "class_shares",
    bind.with_sql(
        """SELECT CAST(zone_id AS INTEGER) AS zone_id,
          round(coalesce(s1 * k + 1 - k, 1.0), 6) AS p1, round(coalesce(s2 * k, 0), 6) AS p2,
          round(coalesce(s3 * k, 0), 6) AS p3, round(coalesce(s4 * k, 0), 6) AS p4
        FROM (SELECT zone_id, least(1.0, avg(crop) / 0.25) AS k,
           coalesce(sum(crop) FILTER (klass = 1), 0) / nullif(sum(crop) FILTER (klass IS NOT NULL), 0) AS s1,
           coalesce(sum(crop) FILTER (klass = 2), 0) / nullif(sum(crop) FILTER (klass IS NOT NULL), 0) AS s2,
           coalesce(sum(crop) FILTER (klass = 3), 0) / nullif(sum(crop) FILTER (klass IS NOT NULL), 0) AS s3,
           coalesce(sum(crop) FILTER (klass = 4), 0) / nullif(sum(crop) FILTER (klass IS NOT NULL), 0) AS s4
           FROM classed GROUP BY zone_id)""",
        bind.GRID_SQL,
        _CLASSED_SQL,
    ),
)
def class_shares(spark, d):
    out = zonal.class_shares(_classed(spark, d), ["zone_id"], "klass", "crop", [1, 2, 3, 4], "p", "crop")
    return out.select("zone_id", *[F.round(f"p{k}", 6).alias(f"p{k}") for k in (1, 2, 3, 4)])


@query(
    "exceedance_share",
    bind.with_sql(
        """SELECT CAST(zone_id AS INTEGER) AS zone_id, round(s, 6) AS critical_share,
             coalesce(s > 0.25, false) AS triggered, tail AS tail_min
        FROM (SELECT zone_id, coalesce(sum(crop) FILTER (value < 12), 0)
                / nullif(sum(crop) FILTER (value IS NOT NULL), 0) AS s,
              coalesce(min(value) FILTER (crop >= 0.10), min(value)) AS tail
              FROM classed GROUP BY zone_id)""",
        bind.GRID_SQL,
        _CLASSED_SQL,
    ),
)
def exceedance_share(spark, d):
    v, w = F.col("value"), F.col("crop")
    return (
        _classed(spark, d)
        .groupBy("zone_id")
        .agg(
            zonal.weighted_share(v < 12, v, w).alias("s"),
            zonal.tail_minimum(v, w).alias("tail_min"),
        )
        .select(
            "zone_id",
            F.round("s", 6).alias("critical_share"),
            F.coalesce(F.col("s") > 0.25, F.lit(False)).alias("triggered"),
            "tail_min",
        )
    )


@query(
    "modal_class",
    """WITH c AS (SELECT c_nationkey AS zone_id, CAST(floor(abs(c_acctbal) / 700) AS INTEGER) AS klass FROM customer),
    l AS (SELECT zone_id, klass, CASE WHEN klass = 0 THEN 1 WHEN klass <= 3 THEN 4 WHEN klass <= 6 THEN 5
             WHEN klass <= 10 THEN 6 WHEN klass <= 12 THEN 3 ELSE 2 END AS level FROM c),
    m AS (SELECT zone_id, max(level) AS max_level FROM l GROUP BY zone_id),
    n AS (SELECT zone_id, klass, count(*) AS n FROM l GROUP BY zone_id, klass)
    SELECT m.zone_id, (SELECT max(klass) FROM l WHERE l.zone_id = m.zone_id AND l.level = m.max_level) AS max_class,
       m.max_level,
       (SELECT min(klass) FROM n WHERE n.zone_id = m.zone_id
          AND n.n = (SELECT max(n) FROM n x WHERE x.zone_id = m.zone_id)) AS modal_class,
       (SELECT round(avg(CASE WHEN l.level = m.max_level THEN 1.0 ELSE 0.0 END), 6)
          FROM l WHERE l.zone_id = m.zone_id) AS level_fraction
    FROM m""",
)
def modal_class(spark, d):
    k = F.col("klass")
    cells = (
        bind.table(spark, d, "customer")
        .select(
            F.col("c_nationkey").alias("zone_id"),
            F.floor(F.abs("c_acctbal") / 700).cast("int").alias("klass"),
        )
        .withColumn(
            "level",
            F.when(k == 0, 1).when(k <= 3, 4).when(k <= 6, 5).when(k <= 10, 6).when(k <= 12, 3).otherwise(2),
        )
    )
    return zonal.class_summary(cells, ["zone_id"], "klass", "level").withColumn(
        "level_fraction", F.round("level_fraction", 6)
    )


_ENS_SQL = """
ens AS (SELECT vec_id AS cell, label AS zone_id, CAST((i - 1) % 8 AS INTEGER) AS lead,
               CAST((i - 1) // 8 AS INTEGER) AS member, CAST(embedding[i] AS DOUBLE) * 10 AS v
        FROM embeddings, unnest(generate_series(1, len(embedding))) t(i)),
clipped AS (SELECT cell, zone_id, lead, member, least(greatest(v, -2.0), 2.0) AS v FROM ens WHERE member < 6)
"""


def _ensemble(spark, d):
    pos = F.col("pos")
    df = bind.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("cell"),
        F.col("label").alias("zone_id"),
        F.posexplode("embedding").alias("pos", "raw"),
    )
    df = df.select(
        "cell",
        "zone_id",
        (pos % 8).cast("int").alias("lead"),
        F.floor(pos / 8).cast("int").alias("member"),
        (F.col("raw").cast("double") * 10).alias("v"),
    )
    return ensemble.first_members(df, 6).withColumn("v", ensemble.clip(F.col("v"), 2.0))


@query(
    "ensemble_stats",
    bind.with_sql(
        """SELECT cell, lead, round(avg(v), 9) AS ens_mean, round(min(v), 9) AS ens_min, round(max(v), 9) AS ens_max,
           round(stddev_pop(v), 9) AS ens_spread,
           round(avg(CASE WHEN v <= -1.0 THEN 1.0 ELSE 0.0 END), 9) AS deficit_prob,
           bool_or(v <= -1.0) AS any_member,
           CASE WHEN round(stddev_pop(v), 9) < 0.5 THEN 'High' WHEN round(stddev_pop(v), 9) < 0.9 THEN 'Medium'
              ELSE 'Low' END AS agreement
        FROM clipped GROUP BY cell, lead""",
        _ENS_SQL,
    ),
)
def ensemble_stats(spark, d):
    stats = ensemble.member_statistics(_ensemble(spark, d), ["cell", "lead"], "v", -1.0)
    names = ["ens_mean", "ens_min", "ens_max", "ens_spread", "deficit_prob"]
    stats = stats.withColumns({c: F.round(c, 9) for c in names})
    return stats.withColumn("agreement", ensemble.agreement_label(F.col("ens_spread")))


@query(
    "exceedance_prob",
    bind.with_sql(
        """SELECT cell, round(max(p), 9) AS deficit_prob, round(min(m), 9) AS ens_min, bool_or(a) AS any_member
        FROM (SELECT cell, lead, avg(CASE WHEN v <= -1.0 THEN 1.0 ELSE 0.0 END) AS p, min(v) AS m,
                bool_or(v <= -1.0) AS a FROM clipped GROUP BY cell, lead) GROUP BY cell""",
        _ENS_SQL,
    ),
)
def exceedance_prob(spark, d):
    stats = ensemble.member_statistics(_ensemble(spark, d), ["cell", "lead"], "v", -1.0)
    out = ensemble.over_leads(stats, ["cell"])
    return out.withColumns({c: F.round(c, 9) for c in ("deficit_prob", "ens_min")})


@query(
    "member_evidence",
    bind.with_sql(
        """SELECT zone_id, member, round(avg(d), 9) AS member_def_frac,
             round(avg(CASE WHEN d >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS member_spa_cov,
             round(quantile_cont(m, 0.05), 9) AS member_min_spi
        FROM (SELECT zone_id, member, cell, min(v) AS m,
                 max(CASE WHEN v <= -0.5 - 0.01 * (cell % 50) THEN 1.0 ELSE 0.0 END) AS d
              FROM clipped GROUP BY zone_id, member, cell) GROUP BY zone_id, member""",
        _ENS_SQL,
    ),
)
def member_evidence(spark, d):
    df = _ensemble(spark, d).withColumn("threshold", -0.5 - 0.01 * (F.col("cell") % 50))
    out = ensemble.member_evidence(df, "zone_id", "member", ["cell"], "v", "threshold")
    names = ["member_def_frac", "member_spa_cov", "member_min_spi"]
    return out.withColumns({c: F.round(c, 9) for c in names})


@query(
    "cell_index_summary",
    bind.with_sql(
        """SELECT cell, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM grid GROUP BY cell""",
        bind.GRID_SQL,
    ),
)
def cell_index_summary(spark, d):
    return bind.grid(spark, d).groupBy("cell").agg(
        F.round(F.avg("value"), 6).alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )
