"""Sinks and file formats on the driver tables: written into the shared folder and read back as files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.catalog.tables import _LAST, LEAN_SQL, _features, _zone_text, lean_rows
from pluvion.operators import align, filters
from pluvion.session import ensure_checkpoint_dir
from pluvion.sources import lean, vector, zonetext

QUERIES, ORACLES, query = bind.area()


def _folder(spark, name):
    """A new folder for one run in the place all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_LEAN_OUT = "SELECT gtime, zone_id, zone_nu, variable, mean_value, processed_at, source_date FROM lean"


@query("lean_parquet_files", bind.with_sql(_LEAN_OUT, LEAN_SQL))
def lean_parquet_files(spark, d):
    path = _folder(spark, "lean")
    lean.write_parquet(lean_rows(spark, d), path, ["variable"])
    return lean.read_parquet(spark, path).select("gtime", "zone_id", "zone_nu", "variable", "mean_value", "processed_at", "source_date")


@query("lean_csv_files", bind.with_sql(_LEAN_OUT + " WHERE variable BETWEEN 1 AND 5", LEAN_SQL))  # the reader knows five variables
def lean_csv_files(spark, d):
    path = lean.write_csv(lean_rows(spark, d), _folder(spark, "csv"), "20260101T00")
    return lean.read_csv(spark, path).select("gtime", "zone_id", "zone_nu", "variable", "mean_value", "processed_at", "source_date")


@query(
    "zone_text_files",
    bind.with_sql(
        """SELECT CAST(d.zone AS INTEGER) AS zone, strftime(strptime(d.julian, '%Y%j'), '%Y%m%dT00') AS gtime, CAST(h.gridcode AS INTEGER) AS zone_id, CASE WHEN v.value > 0 THEN CAST(printf('%.1f', v.value) AS DOUBLE) ELSE 0.0 END AS value
        FROM (SELECT DISTINCT zone, julian FROM vals) d JOIN header h ON h.zone = d.zone LEFT JOIN vals v ON v.zone = d.zone AND v.julian = d.julian AND v.zone_id = h.gridcode""",
        _LAST,
    ),
)
def zone_text_files(spark, d):
    header, lines = _zone_text(spark, d)
    path = _folder(spark, "zones")
    zonetext.write_zone_files(header, lines, path)
    rows = zonetext.parse_zone_lines(zonetext.read_lines(spark, f"{path}/*"))
    zone = F.regexp_extract("file", r"zone=([0-9]+)", 1).cast("int")
    day = F.date_format(F.to_date("julian", "yyyyDDD"), "yyyyMMdd'T00'")
    return rows.select(zone.alias("zone"), day.alias("gtime"), "zone_id", "value")


@query(
    "feature_files",
    """SELECT l_orderkey AS linkno, CAST(l_orderkey % 6 + 1 AS INTEGER) AS stream_order, count(*) AS n_points, round(sum(l_quantity), 4) AS sum_lon, round(sum(CAST(l_suppkey AS DOUBLE)), 4) AS sum_lat FROM lineitem GROUP BY l_orderkey""",
)
def feature_files(spark, d):
    f = _features(spark, d)
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"linkno":'), F.col("linkno").cast("string"), F.lit(',"stream_order":'), F.col("stream_order").cast("string"),
        F.lit('},"geometry":{"type":"LineString","coordinates":'), F.to_json("xy"), F.lit("}}"),
    )
    path = _folder(spark, "features")
    f.select(feature.alias("value")).write.option("lineSep", ",").text(path)
    seg = vector.read_feature_collections(spark, path)
    total = lambda axis: F.aggregate("coords", F.lit(0.0), lambda a, p: a + p[axis])
    return seg.select(
        "linkno", "stream_order", F.size("coords").cast("bigint").alias("n_points"), F.round(total("lon"), 4).alias("sum_lon"), F.round(total("lat"), 4).alias("sum_lat")
    )


@query(
    "points_in_domain",
    """WITH p AS (SELECT c_custkey AS id, c_mktsegment AS seg, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * 10 AS lon, (c_custkey * 104729 % 10009) / 10009.0::DOUBLE * 10 AS lat FROM customer)
    SELECT seg, count(*) AS n_points, count(*) FILTER (lon BETWEEN 2.5 AND 7.25 AND lat BETWEEN 1.0 AND 9.5) AS n_inside, min(CASE WHEN lon BETWEEN 2.5 AND 7.25 AND lat BETWEEN 1.0 AND 9.5 THEN id END) AS first_inside FROM p GROUP BY seg""",
)
def points_in_domain(spark, d):
    k = F.col("c_custkey")
    p = bind.table(spark, d, "customer").select(
        k.alias("id"), F.col("c_mktsegment").alias("seg"), ((k * 7919 % 10007) / F.lit(10007.0) * 10).alias("lon"), ((k * 104729 % 10009) / F.lit(10009.0) * 10).alias("lat")
    )
    inside = filters.inside_box(F.col("lon"), F.col("lat"), 2.5, 1.0, 7.25, 9.5)
    return p.groupBy("seg").agg(F.count("*").alias("n_points"), F.count_if(inside).alias("n_inside"), F.min(F.when(inside, F.col("id"))).alias("first_inside"))


@query(
    "district_results",
    """WITH r AS (SELECT s_nationkey AS zone_id, CASE WHEN avg(s_acctbal) < 3500 THEN 'Alert' WHEN avg(s_acctbal) < 5000 THEN 'Watch' ELSE 'Normal' END AS level, round(avg(s_acctbal), 4) AS value FROM supplier WHERE s_acctbal > 0 GROUP BY 1 HAVING count(*) > 3)
    SELECT n_nationkey AS zone_id, n_name, coalesce(level, 'No_data') AS level, coalesce(value, -1) AS value FROM nation LEFT JOIN r ON r.zone_id = n_nationkey""",
)
def district_results(spark, d):
    s = bind.table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("zone_id")).agg(F.avg("s_acctbal").alias("m"), F.count("*").alias("n")).where("n > 3")
    results = s.select("zone_id", F.when(F.col("m") < 3500, "Alert").when(F.col("m") < 5000, "Watch").otherwise("Normal").alias("level"), F.round("m", 4).alias("value"))
    districts = bind.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"), "n_name")
    return align.lookup(districts, results, ["zone_id"], {"level": "No_data", "value": -1.0})
