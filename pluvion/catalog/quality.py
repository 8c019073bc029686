"""Profiles, comparisons and distributions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.catalog.tables import LEAN_SQL, lean_rows
from pluvion.operators import profile

QUERIES, ORACLES, query = bind.area()


@query(
    "value_summary",
    """SELECT o_orderpriority, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max,
         count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0) AS negatives, round(quantile_cont(v, 0.5), 6) AS median
       FROM (SELECT o_orderpriority, CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE o_totalprice / 1000 - 100 END AS v FROM orders) GROUP BY o_orderpriority""",
)
def value_summary(spark, d):
    v = F.when(F.col("o_custkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000 - 100)
    rows = bind.table(spark, d, "orders").select("o_orderpriority", v.alias("v"))
    out = profile.value_summary(rows, ["o_orderpriority"], "v")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "median")})


@query(
    "table_profile",
    bind.with_sql(
        """SELECT variable, count(*) AS n_rows, min(gtime) AS first_time, max(gtime) AS last_time, count(*) FILTER (mean_value IS NULL) AS n_missing, round(avg(mean_value), 6) AS mean,
          round(stddev_samp(mean_value), 6) AS std, min(mean_value) AS min, max(mean_value) AS max, count(DISTINCT gtime) AS n_times, count(DISTINCT zone_id) AS n_zones
        FROM lean GROUP BY variable""",
        LEAN_SQL,
    ),
)
def table_profile(spark, d):
    out = profile.table_profile(lean_rows(spark, d), "variable", "gtime", "zone_id", "mean_value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "coverage",
    bind.with_sql("SELECT variable, count(*) AS n_total, count(value) AS n_valid, round(count(value) / count(*), 9) AS coverage FROM grid GROUP BY variable", bind.GRID_SQL),
)
def coverage(spark, d):
    out = profile.coverage(bind.grid(spark, d), ["variable"], "value")
    return out.withColumn("coverage", F.round("coverage", 9))


@query(
    "percentile_profile",
    bind.with_sql(
        """, s AS (SELECT variable, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std, count(*) FILTER (price IS NULL) AS n_missing,
             quantile_cont(price, [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS q FROM grid GROUP BY variable)
        SELECT variable, [0.0::DOUBLE, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0][i] AS q, round(s.q[i], 6) AS value, mean, std, n_missing FROM s, generate_series(1, 11) t(i)""",
        bind.GRID_SQL,
    ),
)
def percentile_profile(spark, d):
    out = profile.percentile_profile(bind.grid(spark, d), ["variable"], "price")
    return out.select("variable", "q", F.round("value", 6).alias("value"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n_missing")


# ---- whole documents as text files of two sources; each lacks some, the second one has edits

_TEXT_SQL = """
a AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 = 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '1,2,3' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0)
"""


def _shape_sql(side: str, files: str) -> str:
    """Profile of every text of ``files(doc_id, text)`` as the table ``side``."""
    cut = lambda line: f"CASE sep WHEN 'comma' THEN string_split({line}, ',') WHEN 'tab' THEN string_split({line}, chr(9)) ELSE regexp_split_to_array({line}, ' +') END"
    return f"""
    {side}0 AS (SELECT doc_id AS file, md5(text) AS digest, string_split(text, chr(10)) AS ls, length(text) + 1 AS size, trim(string_split(text, chr(10))[1], ' ') AS h FROM {files}),
    {side}1 AS (SELECT *, CASE WHEN contains(h, ',') THEN 'comma' WHEN contains(h, chr(9)) THEN 'tab' ELSE 'space' END AS sep FROM {side}0),
    {side}2 AS (SELECT *, len({cut("h")}) AS columns, TRY_CAST(({cut("h")})[1] AS DOUBLE) IS NULL AS has_header FROM {side}1),
    {side}3 AS (SELECT file, sep, trim(unnest(CASE WHEN has_header THEN ls[2:] ELSE ls END), ' ') AS line FROM {side}2),
    {side}4 AS (SELECT file, TRY_CAST(trim(unnest(({cut("line")})[2:]), ' ') AS DOUBLE) AS v FROM {side}3 WHERE line <> ''),
    {side}5 AS (SELECT file, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0) AS negatives, quantile_cont(v, 0.5) AS median
                FROM {side}4 WHERE v IS NOT NULL GROUP BY file),
    {side} AS (SELECT file, digest, len(ls) AS total_lines, len(list_filter(ls, lambda x: trim(x, ' ') <> '')) AS non_empty_lines, size, sep AS separator, columns, has_header, n, mean, std, low, high, zeros, negatives, median
               FROM {side}2 LEFT JOIN {side}5 USING (file))"""


_PAIR_SQL = f"""{_TEXT_SQL.strip()}, {_shape_sql("fa", "a").strip()}, {_shape_sql("fb", "b").strip()},
marks AS (SELECT coalesce(x.file, y.file) AS file, CASE WHEN x.file IS NULL OR y.file IS NULL THEN 'missing' WHEN x.digest = y.digest THEN 'identical' ELSE 'different' END AS status,
            abs(y.total_lines - x.total_lines) > 100 AS lines_apart, x.columns <> y.columns AS columns_apart, x.separator <> y.separator AS format_apart, x.has_header <> y.has_header AS header_apart,
            x.mean <> 0 AND abs((y.mean - x.mean) / x.mean) * 100 > 5 AS mean_apart
          FROM fa x FULL JOIN fb y ON x.file = y.file),
pair AS (SELECT file, status, status = 'different' AND coalesce(lines_apart, false) AS major_line_difference, status = 'different' AND coalesce(columns_apart, false) AS column_mismatch,
           status = 'different' AND coalesce(format_apart, false) AS format_mismatch, status = 'different' AND coalesce(header_apart, false) AS header_mismatch, status = 'different' AND coalesce(mean_apart, false) AS statistical_difference FROM marks)
"""


def _profiles(spark, d, side):
    docs = bind.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    if side == "a":
        docs = docs.where("file % 7 <> 0 OR file % 11 = 0")
    elif side == "b":
        edited = F.when(F.col("file") % 3 == 0, F.concat("text", F.lit("\n1,2,3"))).otherwise(F.col("text"))
        docs = docs.where("file % 11 <> 0 OR file % 7 = 0").withColumn("text", edited)
    return profile.whole_text_profile(docs)


@query(
    "text_profile",
    bind.with_sql(
        """SELECT file, total_lines, non_empty_lines, size, separator, columns, has_header, n AS count, printf('%.6e', mean) AS mean, printf('%.6e', std) AS std, low AS min, high AS max, zeros, negatives, printf('%.6e', median) AS median FROM f""",
        _shape_sql("f", "documents"),
    ),
)
def text_profile(spark, d):
    digits = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.6e", c)).alias(c)
    return _profiles(spark, d, "all").select(
        "file", "total_lines", "non_empty_lines", "size", "separator", "columns", "has_header", "count", digits("mean"), digits("std"), "min", "max", "zeros", "negatives", digits("median")
    )


def _pairs(spark, d):
    return profile.compare_profiles(_profiles(spark, d, "a"), _profiles(spark, d, "b"), "file", "digest")


@query(
    "file_pair_status",
    bind.with_sql(
        """SELECT coalesce(a.doc_id, b.doc_id) AS file, CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'missing' WHEN a.text = b.text THEN 'identical' ELSE 'different' END AS status
        FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
        _TEXT_SQL,
    ),
)
def file_pair_status(spark, d):
    return _pairs(spark, d).select("file", "status")


@query(
    "file_pair_report",
    bind.with_sql(
        """SELECT status, CASE WHEN status = 'different' THEN CASE WHEN major_line_difference OR column_mismatch OR format_mismatch OR header_mismatch OR statistical_difference THEN 'high' ELSE 'low' END END AS severity,
          statistical_difference, header_mismatch, format_mismatch, column_mismatch, count(*) AS n FROM pair GROUP BY ALL""",
        _PAIR_SQL,
    ),
)
def file_pair_report(spark, d):
    return _pairs(spark, d).groupBy("status", "severity", "statistical_difference", "header_mismatch", "format_mismatch", "column_mismatch").agg(F.count("*").alias("n"))


@query(
    "remediation_steps",
    bind.with_sql(
        """SELECT file, 'critical' AS urgency, 'copy missing file' AS action FROM pair WHERE status = 'missing'
        UNION ALL SELECT file, 'critical', 'fix major data gap' FROM pair WHERE major_line_difference
        UNION ALL SELECT file, 'important', 'standardise header' FROM pair WHERE header_mismatch
        UNION ALL SELECT file, 'important', 'fix file format' FROM pair WHERE format_mismatch
        UNION ALL SELECT file, 'recommended', 'validate data quality' FROM pair WHERE statistical_difference""",
        _PAIR_SQL,
    ),
)
def remediation_steps(spark, d):
    return profile.remediation(_pairs(spark, d), "file")


# ---- flood depth grids: line items are cells of seven scenarios

_DEPTH_SQL = """
depth AS (SELECT l_linenumber AS scenario, l_partkey AS cell, max(CASE WHEN l_quantity > 20 THEN (l_quantity - 20) / 15 ELSE 0.0 END) AS depth FROM lineitem GROUP BY 1, 2)
"""


def _depth(spark, d):
    q = F.col("l_quantity")
    return (
        bind.table(spark, d, "lineitem")
        .groupBy(F.col("l_linenumber").alias("scenario"), F.col("l_partkey").alias("cell"))
        .agg(F.max(F.when(q > 20, (q - 20) / 15).otherwise(0.0)).alias("depth"))
    )


@query(
    "flooded_cells",
    bind.with_sql(
        """SELECT scenario, count(*) FILTER (depth > 0.1) AS over_01, count(*) FILTER (depth > 0.3) AS over_03, count(*) FILTER (depth > 1.0) AS over_10, round(max(depth), 9) AS max_depth FROM depth GROUP BY scenario""",
        _DEPTH_SQL,
    ),
)
def flooded_cells(spark, d):
    return profile.flooded_counts(_depth(spark, d), ["scenario"], "depth").withColumn("max_depth", F.round("max_depth", 9))


@query(
    "scenario_compare",
    bind.with_sql(
        """SELECT count(*) FILTER (x > 0 AND y <= 0) AS only_a, count(*) FILTER (y > 0 AND x <= 0) AS only_b, count(*) FILTER (x > 0 AND y > 0) AS both, count(*) FILTER (x > 0 OR y > 0) AS either,
          count(*) FILTER (y - x > 0.01) AS deeper, count(*) FILTER (y - x < -0.01) AS shallower
        FROM (SELECT coalesce(a.depth, 0) AS x, coalesce(b.depth, 0) AS y FROM (SELECT * FROM depth WHERE scenario = 1) a FULL JOIN (SELECT * FROM depth WHERE scenario = 5) b ON a.cell = b.cell)""",
        _DEPTH_SQL,
    ),
)
def scenario_compare(spark, d):
    depth = _depth(spark, d)
    return profile.compare_wet(depth.where("scenario = 1"), depth.where("scenario = 5"), ["cell"], "depth")


@query(
    "terrain_compare",
    """SELECT count(*) FILTER (c < -5) AS lowered_deep, count(*) FILTER (c >= -5 AND c < 0) AS lowered, count(*) FILTER (c > 0) AS raised, min(c) AS lowest_change, max(c) AS highest_change
       FROM (SELECT CAST(p_size % 23 - 11 AS DOUBLE) AS c FROM part)""",
)
def terrain_compare(spark, d):
    grid = bind.table(spark, d, "part").select(F.lit(0.0).alias("before"), (F.col("p_size") % 23 - 11).cast("double").alias("after"))
    return profile.compare_terrain(grid, "before", "after")


@query(
    "freeboard_percentiles",
    """WITH m AS (SELECT avg(p_retailprice) AS wse FROM part WHERE p_size % 5 = 0), f AS (SELECT p_retailprice - (SELECT wse FROM m) AS fb FROM part WHERE p_size % 5 <> 0),
    q AS (SELECT quantile_cont(fb, [0.0, 0.1, 0.5, 0.9, 1.0]) AS v FROM f)
    SELECT [0.0::DOUBLE, 0.1, 0.5, 0.9, 1.0][i] AS q, round(v[i], 6) AS freeboard FROM q, generate_series(1, 5) t(i)""",
)
def freeboard_percentiles(spark, d):
    part = bind.table(spark, d, "part").select("p_size", F.col("p_retailprice").alias("z"))
    out = profile.freeboard(part.where("p_size % 5 = 0"), part.where("p_size % 5 <> 0"), "z", "z", [0.0, 0.1, 0.5, 0.9, 1.0])
    return out.withColumn("freeboard", F.round("freeboard", 6))


@query(
    "flood_evolution",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS t, event_type AS site, value / 50 AS depth, value / 50 + 300 AS level FROM events)
    SELECT t, count(*) FILTER (depth > 0.1) AS flooded, round(max(depth) FILTER (site = 'click'), 9) AS click_depth, round(max(level) FILTER (site = 'click'), 9) AS click_level,
      round(max(depth) FILTER (site = 'error'), 9) AS error_depth, round(max(level) FILTER (site = 'error'), 9) AS error_level FROM e GROUP BY t""",
)
def flood_evolution(spark, d):
    e = bind.table(spark, d, "events").select(
        bind.day("ts").alias("t"), F.col("event_type").alias("site"), (F.col("value") / 50).alias("depth"), (F.col("value") / 50 + 300).alias("level")
    )
    out = profile.flood_evolution(e, "t", "site", "depth", "level", ["click", "error"])
    return out.withColumns({c: F.round(c, 9) for c in ("click_depth", "click_level", "error_depth", "error_level")})


@query(
    "basin_area_profile",
    """SELECT p_size % 6 AS level, count(*) AS n_basins, min(p_retailprice) AS min_area, max(p_retailprice) AS max_area, round(sum(p_retailprice), 4) AS total_area, round(quantile_cont(p_retailprice, 0.5), 6) AS median_area FROM part GROUP BY 1""",
)
def basin_area_profile(spark, d):
    rows = bind.table(spark, d, "part").select((F.col("p_size") % 6).alias("level"), "p_partkey", F.col("p_retailprice").alias("area"))
    out = profile.area_profile(rows, "level", "p_partkey", "area")
    return out.withColumns({"total_area": F.round("total_area", 4), "median_area": F.round("median_area", 6)})


@query(
    "road_groups",
    """SELECT p_partkey, CASE k WHEN 'motorway' THEN 'motorway' WHEN 'trunk' THEN 'motorway' WHEN 'primary' THEN 'primary' WHEN 'secondary' THEN 'secondary' WHEN 'tertiary' THEN 'tertiary'
         WHEN 'residential' THEN 'residential' WHEN 'service' THEN 'residential' ELSE 'other' END AS road, CASE WHEN o >= 7 THEN 'major' WHEN o >= 5 THEN 'large' WHEN o >= 3 THEN 'medium' ELSE 'small' END AS stream
       FROM (SELECT p_partkey, p_size % 9 + 1 AS o, ['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'residential', 'service', 'footway', 'trunk'][p_size % 9 + 1] AS k FROM part)""",
)
def road_groups(spark, d):
    names = F.array(*[F.lit(n) for n in ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "footway", "")])
    k = (F.col("p_size") % 9 + 1).cast("int")
    return bind.table(spark, d, "part").select(
        "p_partkey", profile.road_group(F.element_at(names, k), F.lit("trunk")).alias("road"), profile.stream_group(k).alias("stream")
    )


@query("top_basins", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def top_basins(spark, d):
    return profile.top_by(bind.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 30)


@query(
    "largest_overlap",
    "SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS s_suppkey, max(s_acctbal) AS overlap FROM supplier GROUP BY s_nationkey",
)
def largest_overlap(spark, d):
    return bind.table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("s_suppkey"), F.max("s_acctbal").alias("overlap")
    )


@query(
    "affected_people",
    """SELECT CAST(sum(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 10 END) AS BIGINT) AS people, count(CASE WHEN c_custkey % 5 <> 0 THEN 1 END) AS n_known, count(*) AS n_regions FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def affected_people(spark, d):
    c = bind.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("status"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") * 10).alias("people")
    )
    return profile.affected_total(c, "people", "status", "BUILDING")


@query(
    "watershed_levels",
    """SELECT s_suppkey AS id, 'e' || CAST(s_suppkey AS VARCHAR) AS entry, s_acctbal AS lat, CAST(CASE WHEN s_suppkey % 3 <> 0 THEN 12 WHEN s_suppkey % 2 = 0 THEN 10 END AS INTEGER) AS level,
         CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal + 10000 WHEN s_suppkey % 2 = 0 THEN s_acctbal + 20000 END AS up_area_km2 FROM supplier""",
)
def watershed_levels(spark, d):
    k, a = F.col("s_suppkey"), F.col("s_acctbal")
    row = lambda v: F.struct(k.alias("hybas_id"), a.alias("sub_area_km2"), v.alias("up_area_km2"))
    levels = F.create_map(
        F.lit("12"), F.when(k % 3 != 0, row(a + 10000)), F.lit("10"), F.when(k % 2 == 0, row(a + 20000))
    )
    doc = F.to_json(F.create_map(F.concat(F.lit("e"), k.cast("string")), F.struct(a.alias("lat"), a.alias("lon"), levels.alias("levels"))))
    docs = bind.table(spark, d, "supplier").select(k.alias("id"), doc.alias("doc"))
    return profile.watershed_levels(docs, "doc").select("id", "entry", "lat", "level", "up_area_km2")
