"""Readers, writers, filters, set operations and text formats on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.functions import dates, formats
from pluvion.operators import filters, graph
from pluvion.sources import lean, manifest, vector, zonetext

QUERIES, ORACLES, query = bind.area()

# ---- line items as rows of the lean long table, with reruns, hindcast marks and bad codes

LEAN_SQL = """
lean AS (SELECT strftime(l_shipdate, '%Y%m%dT') || CASE WHEN l_linenumber = 7 THEN '06' ELSE '00' END AS gtime,
                CAST(l_suppkey AS INTEGER) AS zone_id, 1 AS zone_nu,
                CAST(l_linenumber AS INTEGER) AS variable, l_quantity AS mean_value,
                '20260101T0' || CAST(l_orderkey % 2 AS VARCHAR) AS processed_at,
                CASE WHEN l_linestatus = 'F' THEN 'hc_20260101' ELSE strftime(l_shipdate - to_days(CAST(l_orderkey % 25 AS INTEGER)), '%Y%m%d') END AS source_date
         FROM lineitem)
"""


def lean_rows(spark, d):
    back = F.make_dt_interval((F.col("l_orderkey") % 25).cast("int"))
    return bind.table(spark, d, "lineitem").select(
        F.concat(
            F.date_format("l_shipdate", "yyyyMMdd'T'"), F.when(F.col("l_linenumber") == 7, "06").otherwise("00")
        ).alias("gtime"),
        F.col("l_suppkey").cast("int").alias("zone_id"),
        F.lit(1).alias("zone_nu"),
        F.col("l_linenumber").alias("variable"),
        F.col("l_quantity").alias("mean_value"),
        F.concat(F.lit("20260101T0"), (F.col("l_orderkey") % 2).cast("string")).alias("processed_at"),
        F.when(F.col("l_linestatus") == "F", "hc_20260101")
        .otherwise(F.date_format(F.col("l_shipdate") - back, "yyyyMMdd"))
        .alias("source_date"),
    )


@query(
    "lean_read",
    bind.with_sql(
        """SELECT variable, count(*) AS n, count(DISTINCT gtime) AS n_times, min(gtime) AS first_time, max(gtime) AS last_time,
             count(mean_value) AS n_valid
        FROM lean WHERE variable IN (1, 2, 3, 4, 5) GROUP BY variable""",
        LEAN_SQL,
    ),
)
def lean_read(spark, d):
    known = lean.known_variables(lean_rows(spark, d).withColumnRenamed("zone_id", "zones_id"))
    per_time = known.groupBy("variable", "gtime").agg(F.count("*").alias("n"), F.count("mean_value").alias("v"))
    return per_time.groupBy("variable").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_times"),
        F.min("gtime").alias("first_time"),
        F.max("gtime").alias("last_time"),
        F.sum("v").alias("n_valid"),
    )


@query(
    "append_dedupe",
    bind.with_sql(
        """SELECT DISTINCT * FROM (SELECT gtime, zone_id % 10 AS zone_id, zone_nu, variable, round(mean_value / 10) AS mean_value,
             processed_at, source_date FROM lean WHERE zone_id % 3 <> 0
           UNION ALL SELECT gtime, zone_id % 10, zone_nu, variable, round(mean_value / 10), processed_at, source_date
             FROM lean WHERE zone_id % 3 <> 1)""",
        LEAN_SQL,
    ),
)
def append_dedupe(spark, d):
    rows = lean_rows(spark, d)
    coarse = rows.withColumns(
        {"mean_value": F.round(F.col("mean_value") / 10), "zone_id": F.col("zone_id") % 10, "_z": F.col("zone_id") % 3}
    )
    return lean.append_distinct(coarse.where("_z <> 0").drop("_z"), coarse.where("_z <> 1").drop("_z"))


@query(
    "total_sort",
    bind.with_sql(
        """SELECT gtime, zone_id, variable, mean_value, row_number() OVER (ORDER BY gtime, zone_id, variable, mean_value) - 1 AS place FROM lean""", LEAN_SQL
    ),
)
def total_sort(spark, d):
    rows = lean_rows(spark, d).select("gtime", "zone_id", "variable", "mean_value")
    placed = lean.sort_lean(rows, "mean_value").withColumn("_id", F.monotonically_increasing_id())  # grows with the order that the sort left
    return graph.number_rows(placed, [F.col("_id")], "place").drop("_id")


@query(
    "hindcast_split",
    bind.with_sql(
        """SELECT source_date LIKE 'hc\\_%' ESCAPE '\\' AS hindcast, variable, count(*) AS n, min(gtime) AS first_time, max(gtime) AS last_time
        FROM lean GROUP BY ALL""",
        LEAN_SQL,
    ),
)
def hindcast_split(spark, d):
    past, future = filters.split_hindcast(lean_rows(spark, d))
    both = past.withColumn("hindcast", F.lit(True)).unionByName(future.withColumn("hindcast", F.lit(False)))
    return both.groupBy("hindcast", "variable").agg(
        F.count("*").alias("n"), F.min("gtime").alias("first_time"), F.max("gtime").alias("last_time")
    )


_FC = """
fc AS (SELECT *, date_diff('day', strptime(source_date, '%Y%m%d'), strptime(gtime[1:8], '%Y%m%d')) AS k
       FROM lean WHERE source_date NOT LIKE 'hc%')
"""


@query(
    "forecast_window",
    bind.with_sql(
        """SELECT gtime, zone_id, variable, mean_value, source_date FROM fc WHERE gtime LIKE '%T00' AND k BETWEEN 0 AND 17""",
        LEAN_SQL,
        _FC,
    ),
)
def forecast_window(spark, d):
    _, future = filters.split_hindcast(lean_rows(spark, d))
    return filters.forecast_window(future, 18).select("gtime", "zone_id", "variable", "mean_value", "source_date")


@query(
    "forecast_summary",
    bind.with_sql(
        """SELECT source_date, variable, count(*) AS original_records,
          count(*) FILTER (gtime LIKE '%T00' AND k BETWEEN 0 AND 17) AS forecast_records,
          count(DISTINCT gtime) FILTER (gtime LIKE '%T00' AND k BETWEEN 0 AND 17) AS actual_dates,
          18 - count(DISTINCT gtime) FILTER (gtime LIKE '%T00' AND k BETWEEN 0 AND 17) AS missing_dates
        FROM fc GROUP BY source_date, variable""",
        LEAN_SQL,
        _FC,
    ),
)
def forecast_summary(spark, d):
    _, future = filters.split_hindcast(lean_rows(spark, d))
    return filters.forecast_summary(future, 18)


@query(
    "region_subset",
    """WITH p AS (SELECT c_custkey, CAST(c_custkey % 181 AS DOUBLE) - 90 AS lat, CAST(c_custkey * 7 % 360 AS DOUBLE) AS lon FROM customer),
    w AS (SELECT c_custkey, lat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM p)
    SELECT * FROM w WHERE lat BETWEEN -13 AND 24 AND lon BETWEEN -61 AND 53""",
)
def region_subset(spark, d):
    pts = bind.table(spark, d, "customer").select(
        "c_custkey",
        ((F.col("c_custkey") % 181).cast("double") - 90).alias("lat"),
        (F.col("c_custkey") * 7 % 360).cast("double").alias("lon"),
    )
    return filters.region_subset(pts, (-12.0, 23.0), (-60.0, 52.0))


@query(
    "half_open_window",
    """SELECT event_id, user_id, value FROM events
       WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 06:30:00'""",
)
def half_open_window(spark, d):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    ev = bind.table(spark, d, "events")
    return filters.time_window(ev, "ts", at("2024-01-05 00:00:00"), at("2024-01-12 06:30:00")).select(
        "event_id", "user_id", "value"
    )


@query(
    "mask_cells",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size <= 25 THEN l_quantity END AS depth
       FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
)
def mask_cells(spark, d):
    cells = bind.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("depth")
    )
    width = bind.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return filters.mask_cells(cells, width, ["l_partkey"], F.col("p_size") <= 25, ["depth"])


@query(
    "julian_convert",
    """SELECT DISTINCT strftime(l_shipdate, '%Y%m%dT00') AS gtime, strftime(l_shipdate, '%Y%j') AS julian,
        strftime(l_shipdate, '%Y%m%dT00') AS back FROM lineitem""",
)
def julian_convert(spark, d):
    days = bind.table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMMdd'T00'").alias("gtime")
    ).distinct()
    out = days.withColumn("julian", dates.gtime_to_julian(F.col("gtime")))
    return out.withColumn("back", dates.julian_to_gtime(F.col("julian")))


@query(
    "mixed_dates",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'day ' || CAST(o_orderkey AS VARCHAR) ELSE strftime(o_orderdate, '%Y%m%d') END || 'T00' AS gtime
       FROM orders""",
)
def mixed_dates(spark, d):
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 1, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(k == 2, F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.concat(F.lit(" day "), F.col("o_orderkey").cast("string")))
    )
    return bind.table(spark, d, "orders").select("o_orderkey", dates.mixed_date_to_gtime(text).alias("gtime"))


@query(
    "filename_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def filename_dates(spark, d):
    k = F.col("o_orderkey") % 5
    fmt = lambda p: F.date_format("o_orderdate", p)
    name = (
        F.when(k == 0, F.concat(F.lit("et"), fmt("yyMMdd"), F.lit(".bil")))
        .when(k == 1, F.concat(F.lit("3B-HHR-E.MS.MRG.3IMERG."), fmt("yyyyMMdd"), F.lit("-S233000-E235959.1410.V07B.1day.tif")))
        .when(k == 2, F.concat(F.lit("data."), fmt("yyyy.MMdd"), F.lit(".tif")))
        .when(k == 3, F.concat(F.lit("rain_"), fmt("yyyyMMdd"), F.lit("_v1.nc")))
        .otherwise(F.lit("readme.txt"))
    )
    # The two-digit year of the first grammar means 20xx, so those days move a century.
    found = dates.filename_date(name)
    century = F.when((k == 0) & (F.year("o_orderdate") < 2000), F.add_months(found, -1200)).otherwise(found)
    return bind.table(spark, d, "orders").select("o_orderkey", bind.day(century).alias("day"))


@query(
    "season_leads",
    """SELECT o_orderkey, s AS season, CASE WHEN lead BETWEEN 1 AND 6 THEN CAST(lead AS INTEGER) END AS lead,
         CAST(year(o_orderdate) AS INTEGER) + CASE WHEN (s = 'DJF' AND a <= month(o_orderdate)) OR (s <> 'DJF' AND a < month(o_orderdate)) THEN 1 ELSE 0 END AS anchor_year
       FROM (SELECT *, (a - month(o_orderdate) + 12) % 12 AS lead FROM orders, (VALUES ('MAM', 5), ('JJA', 8), ('OND', 11), ('DJF', 2)) t(s, a))""",
)
def season_leads(spark, d):
    seasons = F.explode(F.array(*[F.lit(s) for s in dates.SEASON_ANCHOR]))
    o = bind.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("init"), seasons.alias("season"))
    return o.select(
        "o_orderkey",
        "season",
        dates.season_lead(F.month("init"), F.col("season")).alias("lead"),
        F.year(dates.season_month(F.col("init"), F.col("season"))).alias("anchor_year"),
    )


@query(
    "valid_times",
    """SELECT event_id, strftime(ts + to_hours(CAST(event_id % 50 * 6 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS valid_time FROM events""",
)
def valid_times(spark, d):
    step = (F.col("event_id") % 50 * 6).cast("int")
    return bind.table(spark, d, "events").select(
        "event_id", F.date_format(dates.valid_time(F.col("ts"), step), "yyyy-MM-dd HH:mm:ss").alias("valid_time")
    )


@query(
    "number_format",
    """SELECT c_custkey, CASE WHEN v > 0 THEN printf('%.1f', v) ELSE '0' END AS zone_text,
         CASE WHEN v <= 0.01 THEN '0.0' ELSE printf('%.1f', round_even(v * 10, 0) / 10) END AS gauge_text
       FROM (SELECT c_custkey, c_acctbal / 16 AS v FROM customer
             UNION ALL SELECT c_custkey, c_custkey * 0.05::DOUBLE - 1 FROM customer)""",
)
def number_format(spark, d):
    c = bind.table(spark, d, "customer")
    both = c.select("c_custkey", (F.col("c_acctbal") / 16).alias("v")).unionByName(
        c.select("c_custkey", (F.col("c_custkey") * F.lit(0.05) - 1).alias("v"))
    )
    return both.select(
        "c_custkey",
        formats.zone_value_text(F.col("v")).alias("zone_text"),
        formats.gauge_value_text(F.col("v")).alias("gauge_text"),
    )


# ---- zone text: suppliers are the zones of 25 files, header order by account balance

_LAST = """
vals AS (SELECT s_nationkey AS zone, strftime(l_shipdate, '%Y%j') AS julian, l_suppkey AS zone_id,
                arg_max(l_quantity / 8 - 1, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS value
         FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
header AS (SELECT s_nationkey AS zone, s_suppkey AS gridcode,
                  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier)
"""


def _zone_header(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("zone").orderBy("s_acctbal", "gridcode")
    return (
        bind.table(spark, d, "supplier")
        .select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("gridcode"), "s_acctbal")
        .select("zone", "gridcode", (F.row_number().over(order) - 1).alias("pos"))
    )


def _zone_text(spark, d):
    """Header and day lines of the zone files built from the line items."""
    header = _zone_header(spark, d)
    shapes = header.select("zone", F.col("gridcode").alias("GRIDCODE"), F.col("gridcode").alias("id"))
    places = zonetext.header_positions(header, shapes)
    rank = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    values = (
        bind.table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("zone_id"), F.date_format("l_shipdate", "yyyyDDD").alias("julian"))
        .agg(F.max_by(F.col("l_quantity") / 8 - 1, rank).alias("value"))
        .join(places, "zone_id")
    )
    size = header.groupBy("zone").agg(F.count("*").cast("int").alias("size"))
    return zonetext.header_lines(header), zonetext.zone_lines(values, size)


@query(
    "zone_text_write",
    bind.with_sql(
        """, d AS (SELECT DISTINCT zone, julian FROM vals)
        SELECT d.zone, d.julian AS day, d.julian || ',' || string_agg(CASE WHEN v.value > 0 THEN printf('%.1f', v.value) ELSE '0' END, ',' ORDER BY h.pos) AS line
        FROM d JOIN header h ON h.zone = d.zone LEFT JOIN vals v ON v.zone = d.zone AND v.julian = d.julian AND v.zone_id = h.gridcode
        GROUP BY d.zone, d.julian
        UNION ALL SELECT zone, '', 'NA,' || string_agg(CAST(gridcode AS VARCHAR), ',' ORDER BY pos) FROM header GROUP BY zone""",
        _LAST,
    ),
)
def zone_text_write(spark, d):
    header, lines = _zone_text(spark, d)
    return lines.select("zone", F.col("julian").alias("day"), "line").unionByName(
        header.select("zone", F.lit("").alias("day"), "line")
    )


def _as_lines(spark, d):
    header, lines = _zone_text(spark, d)
    rows = header.select("zone", F.lit("").alias("k"), F.col("line").alias("value")).unionByName(
        lines.select("zone", F.col("julian").alias("k"), F.col("line").alias("value"))
    )
    return rows.select(F.concat(F.lit("zone"), F.col("zone").cast("string"), F.lit("/rain.txt")).alias("file"), F.col("k").alias("pos"), "value")


@query(
    "unpivot_wide",
    bind.with_sql(
        """SELECT strftime(strptime(d.julian, '%Y%j'), '%Y%m%dT00') AS gtime, CAST(h.gridcode AS INTEGER) AS zone_id, 1 AS zone_nu, 1 AS variable,
          CASE WHEN v.value > 0 THEN CAST(printf('%.1f', v.value) AS DOUBLE) ELSE 0.0 END AS mean_value, '20260101T00' AS processed_at, 'hc_20260101' AS source_date
        FROM (SELECT DISTINCT zone, julian FROM vals) d JOIN header h ON h.zone = d.zone
        LEFT JOIN vals v ON v.zone = d.zone AND v.julian = d.julian AND v.zone_id = h.gridcode""",
        _LAST,
    ),
)
def unpivot_wide(spark, d):
    return zonetext.zone_lines_to_lean(_as_lines(spark, d), "20260101T00", "20260101")


@query(
    "model_text_parse",
    """WITH o AS (SELECT o_custkey % 6 AS f, o_orderdate AS t, o_orderkey AS k, o_totalprice AS p FROM orders),
    v AS (SELECT f, t, k, unnest([7, 11, 13]) AS zone_id, unnest([CASE WHEN k % 3 = 0 THEN NULL ELSE p END, p / 2, CASE WHEN k % 5 = 0 THEN 0.0 ELSE p / 4 END]) AS value FROM o WHERE k % 7 <> 0)
    SELECT 'streamflow_zone' || CAST(f AS VARCHAR) AS file, strftime(t, '%Y%m%dT00') AS gtime, CAST(zone_id AS VARCHAR) AS zone_id, value
    FROM v WHERE value IS NOT NULL""",
)
def model_text_parse(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    o = bind.table(spark, d, "orders").withColumn("f", F.concat(F.lit("streamflow_zone"), (F.col("o_custkey") % 6).cast("string")))
    text = lambda c: c.cast("string")
    when = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    full = F.concat_ws(
        ",", when, F.when(k % 3 == 0, "n/a").otherwise(text(p)), text(p / 2), F.when(k % 5 == 0, "0").otherwise(text(p / 4))
    )
    body = o.select(F.col("f").alias("file"), (k + 1).alias("pos"), F.when(k % 7 == 0, F.concat_ws(",", when, text(p))).otherwise(full).alias("value"))
    header = o.select(F.col("f").alias("file"), F.lit(0).cast("bigint").alias("pos"), F.lit("time, 7,11 ,13").alias("value")).distinct()
    return zonetext.parse_model_lines(header.unionByName(body))


@query(
    "header_positions",
    """WITH h AS (SELECT s_nationkey AS zone, s_suppkey AS gridcode, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier)
    SELECT zone, gridcode + 1000 AS zone_id, CAST(pos AS INTEGER) AS pos,
       CAST(row_number() OVER (PARTITION BY zone ORDER BY gridcode) - 1 AS INTEGER) AS pos_by_code
    FROM h WHERE gridcode % 4 <> 0""",
)
def header_positions(spark, d):
    header = _zone_header(spark, d)
    shapes = header.where("gridcode % 4 <> 0").select(
        "zone", F.col("gridcode").alias("GRIDCODE"), (F.col("gridcode") + 1000).alias("id")
    )
    kept = zonetext.header_positions(header, shapes)
    sorted_ = zonetext.positions_by_code(shapes).withColumnRenamed("pos", "pos_by_code")
    return kept.join(sorted_, ["zone", "zone_id"])


# ---- listings

@query(
    "latest_folder",
    """SELECT max(strftime(o_orderdate, '%Y%m%d')) AS latest FROM orders WHERE o_orderkey % 3 = 0""",
)
def latest_folder(spark, d):
    k = F.col("o_orderkey") % 3
    names = bind.table(spark, d, "orders").select(
        F.concat(
            F.when(k == 0, "zone_run_").when(k == 1, "other_").otherwise("zone_run_x"),
            F.date_format("o_orderdate", "yyyyMMdd"),
        ).alias("name")
    )
    return manifest.latest_dated_folder(names, "name", "zone_run_")


@query(
    "middle_dates",
    """SELECT month, day, n_dates FROM (SELECT substr(day, 1, 6) AS month, day, row_number() OVER (PARTITION BY substr(day, 1, 6) ORDER BY day) - 1 AS i,
         count(*) OVER (PARTITION BY substr(day, 1, 6)) AS n_dates FROM (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day FROM orders))
       WHERE i = n_dates // 2""",
)
def middle_dates(spark, d):
    days = bind.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    return manifest.middle_date_per_month(days, "day")


@query(
    "first_nine_steps",
    """SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem ORDER BY 1 LIMIT 9""",
)
def first_nine_steps(spark, d):
    days = bind.table(spark, d, "lineitem").select(bind.day("l_shipdate").alias("day"))
    return manifest.first_steps(days, "day", 9)


_MANIFEST = """
src AS (SELECT 'file_' || CAST(doc_id AS VARCHAR) || '.tif' AS name, n_chars AS size FROM documents),
dst AS (SELECT 'file_' || CAST(doc_id AS VARCHAR) || '.tif' AS name, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size
        FROM documents WHERE doc_id % 2 = 0)
"""


@query(
    "manifest_diff",
    bind.with_sql(
        """SELECT s.name, s.size, CASE WHEN d.size = s.size THEN 'skip' ELSE 'upload' END AS status FROM src s LEFT JOIN dst d USING (name)""",
        _MANIFEST,
    ),
)
def manifest_diff(spark, d):
    docs = bind.table(spark, d, "documents").select("doc_id", "n_chars")
    name = F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit(".tif")).alias("name")
    src = docs.select(name, F.col("n_chars").alias("size"))
    dst = docs.where("doc_id % 2 = 0").select(
        name, (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size")
    )
    return manifest.manifest_status(src, dst)


@query(
    "manifest_counts",
    bind.with_sql(
        """SELECT CASE WHEN d.size = s.size THEN 'skip' ELSE 'upload' END AS status, count(*) AS n FROM src s LEFT JOIN dst d USING (name) GROUP BY 1""",
        _MANIFEST,
    ),
)
def manifest_counts(spark, d):
    return manifest_diff(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "incremental_start",
    """WITH held AS (SELECT o_custkey % 25 AS zone, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 25 < 20 GROUP BY 1)
    SELECT o_orderkey, o_custkey % 25 AS zone, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders LEFT JOIN held ON zone = o_custkey % 25
    WHERE o_orderstatus <> 'F' AND (last IS NULL OR o_orderdate > last - to_days(60))""",
)
def incremental_start(spark, d):
    o = bind.table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", (F.col("o_custkey") % 25).alias("zone"), F.to_date("o_orderdate").alias("d")
    )
    held = o.where("o_orderstatus = 'F' AND zone < 20").select("zone", F.date_sub("d", 60).alias("d"))
    out = manifest.rows_after_last(o.where("o_orderstatus <> 'F'"), held, "zone", "d")
    return out.select("o_orderkey", "zone", bind.day("d").alias("day"))


@query(
    "skip_processed",
    """SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""",
)
def skip_processed(spark, d):
    work = bind.table(spark, d, "orders").select("o_orderkey")
    done = bind.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return manifest.not_processed(work, done, ["o_orderkey"])


@query(
    "upsert_axis",
    """WITH e AS (SELECT DISTINCT l_returnflag AS var, strftime(l_shipdate, '%Y-%m-%d') AS step, CAST(1 AS DOUBLE) AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    f AS (SELECT l_returnflag AS var, strftime(l_shipdate, '%Y-%m-%d') AS step, CASE WHEN l_returnflag <> 'A' THEN sum(l_quantity) END AS value FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-06-01' GROUP BY 1, 2),
    ax AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS step FROM orders),
    t AS (SELECT * FROM f WHERE step IN (SELECT step FROM ax) AND var IN (SELECT var FROM f WHERE value IS NOT NULL))
    SELECT * FROM t UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.var = e.var AND t.step = e.step)""",
)
def upsert_axis(spark, d):
    li = bind.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("var"), bind.day("l_shipdate").alias("step"), "l_quantity"
    )
    existing = li.where("step < '1998-01-01'").select("var", "step", F.lit(1.0).alias("value")).distinct()
    fresh = li.where("step >= '1997-06-01'").groupBy("var", "step").agg(F.sum("l_quantity").alias("value"))
    fresh = fresh.withColumn("value", F.when(F.col("var") != "A", F.col("value")))
    axis = bind.table(spark, d, "orders").select(bind.day("o_orderdate").alias("step"))
    return manifest.upsert_steps(existing, fresh, axis, "step", "var", "value")


@query(
    "tracked_inits",
    """SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS init FROM orders""",
)
def tracked_inits(spark, d):
    return manifest.distinct_inits(
        bind.table(spark, d, "orders").select(bind.day(F.trunc("o_orderdate", "month")).alias("init")), "init"
    )


# ---- set operations

@query(
    "expected_minus_actual",
    """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
    e AS (SELECT CAST(unnest(generate_series(min(day), max(day) - 30, INTERVAL 1 DAY)) AS DATE) AS day FROM a)
    SELECT 'missing' AS kind, strftime(day, '%Y-%m-%d') AS day FROM (SELECT day FROM e EXCEPT SELECT day FROM a)
    UNION ALL SELECT 'extra', strftime(day, '%Y-%m-%d') FROM (SELECT day FROM a EXCEPT SELECT day FROM e)""",
)
def expected_minus_actual(spark, d):
    actual = (
        bind.table(spark, d, "orders")
        .select(F.to_date("o_orderdate").alias("day"))
        .distinct()
    )
    span = actual.agg(F.min("day").alias("a"), F.date_sub(F.max("day"), 30).alias("b"))
    expected = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return (
        expected.subtract(actual).select(F.lit("missing").alias("kind"), bind.day("day").alias("day"))
        .unionByName(actual.subtract(expected).select(F.lit("extra").alias("kind"), bind.day("day").alias("day")))
    )


@query(
    "footprint_overlap",
    """SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS both_cells,
         (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS only_first""",
)
def footprint_overlap(spark, d):
    li = bind.table(spark, d, "lineitem")
    flags = li.groupBy("l_partkey").agg(
        F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r")
    )
    return flags.agg(
        F.count_if(F.col("a") & F.col("r")).alias("both_cells"), F.count_if(F.col("a") & ~F.col("r")).alias("only_first")
    )


# ---- vector data and discharge

def _features(spark, d):
    """Orders as river segments: one feature per order, its line items are the points."""
    pts = (
        bind.table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
                        F.col("l_quantity").alias("q"),
                    )
                )
            ).alias("pts")
        )
    )
    xy = F.transform("pts", lambda x: F.array(x["q"], x["s"].cast("double")))
    return pts.select(F.col("l_orderkey").alias("linkno"), (F.col("l_orderkey") % 6 + 1).cast("int").alias("stream_order"), xy.alias("xy"))


@query(
    "feature_rows",
    """SELECT l_orderkey AS linkno, CAST(l_orderkey % 6 + 1 AS INTEGER) AS stream_order, count(*) AS n_points,
        round(sum(l_quantity), 4) AS sum_lon, round(sum(CAST(l_suppkey AS DOUBLE)), 4) AS sum_lat FROM lineitem WHERE l_orderkey % 4 <> 3 GROUP BY l_orderkey""",
)
def feature_rows(spark, d):
    f = _features(spark, d)
    kind = F.when(F.col("linkno") % 4 < 2, "LineString").when(F.col("linkno") % 4 == 2, "MultiLineString").otherwise("Point")
    coords = F.when(kind == "MultiLineString", F.to_json(F.array("xy"))).otherwise(F.to_json("xy"))
    docs = f.select(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"linkno":'),
            F.col("linkno").cast("string"), F.lit(',"stream_order":'), F.col("stream_order").cast("string"),
            F.lit('},"geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit("}}]}"),
        ).alias("doc")
    )
    seg = vector.features_of(docs, "doc")
    total = lambda axis: F.aggregate("coords", F.lit(0.0), lambda a, p: a + p[axis])
    return seg.select(
        "linkno", "stream_order", F.size("coords").cast("bigint").alias("n_points"),
        F.round(total("lon"), 4).alias("sum_lon"), F.round(total("lat"), 4).alias("sum_lat"),
    )


@query(
    "feature_write",
    """WITH l AS (SELECT l_partkey AS linkno, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS x, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS y,
          arg_max(l_linenumber, l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY l_partkey)
    SELECT linkno, '{"type":"Feature","properties":{"linkno":' || CAST(linkno AS VARCHAR) || ',"stream_order":' || CAST(o AS VARCHAR)
       || '},"geometry":{"type":"LineString","coordinates":[[' || CAST(x AS VARCHAR) || ',' || CAST(CAST(y AS DOUBLE) AS VARCHAR) || '],[0.0,0.0]]}}' AS feature FROM l""",
)
def feature_write(spark, d):
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    seg = bind.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("linkno"),
        F.col("l_linenumber").alias("stream_order"),
        F.array(pt(F.col("l_quantity"), F.col("l_suppkey").cast("double")), pt(F.lit(0.0), F.lit(0.0))).alias("coords"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return vector.segments_to_features(seg, "seq")


_FLOW = """
flow AS (SELECT date_trunc('hour', ts) AS time, user_id AS river_id, sum(value) AS "Q" FROM events GROUP BY 1, 2)
"""


def _flow(spark, d):
    return (
        bind.table(spark, d, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), F.col("user_id").alias("river_id"))
        .agg(F.sum("value").alias("Q"))
    )


@query(
    "pivot_wide",
    bind.with_sql(
        """SELECT strftime(time, '%Y-%m-%d %H') AS time, round(max("Q") FILTER (river_id = 3), 4) AS "Q_3_m3s", round(max("Q") FILTER (river_id = 8), 4) AS "Q_8_m3s",
           round(max("Q") FILTER (river_id = 46), 4) AS "Q_46_m3s"
        FROM flow WHERE time >= TIMESTAMP '2024-01-02' AND time < TIMESTAMP '2024-01-20' AND river_id IN (3, 8, 46) GROUP BY flow.time""",
        _FLOW,
    ),
)
def pivot_wide(spark, d):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    wide = vector.discharge_window(_flow(spark, d), at("2024-01-02"), at("2024-01-20"), [3, 8, 46])
    return wide.select(
        F.date_format("time", "yyyy-MM-dd HH").alias("time"), *[F.round(f"Q_{i}_m3s", 4).alias(f"Q_{i}_m3s") for i in (3, 8, 46)]
    )


@query(
    "discharge_summary",
    bind.with_sql(
        """SELECT river_id, round(avg(q), 6) AS mean_q, round(min(q), 4) AS min_q, round(max(q), 4) AS peak_q, round(sum(q), 4) AS total_q,
           strftime(min(time) FILTER (q = m), '%Y-%m-%d %H') AS peak_time
        FROM (SELECT river_id, time, round("Q", 4) AS q, max(round("Q", 4)) OVER (PARTITION BY river_id) AS m FROM flow) GROUP BY river_id""",
        _FLOW,
    ),
)
def discharge_summary(spark, d):
    flow = _flow(spark, d).withColumn("Q", F.round("Q", 4))
    out = vector.discharge_summary(flow)
    return out.select(
        "river_id", F.round("mean_q", 6).alias("mean_q"), "min_q", "peak_q", F.round("total_q", 4).alias("total_q"),
        F.date_format("peak_time", "yyyy-MM-dd HH").alias("peak_time"),
    )
