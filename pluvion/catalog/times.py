"""Time-series operators on the driver tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.operators import align, temporal
from pluvion.plans import wrsi

QUERIES, ORACLES, query = bind.area()


@query(
    "daily_totals",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 4) AS total, round(avg(value), 6) AS mean,
         round(greatest(-sum(value * CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) * 1000, 0), 3) AS flux
       FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""",
)
def daily_totals(spark, d):
    ev = bind.table(spark, d, "events").select(
        "user_id",
        "ts",
        F.col("value").alias("total"),
        F.col("value").alias("mean"),
        (F.col("value") * F.when(F.col("event_type") == "error", 1).otherwise(-1)).alias("flux"),
    )
    out = temporal.daily(ev, ["user_id"], "ts", sums=["total", "flux"], means=["mean"])
    return out.select(
        "user_id",
        bind.day("day").alias("day"),
        F.round("total", 4).alias("total"),
        F.round("mean", 6).alias("mean"),
        F.round(F.greatest(-F.col("flux") * 1000, F.lit(0.0)), 3).alias("flux"),
    )


@query(
    "ensemble_daily_mean",
    bind.with_sql(
        """SELECT zone_id, strftime(time, '%Y-%m-%d') AS day, round(avg(s), 6) AS value
        FROM (SELECT CAST(zone_id AS INTEGER) AS zone_id, time, member, sum(value) AS s
              FROM grid JOIN cell_zone USING (cell) GROUP BY ALL) GROUP BY zone_id, time""",
        bind.GRID_SQL,
    ),
)
def ensemble_daily_mean(spark, d):
    g = bind.grid(spark, d).join(bind.cell_zone(spark, d).where("zone_id <> 0"), "cell")
    out = temporal.ensemble_daily_mean(g, ["zone_id"], "member", "time", "value")
    return out.select("zone_id", bind.day("day").alias("day"), F.round("value", 6).alias("value"))


@query(
    "dekad_resample",
    bind.with_sql(
        """, b AS (SELECT (SELECT min(day) FROM series) AS d0, (SELECT max(day) FROM series) AS d1)
        SELECT z.zone_id, strftime(d0 + CAST(10 * k AS INTEGER), '%Y-%m-%d') AS bin,
               coalesce(round(sum(s.value), 2), 0) AS value
        FROM b, generate_series(0, (d1 - d0) // 10) t(k), (SELECT DISTINCT zone_id FROM series) z
        LEFT JOIN series s ON s.zone_id = z.zone_id AND (s.day - d0) // 10 = k
        GROUP BY z.zone_id, d0, k""",
        bind.SERIES_SQL,
    ),
)
def dekad_resample(spark, d):
    out = temporal.resample_days(bind.series(spark, d), ["zone_id"], "day", ["value"])
    return out.select("zone_id", bind.day("bin").alias("bin"), F.round("value", 2).alias("value"))


_BINS = """
edge AS (SELECT min(day) AS d0, max(day) AS d1 FROM balance),
bins AS (SELECT c.cell, d0 + CAST(10 * k AS INTEGER) AS bin, coalesce(sum(aet), 0) AS aet, coalesce(sum(pet), 0) AS pet
         FROM edge, generate_series(0, (d1 - d0) // 10) t(k), (SELECT DISTINCT cell FROM balance) c
         LEFT JOIN balance b ON b.cell = c.cell AND (b.day - d0) // 10 = k GROUP BY c.cell, d0, k),
ytd AS (SELECT cell, bin, sum(aet) OVER w AS ca, sum(pet) OVER w AS cp FROM bins
        WINDOW w AS (PARTITION BY cell, year(bin) ORDER BY bin))
"""


@query(
    "ytd_ratio",
    bind.with_sql(
        """SELECT cell, strftime(bin, '%Y-%m-%d') AS bin,
             round(CASE WHEN cp > 1e-6 THEN least(greatest(100 * ca / cp, 0), 150) END, 6) AS wrsi FROM ytd""",
        bind.BALANCE_SQL,
        _BINS,
    ),
)
def ytd_ratio(spark, d):
    out = wrsi.season_to_date(bind.balance(spark, d), ["cell"], "day")
    return out.select("cell", bind.day("bin").alias("bin"), F.round("wrsi", 6).alias("wrsi"))


@query(
    "ytd_ratio_latest",
    bind.with_sql(
        """SELECT cell, round(CASE WHEN cp > 1e-6 THEN least(greatest(100 * ca / cp, 0), 150) END, 6) AS wrsi
           FROM ytd WHERE bin = (SELECT max(bin) FROM bins)""",
        bind.BALANCE_SQL,
        _BINS,
    ),
)
def ytd_ratio_latest(spark, d):
    out = wrsi.latest_season_to_date(bind.balance(spark, d), ["cell"], "day")
    return out.select("cell", F.round("wrsi", 6).alias("wrsi"))


@query(
    "period_ratio",
    bind.with_sql(
        """SELECT cell, round(CASE WHEN sp > 1e-6 THEN least(greatest(100 * sa / sp, 0), 150) END, 6) AS wrsi
        FROM (SELECT cell, coalesce(sum(aet), 0) AS sa, coalesce(sum(pet), 0) AS sp FROM balance GROUP BY cell)""",
        bind.BALANCE_SQL,
    ),
)
def period_ratio(spark, d):
    return wrsi.period(bind.balance(spark, d), ["cell"]).select("cell", F.round("wrsi", 6).alias("wrsi"))


@query(
    "annual_ratio_bands",
    bind.with_sql(
        """SELECT year, count(*) AS n_cells, round(avg(w), 6) AS mean_of_ratios,
            round(100 * sum(sa) / sum(sp), 6) AS ratio_of_means,
            round(avg(CASE WHEN w < 50 THEN 100.0 ELSE 0 END), 6) AS pct_failed,
            round(avg(CASE WHEN w >= 50 AND w < 80 THEN 100.0 ELSE 0 END), 6) AS pct_stressed,
            round(avg(CASE WHEN w >= 80 THEN 100.0 ELSE 0 END), 6) AS pct_good
        FROM (SELECT *, CASE WHEN sp > 1e-6 THEN least(greatest(100 * sa / sp, 0), 150) END AS w
              FROM (SELECT cell, CAST(year(day) AS INTEGER) AS year, coalesce(sum(aet), 0) AS sa, coalesce(sum(pet), 0) AS sp
                    FROM balance GROUP BY ALL)) WHERE w IS NOT NULL GROUP BY year""",
        bind.BALANCE_SQL,
    ),
)
def annual_ratio_bands(spark, d):
    per_cell = wrsi.annual(bind.balance(spark, d), ["cell"], "day")
    out = wrsi.band_summary(per_cell, ["year"])
    names = ["mean_of_ratios", "ratio_of_means", "pct_failed", "pct_stressed", "pct_good"]
    return out.withColumns({c: F.round(c, 6) for c in names})


_MONTHLY = """
monthly AS (SELECT zone_id, date_trunc('month', day) AS month,
                   CAST(year(day) * 12 + month(day) - 1 AS INTEGER) AS m, sum(value) AS value
            FROM series GROUP BY ALL)
"""


def _monthly(spark, d):
    return (
        bind.series(spark, d)
        .groupBy("zone_id", F.trunc("day", "month").alias("month"))
        .agg(F.sum("value").alias("value"))
        .withColumn("m", temporal.month_index(F.col("month")))
    )


@query(
    "rolling_accum",
    bind.with_sql(
        """SELECT zone_id, m, CASE WHEN count(value) OVER w = 3 THEN round(sum(value) OVER w, 2) END AS acc
        FROM monthly WINDOW w AS (PARTITION BY zone_id ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        bind.SERIES_SQL,
        _MONTHLY,
    ),
)
def rolling_accum(spark, d):
    out = temporal.rolling_months(_monthly(spark, d), ["zone_id"], "m", "value", 3)
    return out.select("zone_id", "m", F.round("acc", 2).alias("acc"))


_CODES = """
axis AS (SELECT DISTINCT month FROM monthly),
lettered AS (SELECT month, substr('JFMAMJJASOND', CAST(month(month) AS INTEGER), 1) AS l FROM axis),
shifted AS (SELECT month, l, lag(l, 2) OVER y AS a, lag(l, 1) OVER y AS b,
              lead(l, 1) OVER (ORDER BY month) || lead(l, 2) OVER (ORDER BY month) AS nxt
            FROM lettered WINDOW y AS (PARTITION BY year(month) ORDER BY month)),
codes AS (SELECT month, CASE WHEN a IS NOT NULL THEN a || b || l WHEN month(month) = 1 THEN 'NDJ'
             WHEN month(month) = 2 THEN 'DJF' WHEN month(month) = 12 THEN coalesce('D' || nxt, 'DJF') END AS season
          FROM shifted)
"""


def _cent_mean(value):
    """Mean of amounts with two decimals, summed as whole cents so that the order of adding cannot matter."""
    cents = F.sum(F.round(F.col(value) * 100).cast("bigint"))
    return cents.cast("double") / (F.lit(100.0) * F.count(value))


@query(
    "season_code",
    bind.with_sql(
        """SELECT strftime(month, '%Y-%m') AS month, season, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100::DOUBLE * count(*)) AS mean_value, count(*) AS n
        FROM monthly JOIN codes USING (month) GROUP BY month, season""",
        bind.SERIES_SQL,
        _MONTHLY,
        _CODES,
    ),
)
def season_code(spark, d):
    monthly = _monthly(spark, d)
    coded = monthly.join(temporal.season_codes(monthly, "month"), "month")
    return (
        coded.groupBy("month", "season")
        .agg(_cent_mean("value").alias("mean_value"), F.count("*").alias("n"))
        .withColumn("month", F.date_format("month", "yyyy-MM"))
    )


@query(
    "seasonal_mean",
    bind.with_sql(
        """SELECT zone_id, season, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100::DOUBLE * count(*)) AS mean_value
        FROM monthly JOIN codes USING (month) GROUP BY zone_id, season""",
        bind.SERIES_SQL,
        _MONTHLY,
        _CODES,
    ),
)
def seasonal_mean(spark, d):
    monthly = _monthly(spark, d)
    coded = monthly.join(temporal.season_codes(monthly, "month"), "month")
    return coded.groupBy("zone_id", "season").agg(_cent_mean("value").alias("mean_value"))


_RP = {t: NormalDist().inv_cdf(1 / t) for t in (3, 5, 10)}
_RP_VALUES = ", ".join(f"({t}, {v!r}::DOUBLE)" for t, v in _RP.items())


@query(
    "return_period_share",
    bind.with_sql(
        f""", z AS (SELECT zone_id, month, CASE WHEN value > 0 THEN (ln(value) - 13) * 1.5 END AS v FROM monthly)
        SELECT season, rp, zone_id, round(avg(CASE WHEN v <= thr THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct
        FROM z JOIN codes USING (month), (VALUES {_RP_VALUES}) t(rp, thr)
        WHERE season IN ('MAM', 'JJA', 'SON', 'DJF') GROUP BY season, rp, zone_id""",
        bind.SERIES_SQL,
        _MONTHLY,
        _CODES,
    ),
)
def return_period_share(spark, d):
    from pluvion.functions.statistics import return_period_thresholds

    monthly = _monthly(spark, d).withColumn("v", (F.log("value") - 13) * 1.5)
    coded = monthly.join(temporal.season_codes(monthly, "month"), "month").where(
        F.col("season").isin("MAM", "JJA", "SON", "DJF")
    )
    rps = return_period_thresholds([3, 5, 10])
    long = coded.select("zone_id", "season", "v", F.inline(rps).alias("rp", "threshold"))
    below = F.coalesce(F.col("v") <= F.col("threshold"), F.lit(False)).cast("double")
    return long.groupBy("season", "rp", "zone_id").agg(F.round(F.avg(below) * 100, 6).alias("pct"))


@query(
    "trend_slope",
    bind.with_sql(
        """, w AS (SELECT zone_id, m - (SELECT max(m) FROM monthly) + 5 AS x, value / 1e6 AS y FROM monthly
                   WHERE m > (SELECT max(m) FROM monthly) - 6)
        SELECT zone_id, CASE WHEN count(y) = 6 THEN round(regr_slope(y, x), 9) END AS slope FROM w GROUP BY zone_id""",
        bind.SERIES_SQL,
        _MONTHLY,
    ),
)
def trend_slope(spark, d):
    monthly = _monthly(spark, d)
    last = monthly.agg(F.max("m").alias("m")).scalar()
    window = monthly.where(F.col("m") > last - 6).select(
        "zone_id", (F.col("m") - last + 5).alias("x"), (F.col("value") / 1e6).alias("y")
    )
    out = temporal.trend_slope(window, ["zone_id"], "x", "y", 6)
    return out.withColumn("slope", F.round("slope", 9))


_ONSET = """
edge AS (SELECT min(day) AS d0, max(day) AS d1 FROM series),
bins AS (SELECT z.zone_id, d0 + CAST(10 * k AS INTEGER) AS bin, coalesce(sum(n), 0) AS n
         FROM edge, generate_series(0, (d1 - d0) // 10) t(k), (SELECT DISTINCT zone_id FROM series) z
         LEFT JOIN series s ON s.zone_id = z.zone_id AND (s.day - d0) // 10 = k GROUP BY z.zone_id, d0, k),
onset AS (SELECT zone_id, min(bin) FILTER (bin >= DATE '1996-03-01' AND bin <= DATE '1996-12-31' AND n >= 3 AND f >= 4) AS onset
          FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY zone_id ORDER BY bin
                   ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS f FROM bins) GROUP BY zone_id)
"""


def _onset(spark, d):
    counts = bind.series(spark, d).withColumn("n", F.col("n").cast("double"))
    bins = temporal.resample_days(counts, ["zone_id"], "day", ["n"])
    return temporal.first_onset(
        bins, ["zone_id"], "bin", "n", F.lit("1996-03-01").cast("date"), F.lit("1996-12-31").cast("date"), 3.0, 4.0
    )


@query(
    "onset_detect",
    bind.with_sql(
        "SELECT zone_id, strftime(onset, '%Y-%m-%d') AS onset FROM onset", bind.SERIES_SQL, _ONSET
    ),
)
def onset_detect(spark, d):
    return _onset(spark, d).select("zone_id", bind.day("onset").alias("onset"))


@query(
    "growing_degree_sum",
    bind.with_sql(
        """SELECT s.zone_id, round(coalesce(sum(greatest(value / 10000 - 10, 0)), 0), 4) AS gdd
        FROM series s JOIN onset o ON s.zone_id = o.zone_id AND s.day >= o.onset
        WHERE s.day <= DATE '1997-03-31' GROUP BY s.zone_id""",
        bind.SERIES_SQL,
        _ONSET,
    ),
)
def growing_degree_sum(spark, d):
    temps = bind.series(spark, d).withColumn("temp", F.col("value") / 10000)
    out = temporal.growing_degrees(
        temps, _onset(spark, d), ["zone_id"], "day", "temp", F.lit("1997-03-31").cast("date")
    )
    return out.select("zone_id", F.round("gdd", 4).alias("gdd"))


_D = "strftime(day, '%Y-%m-%d') AS day"


@query(
    "carry_forward",
    bind.with_sql(
        f"""SELECT zone_id, {_D}, round(value, 2) AS value FROM series UNION ALL
        SELECT zone_id, strftime(m + CAST(i AS INTEGER), '%Y-%m-%d'), round(v, 2)
        FROM (SELECT zone_id, max(day) AS m, arg_max(value, day) AS v FROM series GROUP BY zone_id), generate_series(1, 16) t(i)""",
        bind.SERIES_SQL,
    ),
)
def carry_forward(spark, d):
    out = temporal.carry_last(bind.series(spark, d), ["zone_id"], "day", ["value"], 16)
    return out.select("zone_id", bind.day("day").alias("day"), F.round("value", 2).alias("value"))


@query(
    "latest_fill",
    bind.with_sql(
        f""", pet AS (SELECT * FROM series WHERE n = 1), rain AS (SELECT DISTINCT zone_id, day FROM series WHERE n <> 1)
        SELECT zone_id, {_D}, round(value, 2) AS value FROM pet UNION ALL
        SELECT r.zone_id, strftime(r.day, '%Y-%m-%d'), round(l.v, 2) FROM rain r
        JOIN (SELECT zone_id, arg_max(value, day) AS v FROM pet GROUP BY zone_id) l USING (zone_id)
        WHERE NOT EXISTS (SELECT 1 FROM pet p WHERE p.zone_id = r.zone_id AND p.day = r.day)""",
        bind.SERIES_SQL,
    ),
)
def latest_fill(spark, d):
    s = bind.series(spark, d)
    out = temporal.fill_from_latest(s.where("n <> 1"), s.where("n = 1"), ["zone_id"], "day", "value")
    return out.select("zone_id", bind.day("day").alias("day"), F.round("value", 2).alias("value"))


@query(
    "cyclic_extend",
    bind.with_sql(
        f""", r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY day DESC) AS rk,
                     max(day) OVER (PARTITION BY zone_id) AS m, least(count(*) OVER (PARTITION BY zone_id), 15) AS k FROM series)
        SELECT zone_id, {_D}, round(value, 2) AS value FROM series UNION ALL
        SELECT zone_id, strftime(m + CAST(i + 1 AS INTEGER), '%Y-%m-%d'), round(value, 2)
        FROM r, generate_series(0, 15) t(i) WHERE rk <= 15 AND i % k = k - rk""",
        bind.SERIES_SQL,
    ),
)
def cyclic_extend(spark, d):
    out = temporal.repeat_pattern(bind.series(spark, d), ["zone_id"], "day", ["value"], 15, 16)
    return out.select("zone_id", bind.day("day").alias("day"), F.round("value", 2).alias("value"))


_SPLIT = """
hist AS (SELECT o_custkey % 25 AS zone_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value
         FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
fresh AS (SELECT o_custkey % 25 AS zone_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value
          FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
"""


def _split(spark, d):
    o = bind.table(spark, d, "orders").withColumn("zone_id", F.col("o_custkey") % 25)

    def total(df):
        return df.groupBy("zone_id", F.to_date("o_orderdate").alias("day")).agg(
            F.sum("o_totalprice").alias("value")
        )

    old = F.col("o_orderstatus") == "F"
    return total(o.where(old)), total(o.where(~old))


def _as_series(df):
    return df.select("zone_id", bind.day("day").alias("day"), F.round("value", 2).alias("value"))


@query(
    "cutoff_merge",
    bind.with_sql(
        f"""SELECT zone_id, {_D}, round(value, 2) AS value FROM hist h
        WHERE day < coalesce((SELECT min(day) FROM fresh f WHERE f.zone_id = h.zone_id), DATE '9999-01-01')
        UNION ALL SELECT zone_id, {_D}, round(value, 2) FROM fresh""",
        _SPLIT,
    ),
)
def cutoff_merge(spark, d):
    return _as_series(temporal.cutoff_merge(*_split(spark, d), ["zone_id"], "day"))


@query(
    "append_after_last",
    bind.with_sql(
        f""", h AS (SELECT * FROM hist)
        SELECT zone_id, {_D}, round(value, 2) AS value FROM h
        UNION ALL SELECT zone_id, {_D}, round(value, 2) FROM fresh f
        WHERE day > coalesce((SELECT max(day) FROM h WHERE f.zone_id = h.zone_id), DATE '0001-01-01')""",
        _SPLIT,
    ),
)
def append_after_last(spark, d):
    hist, fresh = _split(spark, d)
    return _as_series(temporal.append_after_last(hist, fresh, ["zone_id"], "day"))


@query(
    "replace_range",
    bind.with_sql(
        f"""SELECT zone_id, {_D}, round(value, 2) AS value FROM hist
        WHERE day < DATE '1997-01-01' OR day > DATE '1997-06-30'
        UNION ALL SELECT zone_id, {_D}, round(value, 2) FROM fresh
        WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""",
        _SPLIT,
    ),
)
def replace_range(spark, d):
    hist, fresh = _split(spark, d)
    a, b = F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date")
    return _as_series(temporal.replace_range(hist, fresh.where(F.col("day").between(a, b)), "day", a, b))


@query(
    "gap_report",
    bind.with_sql(
        """SELECT zone_id, CAST(max(day) - min(day) + 1 AS BIGINT) AS expected_days, count(*) AS present_days,
             CAST(max(day) - min(day) + 1 - count(*) AS BIGINT) AS missing_days FROM series GROUP BY zone_id""",
        bind.SERIES_SQL,
    ),
)
def gap_report(spark, d):
    return temporal.gap_summary(bind.series(spark, d), ["zone_id"], "day")


@query(
    "missing_days",
    bind.with_sql(
        """SELECT a.zone_id, strftime(x, '%Y-%m-%d') AS day
        FROM (SELECT zone_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS x FROM series GROUP BY zone_id) a
        LEFT JOIN series s ON s.zone_id = a.zone_id AND s.day = CAST(x AS DATE) WHERE s.day IS NULL""",
        bind.SERIES_SQL,
    ),
)
def missing_days(spark, d):
    out = temporal.missing_days(bind.series(spark, d), ["zone_id"], "day")
    return out.select("zone_id", bind.day("day").alias("day"))


@query(
    "gap_interpolation",
    bind.with_sql(
        """, a AS (SELECT zone_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM series GROUP BY zone_id),
        j AS (SELECT a.zone_id, a.day, s.value, CASE WHEN s.value IS NOT NULL THEN a.day END AS seen
              FROM a LEFT JOIN series s ON s.zone_id = a.zone_id AND s.day = a.day),
        n AS (SELECT *, last_value(seen IGNORE NULLS) OVER b AS d0, last_value(value IGNORE NULLS) OVER b AS v0,
                first_value(seen IGNORE NULLS) OVER f AS d1, first_value(value IGNORE NULLS) OVER f AS v1 FROM j
              WINDOW b AS (PARTITION BY zone_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     f AS (PARTITION BY zone_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT zone_id, strftime(day, '%Y-%m-%d') AS day,
           round(CASE WHEN value IS NOT NULL THEN value ELSE v0 + (v1 - v0) * ((day - d0) / (d1 - d0)) END, 6) AS value FROM n""",
        bind.SERIES_SQL,
    ),
)
def gap_interpolation(spark, d):
    out = temporal.interpolate_days(bind.series(spark, d), ["zone_id"], "day", "value")
    return out.select("zone_id", bind.day("day").alias("day"), F.round("value", 6).alias("value"))


@query(
    "time_interp",
    bind.with_sql(
        """, s AS (SELECT zone_id, CAST(day - DATE '1992-01-01' AS BIGINT) AS step, value FROM series),
        t AS (SELECT z.zone_id, k * 7 AS step FROM (SELECT DISTINCT zone_id FROM s) z, generate_series(-10, 400) g(k)),
        p AS (SELECT t.zone_id, t.step, max(s.step) AS s0, arg_max(s.value, s.step) AS v0 FROM t
              LEFT JOIN s ON s.zone_id = t.zone_id AND s.step <= t.step GROUP BY ALL),
        q AS (SELECT t.zone_id, t.step, min(s.step) AS s1, arg_min(s.value, s.step) AS v1 FROM t
              LEFT JOIN s ON s.zone_id = t.zone_id AND s.step >= t.step GROUP BY ALL)
        SELECT zone_id, step, round(CASE WHEN s0 = s1 THEN v0 WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
           ELSE v0 + (v1 - v0) * ((step - s0) / (s1 - s0)) END, 6) AS value FROM p JOIN q USING (zone_id, step)""",
        bind.SERIES_SQL,
    ),
)
def time_interp(spark, d):
    s = bind.series(spark, d).select(
        "zone_id", F.datediff("day", F.lit("1992-01-01").cast("date")).cast("bigint").alias("step"), "value"
    )
    targets = s.select("zone_id").distinct().select(
        "zone_id", F.explode(F.expr("sequence(-70L, 2800L, 7L)")).alias("step")
    )
    out = temporal.interpolate_onto(s, targets, ["zone_id"], "step", "value")
    return out.withColumn("value", F.round("value", 6))


@query(
    "minmax_norm",
    bind.with_sql(
        f"""SELECT zone_id, {_D}, round(CASE WHEN v IS NULL THEN 0.7 ELSE least(greatest((v - lo) / (hi - lo + 1e-10), 0), 1) END, 9) AS blocking
        FROM (SELECT zone_id, day, CASE WHEN n < 3 THEN value END AS v FROM series),
             (SELECT min(value) AS lo, max(value) AS hi FROM series WHERE n < 3)""",
        bind.SERIES_SQL,
    ),
)
def minmax_norm(spark, d):
    s = bind.series(spark, d).withColumn("value", F.when(F.col("n") < 3, F.col("value")))
    out = temporal.minmax_normalise(s, "value", "blocking")
    return out.select("zone_id", bind.day("day").alias("day"), F.round("blocking", 9).alias("blocking"))


@query(
    "daily_share",
    bind.with_sql(
        f""", v AS (SELECT zone_id, day, CASE WHEN zone_id = 3 THEN 0.0 ELSE value END AS value FROM series)
        SELECT zone_id, {_D}, round(coalesce(value / nullif(sum(value) OVER w, 0), 1.0 / count(*) OVER w), 9) AS share
        FROM v WINDOW w AS (PARTITION BY zone_id)""",
        bind.SERIES_SQL,
    ),
)
def daily_share(spark, d):
    s = bind.series(spark, d).withColumn("value", F.when(F.col("zone_id") == 3, 0.0).otherwise(F.col("value")))
    out = temporal.share_of_total(s, ["zone_id"], "day", "value")
    return out.select("zone_id", bind.day("day").alias("day"), F.round("share", 9).alias("share"))


@query(
    "running_total",
    bind.with_sql(
        f"""SELECT zone_id, {_D}, round(sum(value * 0.5) OVER (PARTITION BY zone_id ORDER BY day), 3) AS total FROM series""",
        bind.SERIES_SQL,
    ),
)
def running_total(spark, d):
    out = temporal.running_total(bind.series(spark, d), ["zone_id"], "day", F.col("value") * 0.5, "total")
    return out.select("zone_id", bind.day("day").alias("day"), F.round("total", 3).alias("total"))


# ---------------------------------------------------------------- alignment in time

@query(
    "asof_latest",
    """SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders
       WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '1997-05-15 12:00:00')""",
)
def asof_latest(spark, d):
    out = align.latest_on_or_before(
        bind.table(spark, d, "orders"), "o_orderdate", F.lit("1997-05-15 12:00:00").cast("timestamp_ntz")
    )
    return out.select("o_orderkey", "o_custkey", bind.day("o_orderdate").alias("day"), "o_totalprice")


@query(
    "asof_prev_month",
    bind.with_sql(
        """, s AS (SELECT zone_id, day, value FROM series WHERE zone_id <> 7 OR day > (SELECT max(day) - 20 FROM series)),
        l AS (SELECT zone_id, max(day) AS t, arg_max(value, day) AS v FROM s GROUP BY zone_id),
        p AS (SELECT s.zone_id, max(s.day) AS pt, arg_max(s.value, s.day) AS pv FROM s JOIN l USING (zone_id)
              WHERE s.day <= CAST(l.t - INTERVAL 1 MONTH AS DATE) GROUP BY s.zone_id)
        SELECT zone_id, strftime(t, '%Y-%m-%d') AS latest_time, round(v, 2) AS latest,
          strftime(coalesce(pt, t), '%Y-%m-%d') AS previous_time, round(CASE WHEN pt IS NOT NULL THEN pv ELSE v END, 2) AS previous
        FROM l LEFT JOIN p USING (zone_id)""",
        bind.SERIES_SQL,
    ),
)
def asof_prev_month(spark, d):
    s = bind.series(spark, d)
    last = s.agg(F.max("day").alias("v")).scalar()
    s = s.where((F.col("zone_id") != 7) | (F.col("day") > F.date_sub(last, 20)))
    out = align.with_previous_month(s, ["zone_id"], "day", "value")
    return out.select(
        "zone_id",
        bind.day("latest_time").alias("latest_time"),
        F.round("latest", 2).alias("latest"),
        bind.day("previous_time").alias("previous_time"),
        F.round("previous", 2).alias("previous"),
    )


@query(
    "asof_bounded",
    bind.with_sql(
        """, w AS (SELECT DISTINCT o_custkey % 25 AS zone_id, CAST(o_orderdate AS DATE) + 3 AS day FROM orders),
        h AS (SELECT w.zone_id, w.day, max(s.day) AS sd, arg_max(s.value, s.day) AS v FROM w
              JOIN series s ON s.zone_id = w.zone_id AND s.day BETWEEN w.day - 7 AND w.day GROUP BY w.zone_id, w.day)
        SELECT zone_id, strftime(w.day, '%Y-%m-%d') AS day, strftime(sd, '%Y-%m-%d') AS source_day, round(v, 2) AS value
        FROM w LEFT JOIN h USING (zone_id, day)""",
        bind.SERIES_SQL,
    ),
)
def asof_bounded(spark, d):
    wanted = (
        bind.table(spark, d, "orders")
        .select((F.col("o_custkey") % 25).alias("zone_id"), F.date_add(F.to_date("o_orderdate"), 3).alias("day"))
        .distinct()
    )
    out = align.bounded_asof(wanted, bind.series(spark, d), ["zone_id"], "day", "value", 7)
    return out.select(
        "zone_id",
        bind.day("day").alias("day"),
        bind.day("source_day").alias("source_day"),
        F.round("value", 2).alias("value"),
    )


@query(
    "outer_sum_join",
    bind.with_sql(
        """SELECT coalesce(h.zone_id, f.zone_id) AS zone_id, strftime(coalesce(h.day, f.day), '%Y-%m-%d') AS day,
             round(coalesce(h.value, 0) + coalesce(f.value, 0), 2) AS value
        FROM hist h FULL JOIN fresh f ON h.zone_id = f.zone_id AND h.day = f.day""",
        _SPLIT,
    ),
)
def outer_sum_join(spark, d):
    hist, fresh = _split(spark, d)
    return _as_series(align.outer_sum(hist, fresh, ["zone_id", "day"], "value", "value"))


@query(
    "unified_axis",
    bind.with_sql(
        """, ax AS (SELECT day FROM hist UNION SELECT day FROM fresh)
        SELECT strftime(ax.day, '%Y-%m-%d') AS day, round(h.value, 2) AS daily_value
        FROM ax LEFT JOIN (SELECT day, sum(value) AS value FROM hist GROUP BY day) h USING (day)""",
        _SPLIT,
    ),
)
def unified_axis(spark, d):
    hist, fresh = _split(spark, d)
    axis = align.unified_axis(hist.select("day"), fresh.select("day"))
    sparse = hist.groupBy("day").agg(F.sum("value").alias("daily_value"))
    out = align.onto_axis(axis, sparse, ["day"])
    return out.select(bind.day("day").alias("day"), F.round("daily_value", 2).alias("daily_value"))


@query(
    "overlap_window",
    bind.with_sql(
        """, b AS (SELECT source, min(day) AS a, max(day) AS z FROM s GROUP BY source)
        SELECT source, count(*) AS n, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day
        FROM s WHERE day >= (SELECT max(a) FROM b) AND day <= (SELECT min(z) FROM b) GROUP BY source""",
        _SPLIT,
        "s AS (SELECT 'hist' AS source, day FROM hist UNION ALL SELECT 'fresh', day FROM fresh)",
    ),
)
def overlap_window(spark, d):
    hist, fresh = _split(spark, d)
    both = hist.select(F.lit("hist").alias("source"), "day").unionByName(
        fresh.select(F.lit("fresh").alias("source"), "day")
    )
    out = align.overlap_window(both, "source", "day")
    return out.groupBy("source").agg(
        F.count("*").alias("n"),
        bind.day(F.min("day")).alias("first_day"),
        bind.day(F.max("day")).alias("last_day"),
    )
