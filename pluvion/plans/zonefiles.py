"""Zone files from the lean long table: rain and evaporation lines of all zones in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvion.functions.dates import gtime_to_julian
from pluvion.sources import zonetext


def daily_values(lean: DataFrame, places: DataFrame) -> DataFrame:
    """``(zone, pos, past, julian, rain, evap)``: the last written values of a zone id and day.

    All three variables and both halves of the table come from one aggregate.
    Rain is the sum of its two sources with 0 for a missing one.
    """
    rank = F.struct("gtime", "source_date", "processed_at")
    last = lambda code: F.max_by(
        F.when(F.col("variable") == code, F.col("mean_value")), F.when(F.col("variable") == code, rank)
    )
    marked = F.coalesce(F.startswith(F.col("source_date"), F.lit("hc_")), F.lit(False))
    days = (
        lean.where(F.col("variable").isin(1, 2, 3))
        .groupBy(marked.alias("past"), "zone_id", gtime_to_julian(F.col("gtime")).alias("julian"))
        .agg(last(1).alias("_a"), last(2).alias("evap"), last(3).alias("_b"))
    )
    both = F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))
    return days.join(places, "zone_id").select(
        "zone", "pos", "past", "julian",
        F.when(F.col("_a").isNotNull() | F.col("_b").isNotNull(), both).alias("rain"), "evap",
    )


def zone_days(days: DataFrame) -> DataFrame:
    """``(zone, past, julian, rain, evap)``: one row a day with the cells of both files in header order.

    A row is as long as the zone's header.
    """
    cells = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("value")))))
    return days.groupBy("zone", "past", "julian").agg(cells("rain").alias("rain"), cells("evap").alias("evap"))


def file_days(rows: DataFrame) -> DataFrame:
    """``(zone, file, julian, cells)``: past days before the first future day of the file, then its future days.

    Future days with rain and without evaporation take the cells of the latest
    future day that has them. All of it is decided in one window over a zone's
    days.
    """
    zone = Window.partitionBy("zone")
    ahead = ~F.col("past")
    rain, evap = F.size("rain") > 0, F.size("evap") > 0
    latest = F.max_by(F.when(ahead & evap, F.col("evap")), F.when(ahead & evap, F.col("julian"))).over(zone)
    filled = rows.withColumn("evap", F.when(ahead & rain & ~evap, F.coalesce(latest, F.col("evap"))).otherwise(F.col("evap")))
    cut = lambda held: F.min(F.when(ahead & held, F.col("julian"))).over(zone)
    marked = filled.withColumns({"_rain_from": cut(rain), "_evap_from": cut(F.size("evap") > 0)})
    files = F.array(
        F.struct(F.lit("rain.txt").alias("file"), F.col("rain").alias("cells"), F.col("_rain_from").alias("_from")),
        F.struct(F.lit("evap.txt").alias("file"), F.col("evap").alias("cells"), F.col("_evap_from").alias("_from")),
    )
    each = marked.select("zone", "past", "julian", F.inline(files)).where(F.size("cells") > 0)
    return each.where(ahead | F.col("_from").isNull() | (F.col("julian") < F.col("_from"))).select("zone", "file", "julian", "cells")


def zone_file_lines(lean: DataFrame, zone_header: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(zone, file, julian, line)`` of the rain and evaporation files with their header lines."""
    places = zonetext.header_positions(zone_header, shapes)
    size = zone_header.groupBy("zone").agg(F.count("*").cast("int").alias("size"))
    body = file_days(zone_days(daily_values(lean, places))).join(size, "zone")
    lines = body.select("zone", "file", "julian", zonetext.day_line(F.col("julian"), F.col("cells"), F.col("size")).alias("line"))
    names = F.explode(F.array(F.lit("rain.txt"), F.lit("evap.txt"))).alias("file")
    head = zonetext.header_lines(zone_header).select("zone", names, F.lit("").alias("julian"), "line")
    return head.unionByName(lines)
