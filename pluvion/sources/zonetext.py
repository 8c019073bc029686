"""Wide zone text files: parsing to long rows and writing lines in header order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvion.functions.dates import julian_to_gtime, mixed_date_to_gtime
from pluvion.functions.formats import zone_value_text

# Variable code of each zone file.
ZONE_FILE_CODES = {"rain.txt": 1, "evap.txt": 2}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, value)``; ``pos`` grows with the line order inside a file.

    A large file may be split, so the position is the offset of the split and
    then the row number Spark hands out inside it.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("pos"),
        "value",
    )


def _with_header(lines: DataFrame) -> DataFrame:
    """Every later line beside the first line of its file."""
    header = lines.groupBy("file").agg(F.min("pos").alias("_first"), F.min_by("value", "pos").alias("_header"))
    return lines.join(header, "file").where(F.col("pos") > F.col("_first"))


def _zone_days(lines: DataFrame) -> DataFrame:
    """``(file, julian, _ids, _parts)``: one row a day with the zone ids of its file and the texts of their values.

    The lines are read once: they are put together by file and first word,
    which leaves one row a day, and the first of a file's rows gives its ids to
    the others. The header is taken apart once a file.
    """
    text = F.trim("value")
    fits = F.contains(text, F.lit(","))
    days = lines.groupBy("file", F.trim(F.substring_index(text, ",", 1)).alias("julian")).agg(
        F.min("pos").alias("_from"), F.min_by(text, "pos").alias("_head"),
        F.max(F.when(fits, F.col("pos"))).alias("_to"), F.max_by(F.when(fits, text), F.when(fits, F.col("pos"))).alias("_line"),
    )
    file = Window.partitionBy("file")
    ids = F.transform(
        F.filter(F.split(F.expr("substring(_head, 4)"), ","), lambda x: F.trim(x).rlike("^[0-9]+$")), lambda x: F.trim(x).cast("int")
    )
    heads = (F.col("_from") == F.col("_start")) & F.startswith(F.col("_head"), F.lit("NA,"))
    return (
        days.withColumn("_start", F.min("_from").over(file))
        .withColumn("_ids", F.first(F.when(heads, ids), ignorenulls=True).over(file))
        .where(F.col("_ids").isNotNull() & (F.col("_to") > F.col("_start")) & (F.col("_line") != ""))
        .select("file", "julian", "_ids", F.slice(F.split("_line", ","), F.lit(2), F.size("_ids")).alias("_parts"))
    )


def _zone_cells(days: DataFrame) -> DataFrame:
    """One row per zone id of the rows of :func:`_zone_days`; a cell carries the day's other columns, not its arrays."""
    rest = [c for c in days.columns if c not in ("_ids", "_parts")]
    cells = days.select(*rest, F.inline(F.arrays_zip("_ids", "_parts")).alias("zone_id", "_text"))
    number = F.nanvl(F.trim("_text").try_cast("double"), F.lit(0.0))
    return cells.select(*rest, "zone_id", F.coalesce(number, F.lit(0.0)).alias("value"))


def parse_zone_lines(lines: DataFrame) -> DataFrame:
    """``(file, julian, zone_id, value)`` of ``NA,id,id..`` files.

    Rows are padded with 0 or cut to the header; empty, ``NA`` and unreadable
    values are 0. A repeated day keeps its last line.
    """
    return _zone_cells(_zone_days(lines))


def zone_lines_to_lean(lines: DataFrame, processed_at: str, source_day: str, variable: Column | None = None) -> DataFrame:
    """Zone files of any number of folders as hindcast rows of the lean table."""
    name = F.element_at(F.split("file", "/"), -1)
    code = variable if variable is not None else F.element_at(
        F.create_map(*[F.lit(x) for kv in ZONE_FILE_CODES.items() for x in kv]), name
    )
    days = _zone_days(lines).withColumns({"gtime": julian_to_gtime(F.col("julian")), "variable": code})
    known = days.where(F.col("gtime").isNotNull() & F.col("variable").isNotNull())
    return _zone_cells(known).select(
        "gtime",
        "zone_id",
        F.lit(1).alias("zone_nu"),
        "variable",
        F.col("value").alias("mean_value"),
        F.lit(processed_at).alias("processed_at"),
        F.lit(f"hc_{source_day}").alias("source_date"),
    )


def parse_model_lines(lines: DataFrame) -> DataFrame:
    """``(file, gtime, zone_id, value)`` of model output text.

    Rows shorter than the header and values that are no numbers are skipped;
    zeros stay.
    """
    rows = (
        _with_header(lines)
        .where(F.trim("value") != "")
        .withColumn("_ids", F.transform(F.split(F.trim("_header"), ","), lambda x: F.trim(x)))
        .withColumn("_parts", F.split(F.trim("value"), ","))
        .where(F.size("_parts") >= F.size("_ids"))
    )
    return (
        rows.select(
            "file",
            mixed_date_to_gtime(F.col("_parts")[0]).alias("gtime"),
            "_parts",
            F.posexplode(F.slice("_ids", F.lit(2), F.size("_ids"))).alias("_i", "zone_id"),
        )
        .select(
            "file",
            "gtime",
            "zone_id",
            F.nanvl(F.trim(F.get(F.col("_parts"), F.col("_i") + 1)).try_cast("double"), F.lit(None)).alias("value"),
        )
        .where(F.col("value").isNotNull())
    )


def header_positions(zone_header: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(zone, zone_id, pos)``: header order of the zone ids; codes without a shape are left out."""
    return zone_header.join(
        shapes.select("zone", F.col("GRIDCODE").alias("gridcode"), F.col("id").alias("zone_id")), ["zone", "gridcode"]
    ).select("zone", "zone_id", "pos")


def positions_by_code(shapes: DataFrame) -> DataFrame:
    """The other header order: zone ids by ascending code."""
    from pyspark.sql import Window as W

    order = W.partitionBy("zone").orderBy("GRIDCODE")
    return shapes.select(
        "zone", F.col("id").alias("zone_id"), (F.row_number().over(order) - 1).alias("pos")
    )


def day_line(day: Column, cells: Column, size: Column, text: Callable[[Column], Column] = lambda x: zone_value_text(x["value"])) -> Column:
    """Text line of a day from its ``(pos, value)`` cells in order of their positions; positions without a value read 0."""
    before = lambda i: F.coalesce(F.get(cells, i - 1)["pos"], F.lit(-1))
    pieces = F.transform(cells, lambda x, i: F.concat(F.repeat(F.lit("0,"), x["pos"] - before(i) - 1), text(x)))
    rest = F.repeat(F.lit(",0"), size - 1 - F.element_at(cells, -1)["pos"])
    return F.concat(day, F.lit(","), F.array_join(pieces, ","), rest)


def zone_lines(values: DataFrame, zone_size: DataFrame, day: str = "julian") -> DataFrame:
    """``(zone, day, line)``: one text line per zone and day in header order.

    ``values`` has zone, day, pos, value; positions without a value read 0. A
    line is as long as the zone's header, whatever the number of days.
    """
    texts = values.select("zone", day, "pos", "value", zone_value_text(F.col("value")).alias("text"))
    cells = texts.groupBy("zone", day).agg(F.array_sort(F.collect_list(F.struct("pos", "value", "text"))).alias("_v"))
    line = day_line(F.col(day), F.col("_v"), F.col("size"), lambda x: x["text"])
    return cells.join(zone_size, "zone").select("zone", day, line.alias("line"))


def header_lines(zone_header: DataFrame) -> DataFrame:
    """``(zone, line)``: the first line of each zone file."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "gridcode"))), lambda x: x["gridcode"].cast("string")
    )
    return zone_header.groupBy("zone").agg(F.concat_ws(",", F.lit("NA"), F.concat_ws(",", ordered)).alias("line"))


def write_zone_files(header: DataFrame, lines: DataFrame, path: str, day: str = "julian") -> None:
    """One folder per zone; header first, then the days ascending."""
    rows = header.select("zone", F.lit("").alias(day), "line").unionByName(lines.select("zone", day, "line"))
    (
        rows.repartition("zone")
        .sortWithinPartitions("zone", day)
        .select("zone", "line")
        .write.mode("overwrite")
        .partitionBy("zone")
        .text(path)
    )
