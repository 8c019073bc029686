"""Time strings, mixed dates, dates in file names, seasons and leads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Last month of each three-month season.
SEASON_ANCHOR = {"MAM": 5, "JJA": 8, "OND": 11, "DJF": 2}


def gtime_to_julian(gtime: Column) -> Column:
    """``yyyyMMddTHH`` to ``yyyyDDD``."""
    return F.date_format(F.try_to_timestamp(gtime, F.lit("yyyyMMdd'T'HH")), "yyyyDDD")


def julian_to_gtime(julian: Column) -> Column:
    """``yyyyDDD`` to ``yyyyMMddT00``; a day past the year end rolls over."""
    year = F.substring(julian, 1, 4).try_cast("int")
    number = julian.substr(F.lit(5), F.length(julian))
    start = F.make_date(year, F.lit(1), F.lit(1))
    return F.concat(F.date_format(F.date_add(start, number.try_cast("int") - 1), "yyyyMMdd"), F.lit("T00"))


def mixed_date_to_gtime(text: Column) -> Column:
    """ISO, eight digits or month/day/year; anything else keeps its text plus ``T00``."""
    t = F.trim(text)
    iso = F.split(t, "-")
    slash = F.split(t, "/")
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    dashes = F.size(iso) == 3
    slashes = F.size(slash) == 3
    return (
        F.when((F.length(t) == 10) & dashes, F.concat(iso[0], two(iso[1]), two(iso[2]), F.lit("T00")))
        .when(t.rlike("^[0-9]{8}$"), F.concat(t, F.lit("T00")))
        .when(
            slashes & (F.length(F.get(slash, F.lit(2))) == 4),
            F.concat(F.get(slash, F.lit(2)), two(slash[0]), two(F.get(slash, F.lit(1))), F.lit("T00")),
        )
        .otherwise(F.concat(t, F.lit("T00")))
    )


def filename_date(name: Column) -> Column:
    """Date in a file name by the first grammar that yields a real date, else NULL.

    Grammars in order: ``etYYMMDD``, ``3IMERG.YYYYMMDD``, ``x.YYYY.MMDD`` and
    eight digits between separators.
    """
    def valid(text):
        return F.to_date(F.try_to_timestamp(F.when(text != "", text), F.lit("yyyyMMdd")))

    first_et = F.regexp_extract(name, r"^(?:(?!et).)*et([0-9]{6})", 1)
    imerg = F.regexp_extract(name, r"3IMERG\.([0-9]{8})", 1)
    dotted = F.concat(
        F.regexp_extract(name, r"^[^.]*\.([0-9]{4})\.([0-9]{4})(?:\.|$)", 1),
        F.regexp_extract(name, r"^[^.]*\.([0-9]{4})\.([0-9]{4})(?:\.|$)", 2),
    )
    digits = F.coalesce(
        *[F.when(part != "", part) for part in (
            F.regexp_extract(name, r"(?:^|_)([0-9]{8})(?:_|$)", 1),
            F.regexp_extract(name, r"(?:^|\.)([0-9]{8})(?:\.|$)", 1),
            F.regexp_extract(name, r"(?:^|-)([0-9]{8})(?:-|$)", 1),
        )]
    )
    return F.coalesce(
        valid(F.when(first_et != "", F.concat(F.lit("20"), first_et))), valid(imerg), valid(dotted), valid(digits)
    )


def season_lead(init_month: Column, season: Column) -> Column:
    """Lead 1..6 from the start month to the season's last month; NULL when out of reach."""
    anchor = F.element_at(
        F.create_map(*[F.lit(x) for kv in SEASON_ANCHOR.items() for x in kv]), season
    )
    lead = F.pmod(anchor - init_month, F.lit(12))
    return F.when(lead.between(1, 6), lead.cast("int"))


def season_month(init: Column, season: Column) -> Column:
    """First day of the season's last month seen from the start month."""
    anchor = F.element_at(
        F.create_map(*[F.lit(x) for kv in SEASON_ANCHOR.items() for x in kv]), season
    )
    passed = F.when(season == "DJF", anchor <= F.month(init)).otherwise(anchor < F.month(init))
    return F.make_date(F.year(init) + F.when(passed, 1).otherwise(0), anchor, F.lit(1))


def valid_time(init: Column, step_hours: Column) -> Column:
    """Start time plus forecast step."""
    return init + F.make_dt_interval(F.lit(0), step_hours)
