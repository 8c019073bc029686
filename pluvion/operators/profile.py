"""Profiles, distributions and comparisons of tables, files and scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.operators.quantiles import exact_quantiles

# Limits of the file comparison.
MAJOR_LINES, MEAN_PERCENT, RANGE_ABSOLUTE = 100, 5.0, 0.1
# The 11 points of the percentile profile.
PROFILE_POINTS = (0.0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)
# Road classes and their display groups; stream orders from which a group starts.
ROAD_GROUPS = {
    "motorway": "motorway", "trunk": "motorway", "primary": "primary", "secondary": "secondary", "tertiary": "tertiary",
    "residential": "residential", "living_street": "residential", "unclassified": "residential", "service": "residential",
}


def value_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation, extremes, zeros, negatives and median per group."""
    v = F.col(value)
    base = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"),
    )
    middle = exact_quantiles(df, keys, value, [0.5], "median").drop("q")
    return base.join(middle, list(keys))


def text_profile(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """Shape of each text file and statistics of its numbers.

    ``lines`` has file, line_no (from 0) and value. Whole files count; a
    ``sample`` restricts the numbers to that many data lines at the start.
    """
    first = lines.groupBy("file").agg(
        F.min_by("value", "line_no").alias("_first"),
        F.count("*").alias("total_lines"),
        F.count_if(F.trim("value") != "").alias("non_empty_lines"),
        F.sum(F.length("value") + 1).alias("size"),
    )
    head = F.trim("_first")
    separator = F.when(head.contains(","), "comma").when(head.contains("\t"), "tab").otherwise("space")
    pattern = F.when(F.col("separator") == "comma", ",").when(F.col("separator") == "tab", "\t").otherwise(" +")
    shaped = first.withColumn("separator", separator).withColumn("_parts", F.split(head, pattern))
    shaped = shaped.select(
        "file", "total_lines", "non_empty_lines", "size", "separator", F.size("_parts").cast("bigint").alias("columns"),
        F.col("_parts")[0].try_cast("double").isNull().alias("has_header"),
    )
    start = F.when(F.col("has_header"), 1).otherwise(0)
    wanted = F.col("line_no") >= start
    if sample is not None:
        wanted = wanted & (F.col("line_no") < start + sample)
    body = (
        lines.join(shaped, "file")
        .where(wanted & (F.trim("value") != ""))
        .select("file", F.split(F.trim("value"), pattern).alias("_p"))
        .select("file", F.explode(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0)))).alias("_t"))
        .select("file", F.trim("_t").try_cast("double").alias("v"))
    )
    return shaped.join(value_summary(body, ["file"], "v"), "file", "left")


def whole_text_profile(docs: DataFrame) -> DataFrame:
    """:func:`text_profile` of whole texts in one row each, ``docs(file, text)``, with the digest of the text.

    Everything comes from expressions on the row, so a text is read once and
    nothing is shuffled.
    """
    lines = F.split("text", "\n")
    head = F.trim(lines[0])
    separator = F.when(head.contains(","), "comma").when(head.contains("\t"), "tab").otherwise("space")
    pattern = F.when(F.col("separator") == "comma", ",").when(F.col("separator") == "tab", "\t").otherwise(" +")
    first = docs.select("file", F.md5("text").alias("digest"), F.length("text").alias("_n"), lines.alias("_lines"), head.alias("_head"), separator.alias("separator"))
    parts = F.split("_head", pattern)
    shaped = first.withColumns({"columns": F.size(parts).cast("bigint"), "has_header": parts[0].try_cast("double").isNull()})
    body = F.slice("_lines", F.when(F.col("has_header"), 2).otherwise(1), F.size("_lines"))
    tokens = lambda line: F.slice(F.split(F.trim(line), pattern), F.lit(2), F.size("_lines") + F.length(line))
    numbers = F.filter(
        F.transform(F.flatten(F.transform(F.filter(body, lambda x: F.trim(x) != ""), tokens)), lambda t: F.trim(t).try_cast("double")),
        lambda v: v.isNotNull(),
    )
    rows = shaped.select(
        "file", "digest", F.size("_lines").cast("bigint").alias("total_lines"), F.size(F.filter("_lines", lambda x: F.trim(x) != "")).cast("bigint").alias("non_empty_lines"),
        (F.col("_n") + 1).cast("bigint").alias("size"), "separator", "columns", "has_header", numbers.alias("_v"),
    )
    n, total = F.size("_v"), lambda f: F.aggregate("_v", F.lit(0.0), lambda a, v: a + f(v))
    some = lambda c: F.when(n > 0, c)
    told = rows.withColumn("mean", some(total(lambda v: v) / n)).withColumns(
        {
            "count": some(n.cast("bigint")), "std": some(F.sqrt(total(lambda v: (v - F.col("mean")) * (v - F.col("mean"))) / n)),
            "min": F.array_min("_v"), "max": F.array_max("_v"),
            "zeros": some(F.size(F.filter("_v", lambda v: v == 0)).cast("bigint")), "negatives": some(F.size(F.filter("_v", lambda v: v < 0)).cast("bigint")),
            "_s": F.array_sort("_v"),
        }
    )
    half = lambda i: F.get("_s", F.floor((n - 1 + i) / 2).cast("int"))
    return told.withColumn("median", some(half(0) + (half(1) - half(0)) * 0.5)).drop("_v", "_s")


def compare_profiles(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Status, issue flags and severity of file pairs by their profiles.

    Equal digests mean identical files; a file on one side only is missing.
    """
    a, b = left.alias("a"), right.alias("b")
    pair = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    missing = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    same = F.col(f"a.{digest}") == F.col(f"b.{digest}")
    differ = lambda c: F.col(f"a.{c}") != F.col(f"b.{c}")
    change = F.abs((F.col("b.mean") - F.col("a.mean")) / F.when(F.col("a.mean") != 0, F.col("a.mean"))) * 100
    issues = {
        "major_line_difference": F.abs(F.col("b.total_lines") - F.col("a.total_lines")) > MAJOR_LINES,
        "column_mismatch": differ("columns"),
        "format_mismatch": differ("separator"),
        "header_mismatch": differ("has_header"),
        "statistical_difference": change > MEAN_PERCENT,
    }
    status = F.when(missing, "missing").when(same, "identical").otherwise("different")
    live = {n: (F.col("status") == "different") & F.coalesce(c, F.lit(False)) for n, c in issues.items()}
    spread = lambda s: F.col(f"{s}.max") - F.col(f"{s}.min")
    wider = (F.abs(spread("b") - spread("a")) > RANGE_ABSOLUTE) & (spread("a") > 0)
    out = pair.withColumn("status", status).select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), "status", *[c.alias(n) for n, c in live.items()],
        ((F.col("status") == "different") & F.coalesce(wider, F.lit(False))).alias("range_difference"),
    )
    any_issue = F.lit(False)
    for n in issues:
        any_issue = any_issue | F.col(n)
    return out.withColumn("severity", F.when(F.col("status") == "different", F.when(any_issue, "high").otherwise("low")))


def remediation(pairs: DataFrame, key: str) -> DataFrame:
    """One row per recommended repair with its urgency."""
    rules = [
        (F.col("status") == "missing", "critical", "copy missing file"),
        (F.col("major_line_difference"), "critical", "fix major data gap"),
        (F.col("header_mismatch"), "important", "standardise header"),
        (F.col("format_mismatch"), "important", "fix file format"),
        (F.col("statistical_difference"), "recommended", "validate data quality"),
    ]
    steps = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(u).alias("urgency"), F.lit(t).alias("action"))) for c, u, t in rules])
    )
    return pairs.select(key, F.inline(steps))


def table_profile(df: DataFrame, group: str, time: str, zone: str, value: str) -> DataFrame:
    """Rows, time range, distinct times and zones, missing values and sample statistics per group.

    Distinct counts run over per-(group, time) and per-(group, zone) rows, so no
    set of values is held in memory for a large group.
    """
    v = F.col(value)
    base = df.groupBy(group).agg(
        F.count("*").alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.count_if(v.isNull()).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    times = df.select(group, time).distinct().groupBy(group).agg(F.count("*").alias("n_times"))
    zones = df.select(group, zone).distinct().groupBy(group).agg(F.count("*").alias("n_zones"))
    return base.join(times, group).join(zones, group)


def coverage(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of rows that hold a value."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count(value).alias("n_valid"), (F.count(value) / F.count("*")).alias("coverage")
    )


def percentile_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The 11 percentiles, mean, deviation and missing count, percentiles as rows."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_if(v.isNull()).alias("n_missing")
    )
    return exact_quantiles(df, keys, value, PROFILE_POINTS, "value").join(base, list(keys))


def flooded_counts(df: DataFrame, keys: Sequence[str], depth: str) -> DataFrame:
    """Cells over 0.1, 0.3 and 1 m and the largest depth."""
    d = F.col(depth)
    return df.groupBy(*keys).agg(
        F.count_if(d > 0.1).alias("over_01"), F.count_if(d > 0.3).alias("over_03"), F.count_if(d > 1.0).alias("over_10"),
        F.max(d).alias("max_depth"),
    )


def compare_wet(a: DataFrame, b: DataFrame, cell: Sequence[str], depth: str, noise: float = 0.01) -> DataFrame:
    """Wet cells of two scenarios: only one, both, either, deeper and shallower."""
    left = a.select(*cell, F.col(depth).alias("_a"))
    right = b.select(*cell, F.col(depth).alias("_b"))
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return left.join(right, list(cell), "full").agg(
        F.count_if((x > 0) & (y <= 0)).alias("only_a"), F.count_if((y > 0) & (x <= 0)).alias("only_b"),
        F.count_if((x > 0) & (y > 0)).alias("both"), F.count_if((x > 0) | (y > 0)).alias("either"),
        F.count_if(y - x > noise).alias("deeper"), F.count_if(y - x < -noise).alias("shallower"),
    )


def compare_terrain(df: DataFrame, before: str, after: str, deep: float = -5.0) -> DataFrame:
    """Lowered and raised cells, the lowered ones split at a depth."""
    change = F.col(after) - F.col(before)
    return df.agg(
        F.count_if(change < deep).alias("lowered_deep"), F.count_if((change >= deep) & (change < 0)).alias("lowered"),
        F.count_if(change > 0).alias("raised"), F.min(change).alias("lowest_change"), F.max(change).alias("highest_change"),
    )


def freeboard(channel_level: DataFrame, buildings: DataFrame, level: str, ground: str, probs: Sequence[float]) -> DataFrame:
    """Percentiles of the ground height of buildings over the mean water level."""
    mean = channel_level.agg(F.avg(level).alias("v")).scalar()
    heights = buildings.select((F.col(ground) - mean).alias("fb"))
    return exact_quantiles(heights, [], "fb", probs, "freeboard")


def flood_evolution(df: DataFrame, time: str, site: str, depth: str, level: str, sites: Sequence[str]) -> DataFrame:
    """Flooded cells per snapshot beside depth and water level at the named sites."""
    cells = df.groupBy(time).agg(F.count_if(F.col(depth) > 0.1).alias("flooded"))
    named = (
        df.where(F.col(site).isin(list(sites)))
        .groupBy(time)
        .pivot(site, list(sites))
        .agg(F.max(depth).alias("depth"), F.max(level).alias("level"))
    )
    return cells.join(named, time, "left")


def area_profile(df: DataFrame, level: str, basin: str, area: str) -> DataFrame:
    """Least, median and largest basin area and basin count per level."""
    base = df.groupBy(level).agg(
        F.count("*").alias("n_basins"), F.min(area).alias("min_area"), F.max(area).alias("max_area"), F.sum(area).alias("total_area")
    )
    return base.join(exact_quantiles(df, [level], area, [0.5], "median_area").drop("q"), level)


def road_group(klass: Column, subtype: Column | None = None) -> Column:
    """Display group of a road class, the subtype where the class is empty, else ``other``."""
    named = F.when(F.coalesce(klass, F.lit("")) == "", subtype if subtype is not None else F.lit("other")).otherwise(klass)
    table = F.create_map(*[F.lit(x) for kv in ROAD_GROUPS.items() for x in kv])
    return F.coalesce(F.element_at(table, named), F.lit("other"))


def stream_group(order: Column) -> Column:
    """Display group of a stream order; a missing order counts as 1."""
    o = F.coalesce(order, F.lit(1))
    return F.when(o >= 7, "major").when(o >= 5, "large").when(o >= 3, "medium").when(o >= 1, "small")


def top_by(df: DataFrame, value: str, tie: str, k: int = 30) -> DataFrame:
    """The ``k`` rows with the largest value."""
    return df.orderBy(F.col(value).desc(), tie).limit(k)


def affected_total(regions: DataFrame, people: str, status: str, wanted: str | None = None) -> DataFrame:
    """People affected, unknown numbers left out, optionally of one status."""
    rows = regions if wanted is None else regions.where(F.col(status) == wanted)
    return rows.agg(F.coalesce(F.sum(people), F.lit(0)).alias("people"), F.count(people).alias("n_known"), F.count("*").alias("n_regions"))


def watershed_levels(summary: DataFrame, text: str, levels: Sequence[int] = (12, 10)) -> DataFrame:
    """One row per entry of a nested JSON summary with the first level that has an area."""
    shape = (
        "map<string, struct<lat: double, lon: double, levels: map<string, "
        "struct<hybas_id: bigint, sub_area_km2: double, up_area_km2: double>>>>"
    )
    rest = [c for c in summary.columns if c != text]
    entries = summary.select(*rest, F.explode(F.from_json(text, shape)).alias("entry", "_e"))
    at = lambda n: F.element_at("_e.levels", str(n))
    usable = lambda n: F.coalesce(at(n)["up_area_km2"], F.lit(0.0)) != 0
    area = F.coalesce(*[F.when(usable(n), at(n)["up_area_km2"]) for n in levels])
    level = F.coalesce(*[F.when(usable(n), n) for n in levels])
    return entries.select(
        *rest, "entry", F.col("_e.lat").alias("lat"), F.col("_e.lon").alias("lon"), level.alias("level"), area.alias("up_area_km2")
    )
