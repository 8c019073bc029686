"""Feature collections and river discharge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTS = "array<array<double>>"
_LINES = "array<array<array<double>>>"
_FEATURE = (
    "struct<properties: map<string, string>, "
    "geometry: struct<type: string, coordinates: string>>"
)


def read_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """One row per line feature of the GeoJSON files under ``path``.

    A feature starts with its type, as every common writer puts it, so the
    files are cut at the word ``"Feature"`` instead of at line breaks: Spark
    splits a large file by byte ranges, and each task reads the whole features
    that start in its range. What follows a feature's last bracket is not read.
    Files whose features start with another member need :func:`features_of` on
    whole texts.
    """
    parts = spark.read.option("lineSep", '"Feature"').text(path)
    feature = F.from_json(F.concat(F.lit('{"type":"Feature"'), "value"), _FEATURE)
    return features_to_segments(parts.where(F.col("value").rlike(r"^\s*,")).select(feature.alias("f")), "f")


def features_of(docs: DataFrame, column: str) -> DataFrame:
    """``(linkno, stream_order, coords)`` from JSON documents or single features."""
    parsed = F.from_json(column, f"struct<features: array<{_FEATURE}>>")
    feats = docs.select(F.explode(parsed["features"]).alias("f"))
    return features_to_segments(feats, "f")


def features_to_segments(feats: DataFrame, f: str) -> DataFrame:
    """Line strings as they are, multi-lines joined end to end, other types left out."""
    kind = F.col(f"{f}.geometry.type")
    raw = F.col(f"{f}.geometry.coordinates")
    points = F.when(kind == "LineString", F.from_json(raw, _POINTS)).when(
        kind == "MultiLineString", F.flatten(F.from_json(raw, _LINES))
    )
    return feats.where(kind.isin("LineString", "MultiLineString")).select(
        F.element_at(F.col(f"{f}.properties"), "linkno").cast("bigint").alias("linkno"),
        F.element_at(F.col(f"{f}.properties"), "stream_order").cast("int").alias("stream_order"),
        F.transform(points, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("coords"),
    )


def segments_to_features(segments: DataFrame, order: str, digits: int = 5) -> DataFrame:
    """``(linkno, feature)``: one GeoJSON text per linkno; the last loaded version wins."""
    last = segments.groupBy("linkno").agg(
        F.max_by(F.struct("stream_order", "coords"), order).alias("s")
    )
    coords = F.transform(
        F.col("s.coords"), lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits))
    )
    return last.select(
        "linkno",
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct("linkno", F.col("s.stream_order").alias("stream_order")).alias("properties"),
                F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"),
            )
        ).alias("feature"),
    )


def write_features(features: DataFrame, path: str) -> None:
    """One feature per line, the form that Spark and other readers can split."""
    features.select("feature").write.mode("overwrite").text(path)


def discharge_window(
    df: DataFrame, start: Column, end: Column, ids: Sequence[int], time: str = "time", river: str = "river_id", q: str = "Q"
) -> DataFrame:
    """Wanted rivers in [start, end), one column ``Q_<id>_m3s`` per river that exists."""
    inside = df.where((F.col(time) >= start) & (F.col(time) < end) & F.col(river).isin(list(ids)))
    wide = inside.groupBy(time).pivot(river, list(ids)).agg(F.first(q))
    return wide.select(time, *[F.col(str(i)).alias(f"Q_{i}_m3s") for i in ids])


def discharge_summary(df: DataFrame, time: str = "time", river: str = "river_id", q: str = "Q") -> DataFrame:
    """Mean, least, peak and total flow and the first time of the peak per river."""
    return df.groupBy(river).agg(
        F.avg(q).alias("mean_q"),
        F.min(q).alias("min_q"),
        F.max(q).alias("peak_q"),
        F.sum(q).alias("total_q"),
        F.max(F.struct(F.col(q), (-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"))).alias("_p"),
    ).select(
        river,
        "mean_q",
        "min_q",
        "peak_q",
        "total_q",
        F.timestamp_micros(-F.col("_p.t")).alias("peak_time"),
    )
