"""Incremental ingest: append without repeats and replacement of whole days."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from pluvion.session import cut_lineage


#: Most partitions that a batch may name in a filter of the table.
PRUNED_PARTITIONS = 500


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name_pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows already in the table, an empty table before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _touched(table: DataFrame, batch: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of the partitions that the batch touches.

    Up to ``PRUNED_PARTITIONS`` partitions are named in a filter, which the
    scan uses to read no other folder; a batch that touches more takes a join.
    """
    touched = batch.select(*partition_by).distinct()
    named = touched.limit(PRUNED_PARTITIONS + 1).collect()
    if len(named) > PRUNED_PARTITIONS:
        same = F.lit(True)
        for c in partition_by:
            same = same & F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}"))
        return table.alias("h").join(touched.alias("t"), same, "left_semi")
    wanted = F.lit(False)
    for row in named:
        match = F.lit(True)
        for c in partition_by:
            match = match & (F.col(c) == F.lit(row[c]) if row[c] is not None else F.col(c).isNull())
        wanted = wanted | match
    return table.where(wanted)


def append_new_rows(
    stream: DataFrame, target: str, checkpoint: str, partition_by: Sequence[str], subset: Sequence[str] | None = None
) -> StreamingQuery:
    """Append the rows of each batch that the table does not hold yet.

    Whole rows are compared unless ``subset`` names the columns. The table is
    partitioned, and only the partitions that a batch touches are read for the
    comparison. A batch that runs again after a failure finds its own rows and
    adds nothing.
    """
    columns = list(subset or stream.columns)
    schema = stream.schema

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(columns)
        held = _touched(_existing(spark, target, schema), batch, partition_by).select(*columns)
        same = None
        for c in columns:
            equal = F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}"))
            same = equal if same is None else same & equal
        added = fresh.alias("n").join(held.alias("h"), same, "left_anti")
        added.write.mode("append").partitionBy(*partition_by).parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_days(stream: DataFrame, target: str, checkpoint: str, day: str, run: str | None = None) -> StreamingQuery:
    """Each run replaces the days it carries; other days stay as they are.

    The files of a day may fall into several batches of a run: a batch keeps
    what earlier batches of its run wrote for that day. The table has the extra
    columns ``_run`` and ``_batch``; a batch that runs again after a failure
    replaces its own rows. Name the run when a stopped run is to go on.
    """
    run = run or uuid.uuid4().hex
    schema = T.StructType(stream.schema.fields + [T.StructField("_run", T.StringType()), T.StructField("_batch", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tagged = batch.withColumns({"_run": F.lit(run), "_batch": F.lit(number).cast("long")})
        kept = _touched(_existing(spark, target, schema), batch, [day]).where((F.col("_run") == run) & (F.col("_batch") != number))
        kept = cut_lineage(kept.select(*schema.names))  # the files it is read from are about to be replaced
        tagged.select(*schema.names).unionByName(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
