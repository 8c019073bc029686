"""Streaming forms of the incremental jobs on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pluvion.catalog import bind
from pluvion.catalog import risk as risk_catalog
from pluvion.plans import risk
from pluvion.session import ensure_checkpoint_dir
from pluvion.streaming import ingest, posterior

QUERIES, ORACLES, query = bind.area()


def _folder(spark, name):
    """A new folder for one run in the place all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    schema = bind.table(spark, d, name).schema
    return ingest.file_stream(spark, d, schema, f"{name}.parquet")


@query(
    "stream_append",
    "SELECT DISTINCT o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey % 25 AS zone_id FROM orders",
)
def stream_append(spark, d):
    base = _folder(spark, "append")
    rows = _stream(spark, d, "orders").select(
        F.col("o_orderstatus").alias("status"), bind.day("o_orderdate").alias("day"), (F.col("o_custkey") % 25).alias("zone_id")
    )
    for run in ("first", "again"):  # the second run brings every row once more
        ingest.append_new_rows(rows, f"{base}/table", f"{base}/{run}", ["status"]).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


@query(
    "stream_replace_days",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, round(sum(value) * 2, 4) AS total FROM events GROUP BY 1, 2",
)
def stream_replace_days(spark, d):
    base = _folder(spark, "replace")
    events = _stream(spark, d, "events").select(bind.day("ts").alias("day"), "user_id", "value")
    for run, factor in (("first", 1.0), ("again", 2.0)):
        rows = events.withColumn("value", F.col("value") * factor)
        ingest.replace_days(rows, f"{base}/table", f"{base}/{run}", "day").awaitTermination()
    table = spark.read.option("inferSchema", False).parquet(f"{base}/table")
    return table.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id").agg(F.round(F.sum("value"), 4).alias("total"))


@query("stream_posterior", risk_catalog.ORACLES["dbn_sequence"])
def stream_posterior(spark, d):
    base = _folder(spark, "posterior")
    states = risk_catalog._sequence_states(spark, d)
    lik = risk.infer_hard(states, include_agreement=False, include_tail=True).select("id", "month", F.col("posterior").alias("lik"))
    # Two halves of the months arrive one after the other.
    half = "1995-06"
    lik.where(F.col("month") <= half).write.parquet(f"{base}/in/part=1")
    out = posterior.monthly_posteriors(
        ingest.file_stream(spark, f"{base}/in/*", lik.schema), "id", "month", "lik"
    )
    sink = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    sink.start().awaitTermination()
    lik.where(F.col("month") > half).write.parquet(f"{base}/in/part=2")
    sink.start().awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.select("id", "month", "temporal_prior", *risk_catalog.rounded())
