"""Rows that earlier versions lost without a word."""

from pyspark.sql import functions as F

from pluvion.operators import graph, hydro
from pluvion.plans import risk
from pluvion.streaming import ingest


def test_long_ridge_is_settled(spark):
    ridge = spark.createDataFrame([(0, c, float(c)) for c in range(24)], "row long, col long, acc double")
    kept = {r.col for r in graph.suppress_neighbours(ridge, "acc", 5).collect()}
    assert kept == {23, 17, 11, 5}


def test_missing_flow_has_no_stage(spark):
    flows = spark.createDataFrame([(1, None, 10.0), (2, 0.0, 10.0), (3, -1.0, 10.0)], "id long, q double, bed double")
    got = {r.id: r.stage for r in hydro.culvert_stage(flows, "q", "bed").collect()}
    assert got == {1: None, 2: 10.0, 3: 10.0}


def test_zero_evidence_keeps_its_row(spark):
    sizes = {"cur": 5, "def": 5, "spa": 3, "trn": 3, "tail": 4, "cdi": 6}
    arrays = {f"ev_{k}": F.array(*[F.lit(1.0 / n)] * n) for k, n in sizes.items()}
    rows = spark.range(2).withColumns(arrays)
    rows = rows.withColumn("ev_cur", F.when(F.col("id") == 0, F.col("ev_cur")).otherwise(F.array(*[F.lit(0.0)] * 5)))
    got = {r.id: r.posterior for r in risk.infer_soft_long(rows, ["id"], F.lit(3)).collect()}
    assert set(got) == {0, 1} and abs(sum(got[0]) - 1) < 1e-9 and got[1] == [0.0] * 5


def test_a_day_over_two_batches(spark, tmp_path):
    schema = "day string, value double"
    for n, rows in enumerate(([("a", 1.0), ("b", 2.0)], [("a", 3.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    for run in ("first", "second"):
        ingest.replace_days(stream, f"{tmp_path}/table", f"{tmp_path}/{run}", "day").awaitTermination()
    table = spark.read.parquet(f"{tmp_path}/table")
    assert sorted((r.day, r.value) for r in table.collect()) == [("a", 1.0), ("a", 3.0), ("b", 2.0)]


def test_null_partitions_of_a_large_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PRUNED_PARTITIONS", 1)
    schema = "day string, value double"
    for rows in ([(None, 1.0), ("b", 2.0)], [(None, 3.0), ("c", 4.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = [("None", 1.0), ("None", 3.0), ("b", 2.0), ("c", 4.0)]
    stream = ingest.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    ingest.replace_days(stream, f"{tmp_path}/days", f"{tmp_path}/run", "day").awaitTermination()
    assert sorted((str(r.day), r.value) for r in spark.read.parquet(f"{tmp_path}/days").collect()) == whole
    for run in ("first", "second"):
        ingest.append_new_rows(stream, f"{tmp_path}/rows", f"{tmp_path}/{run}", ["day"]).awaitTermination()
    assert sorted((str(r.day), r.value) for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == whole
