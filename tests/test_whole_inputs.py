"""Queries that count every row of their tables."""

from __spark_entry__ import SMOKE_DIR, queries


def test_file_pair_report_counts_every_document(spark):
    n = sum(r.n for r in queries()["file_pair_report"](spark, SMOKE_DIR).collect())
    assert n == spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").count()
