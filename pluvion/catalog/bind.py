"""The driver tables seen as observation, zone, series and network tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def area():
    """Empty query and oracle registers with the decorator that fills them."""
    queries, oracles = {}, {}

    def query(name, sql=None):
        def add(fn):
            if name in queries:
                raise ValueError(f"query {name} registered twice")
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return add

    return queries, oracles, query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- line items as gridded observations: one row per (variable, day, cell) reading

GRID_SQL = """
grid AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS variable,
         CAST(l_shipdate AS DATE) AS "time",
         l_suppkey AS cell,
         CAST(l_suppkey // 10 AS INTEGER) AS "row", CAST(l_suppkey % 10 AS INTEGER) AS col,
         -5.0 + 0.25 * (l_suppkey // 10) AS lat, 30.0 + 0.25 * (l_suppkey % 10) AS lon,
         l_linenumber AS member,
         CASE WHEN l_tax <= 0.02 THEN l_quantity END AS value,
         l_extendedprice AS price, 1.0 - l_discount AS weight
  FROM lineitem),
cell_zone AS (SELECT s_suppkey AS cell, s_nationkey AS zone_id FROM supplier WHERE s_nationkey <> 0)
"""


def grid(spark: SparkSession, folder: str) -> DataFrame:
    cell = F.col("l_suppkey")
    row = F.floor(cell / 10).cast("int")
    col = (cell % 10).cast("int")
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", 1)
        .when(F.col("l_returnflag") == "N", 2)
        .otherwise(3)
        .alias("variable"),
        F.to_date("l_shipdate").alias("time"),
        cell.alias("cell"),
        row.alias("row"),
        col.alias("col"),
        (row * 0.25 - 5.0).alias("lat"),
        (col * 0.25 + 30.0).alias("lon"),
        F.col("l_linenumber").alias("member"),
        F.when(F.col("l_tax") <= 0.02, F.col("l_quantity")).alias("value"),
        F.col("l_extendedprice").alias("price"),
        (F.lit(1.0) - F.col("l_discount")).alias("weight"),
    )


def cell_zone(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("zone_id")
    )


def with_sql(body: str, *parts: str) -> str:
    """Prefix a query with the shared table expressions."""
    head = "WITH " + ",\n".join(p.strip() for p in parts)
    return head + body if body.startswith(",") else head + "\n" + body


def day_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


# ---- orders as daily zone series with gaps

SERIES_SQL = """
series AS (SELECT o_custkey % 25 AS zone_id, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value,
                  count(*) AS n
           FROM orders GROUP BY 1, 2)
"""


def series(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .groupBy((F.col("o_custkey") % 25).alias("zone_id"), F.to_date("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("value"), F.count("*").alias("n"))
    )


# ---- line items as daily water balance per cell; some actual values are missing

BALANCE_SQL = """
balance AS (SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS day,
                   CASE WHEN l_tax <= 0.06 THEN l_quantity * (1 - l_discount) END AS aet,
                   l_quantity * (1 + l_tax) AS pet
            FROM lineitem)
"""


def balance(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("cell"),
        F.to_date("l_shipdate").alias("day"),
        F.when(F.col("l_tax") <= 0.06, q * (1 - F.col("l_discount"))).alias("aet"),
        (q * (1 + F.col("l_tax"))).alias("pet"),
    )


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")
