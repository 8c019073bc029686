"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.base import forget, saved


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; the component is its smallest node.

    Links may repeat, point either way or join a node with itself; links with a
    NULL end are left out. Each round keeps one link per node and star, so hubs
    are aggregated before they are shuffled and their joins can be split.
    Nothing but two numbers per round reaches the driver.
    """
    nodes = links.where("a is not null and b is not null")
    edges = saved(
        nodes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = saved(small, "links")
        now = _mark(after)
        forget(edges)
        edges = after
        if now == mark:
            break
        mark = now
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and digest of a set of links; both stay when a round changes nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
