"""Bounded labelled samples for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.base import held_out


def order_key(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, value: int | None, rows: int, most_bytes: int, seed: int = 1) -> list[tuple[bytes, int]]:
    """At most ``rows`` ``(text, label)`` pairs in hash order of their ids, whole texts of at most ``most_bytes`` bytes.

    Held-out rows, NULL texts and labels other than 0 and 1 are left out. The
    ids are chosen from the labels first, so the join with the documents has a
    side of ``rows`` rows at most.
    """
    wanted = labels.where(F.col(label).isin([0, 1] if value is None else [value]) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    wanted = wanted.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(*order_key(seed)).limit(rows)
    return _texts(docs.join(F.broadcast(wanted), "doc_id"), most_bytes, rows)


def any_texts(docs: DataFrame, rows: int, most_bytes: int, seed: int = 2) -> list[bytes]:
    """At most ``rows`` texts in hash order of their ids, whatever their labels, held-out rows left out."""
    ids = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").orderBy(*order_key(seed)).limit(rows)
    return [text for text, _ in _texts(docs.join(F.broadcast(ids.distinct().withColumn("y", F.lit(0))), "doc_id"), most_bytes, rows)]


def _texts(found: DataFrame, most_bytes: int, rows: int) -> list[tuple[bytes, int]]:
    picked = found.where(F.octet_length("text") <= most_bytes).select("doc_id", F.encode("text", "UTF-8").alias("b"), F.col("y").cast("int"))
    return [(bytes(b), y) for _, b, y in sorted(tuple(r) for r in picked.orderBy("doc_id", "b", "y").limit(rows).collect())]
