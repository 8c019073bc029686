"""Corpus pipeline: quality filter, near-duplicates, repeated passages, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.llm import bpe, mixing, quality, simhash, substrings
from pluvion.llm.base import fresh, saved, table
from pluvion.llm.queries import PATTERN, RANKS

#: Documents whose probability of good quality is lower are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network does not reject; it learns from the labels of this input.

    NULL texts score like empty ones. Columns of any name pass through.
    """
    net = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "quality")
    scored = quality.score_texts(docs, net, out=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, that with the smallest id.

    SimHash fingerprints of five-word shingles within four bits link after an
    exact check (Jaccard similarity of 0.8 and more); pairs that similar whose
    fingerprints lie further apart are found by min-wise hashes.
    """
    return simhash.deduplicate(docs, words=5, least=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has; those without any keep their text as it is.

    ``n_chars``, if there is such a column, follows the text; columns of any
    other name pass through, also those that the operator itself uses.
    """
    names = fresh(docs.select("text"), *(f"column_{i}" for i in range(len(docs.columns))))
    inner = docs.select(*(F.col(c).alias(c if c in ("doc_id", "text") else n) for c, n in zip(docs.columns, names)))
    found = substrings.remove_repeats(inner)
    changed = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))

    def column(c: str, n: str) -> F.Column:
        if c == "n_chars":
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col(c if c in ("doc_id", "text") else n).alias(c)

    return changed.select(*(column(c, n) for c, n in zip(docs.columns, names)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as packed 32-bit integers, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs.select("doc_id", "source", "text"), RANKS, PATTERN).select(
        "doc_id",
        "source",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: The trained network and the hashes have no SQL form; tests/llm hold each stage against brute-force rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet into the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).drop("ids")
