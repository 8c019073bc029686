"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.llm.base import fresh, saved

#: White space between words, and the most often a document may be taken.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
PASSES = 3
#: A hash has 63 bits; each histogram level looks at so many of them.
HASH_BITS = 63
LEVEL_BITS = 9


def word_count(text) -> F.Column:
    """Number of runs of characters other than ASCII white space (NULL: none)."""
    return F.coalesce(F.length(F.regexp_replace(F.rtrim(text, F.lit(BLANKS)), WORD, "x")).cast("long"), F.lit(0).cast("long"))


def mix_hash(doc_id, text, seed: int = 7) -> F.Column:
    """Non-negative hash of a row; rows alike in id and text hash alike."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1)


def source_targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """``(source, source_size, target)``: every size shared out by the weights 1, 2, 3, repeating in source order.

    ``sizes`` holds ``(source, size)`` rows. A source's target ends at
    ``passes`` times its size; what is above is shared again by weight. That
    comes to one common level: sources in order of size over weight fill up
    first, and the rest gets the level by weight. There is one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(1))
    weighted = (
        by_source.withColumn("n", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))))
        .withColumn("weight", (F.col("n") - 1) % 3 + 1)
        .withColumn("most", F.col("source_size") * passes)
    )
    order = everything.orderBy(F.col("most") / F.col("weight"), "n")
    levels = weighted.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    )
    free = F.col("level") * F.col("weight") <= F.col("most")
    first = F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), F.col("n"), F.col("level").alias("level")))).over(everything)
    return levels.withColumn("first", first).select(
        "source", "source_size", F.least(F.col("most").cast("double"), F.col("first.level") * F.col("weight")).alias("target")
    )


def thresholds(sized: DataFrame, passes: int = PASSES) -> DataFrame:
    """``(source, source_size, target, whole, below)``: every row ``whole`` times, and once more where its hash is under ``below``.

    ``sized`` holds ``(source, size, hash)``. Sizes are summed by source and
    leading hash bits; only the bucket in which a budget ends is looked at with
    more bits, until it holds one hash value, which goes to the nearer side.
    """
    targets = source_targets(sized.select("source", "size"), passes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budgets = saved(
        targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "budgets"
    )
    same = F.col("s.source").eqNullSafe(F.col("e.source"))
    edge = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    shift, open_ = HASH_BITS, None
    while shift > 0:
        known, shift = shift, shift - LEVEL_BITS
        inside = sized.alias("s").join(edge.alias("e"), same & (F.shiftright("s.hash", known) == F.col("e.prefix")) if known < HASH_BITS else same)
        bucket = inside.groupBy(F.col("e.source"), "rest", "before", F.shiftright("s.hash", shift).alias("bucket")).agg(
            F.sum("s.size").alias("bucket_size"), F.min("s.hash").alias("low"), F.max("s.hash").alias("high")
        )
        upto = W.partitionBy("source").orderBy("bucket")
        edge = saved(
            bucket.withColumn("before", F.col("before") + F.sum("bucket_size").over(upto) - F.col("bucket_size"))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size")))
            .select("source", "rest", F.col("bucket").alias("prefix"), "before", "bucket_size", "low", "high"),
            "edges",
        )
        if edge.where("low < high").isEmpty():
            break
    taken = F.col("bucket_size") - (F.col("rest") - F.col("before")) < F.col("rest") - F.col("before")
    ends = edge.select(F.col("source").alias("end_source"), F.when(taken, F.col("low") + 1).otherwise(F.col("low")).alias("below"))
    found = budgets.join(ends, budgets["source"].eqNullSafe(ends["end_source"]), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0).cast("long")).alias("below")
    )
    return saved(found, "thresholds")  # its size is known: a short list of sources is broadcast and no text is shuffled


def sizes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, size, hash)`` of every row, kept in the shared folder."""
    return saved(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mix_hash(F.col(doc_id), F.col(text)).alias("hash")),
        "sizes",
    )


def mixed_sizes(sized: DataFrame, passes: int = PASSES) -> DataFrame:
    """``(doc_id, source, size, source_size, target, passes, taken)`` of every row: how often the mix takes it.

    Thresholds are nested: a larger budget takes all that a smaller one does.
    Nothing is sorted. NULL texts have size 0, NULL sources are one source
    after the others, rows alike in id and text are taken alike, an empty table
    gives an empty table.
    """
    chosen = thresholds(sized, passes).withColumnRenamed("source", "chosen_source")
    times = F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return sized.join(chosen, sized["source"].eqNullSafe(chosen["chosen_source"])).select(
        "doc_id", "source", "size", "source_size", "target", times.cast("int").alias("passes"), (F.col("size") * times).alias("taken")
    )


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", passes: int = PASSES) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, columns unchanged."""
    chosen = thresholds(sizes_of(docs, doc_id, text, source), passes)
    below, whole, key, copy = fresh(docs, "below", "whole", "chosen_source", "copy")
    ends = chosen.select(F.col("source").alias(key), F.col("whole").alias(whole), F.col("below").alias(below))
    times = F.col(whole) + F.when(mix_hash(F.col(doc_id), F.col(text)) < F.col(below), 1).otherwise(0)
    return (
        docs.join(ends, docs[source].eqNullSafe(ends[key]))
        .withColumn(copy, F.explode(F.sequence(F.lit(0), times)))
        .where(F.col(copy) > 0)
        .select(*docs.columns)
    )
