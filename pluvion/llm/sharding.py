"""Sharding by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.llm.base import saved, utf8

#: What a document costs beyond its bytes.
OVERHEAD = 16
#: Atoms have 63-bit keys; the driver holds at most about 2^14 sums of key ranges at a time.
KEY_BITS, LEVEL_BITS = 63, 14
#: A group above this part of a mean shard is placed before the others; there are at most so many per shard.
BIG_PART = 16
SLOT_ROWS = 20_000


def first_cuts(sums: np.ndarray, loads: np.ndarray, capacity: float, whole: np.ndarray | None = None) -> np.ndarray | None:
    """Greedy check: ends of the shards' runs if every run fits ``capacity`` less its shard's load, else None.

    ``sums`` are running sums of the atoms with a leading zero. Where ``whole``
    is False an atom may be cut anywhere, which bounds the capacity from below.
    The ends are positions on the scale of the sums.
    """
    ends, at = np.empty(len(loads)), 0.0
    for i, load in enumerate(loads):
        reach = at + max(0.0, capacity - load)
        k = int(np.searchsorted(sums, reach, side="right")) - 1
        if k + 1 < len(sums) and whole is not None and not whole[k]:
            at = reach
        else:
            at = max(at, float(sums[k]))
        ends[i] = at
    return ends if ends[-1] >= sums[-1] else None


def common_level(total: float, loads: np.ndarray) -> float:
    """The level up to which ``total`` fills shards that hold ``loads``; fuller shards get nothing."""
    held = np.sort(loads)
    levels = (total + np.cumsum(held)) / np.arange(1, len(held) + 1)
    return float(levels.min())


def even_cuts(sums: np.ndarray, loads: np.ndarray, capacity: float) -> np.ndarray:
    """Ends of the shards' runs within a feasible capacity, each as near to an even share as the others allow.

    Even is what brings every shard to one level. The greedy check forwards
    gives the latest ends, and backwards the earliest; between them the end
    nearest to the share is taken.
    """
    latest = first_cuts(sums, loads, capacity)
    back = first_cuts((sums[-1] - sums)[::-1], loads[::-1], capacity)
    earliest = sums[-1] - np.concatenate([back[-2::-1], [0]])
    room = np.maximum(capacity - loads, 0)
    share = np.cumsum(np.maximum(common_level(float(sums[-1]), loads) - loads, 0))
    ends, at = np.empty(len(loads)), 0.0
    for i in range(len(loads)):
        reach = sums[np.searchsorted(sums, at + room[i], side="right") - 1]
        k = int(np.searchsorted(sums, share[i]))
        near = [sums[j] for j in (k - 1, k) if 0 <= j < len(sums)]
        best = min(near, key=lambda x: abs(x - share[i]))
        at = ends[i] = min(max(best, earliest[i], at), latest[i], max(reach, at))
    return ends


def smallest_capacity(sums: np.ndarray, loads: np.ndarray, whole: np.ndarray | None = None) -> int:
    """The smallest whole capacity that :func:`first_cuts` finds feasible, by binary search."""
    low, high = 0, int(loads.max(initial=0) + sums[-1])
    while low < high:
        middle = (low + high) // 2
        if first_cuts(sums, loads, middle, whole) is None:
            low = middle + 1
        else:
            high = middle
    return low


def place_big(big: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], np.ndarray]:
    """Groups ``(size, key)`` to shards, largest first, each to the shard with the least; and the loads."""
    heap = [(0, s) for s in range(shards)]
    place, loads = {}, np.zeros(shards, dtype=np.int64)
    for size, key in sorted(big, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        place[key] = s
        loads[s] = load + size
        heapq.heappush(heap, (load + size, s))
    return place, loads


def key_cuts(groups: DataFrame, loads: np.ndarray) -> list[int]:
    """First key of every shard after the first, for groups ``(key, size)`` in key order.

    Sizes are summed by leading key bits. The capacity lies between that with
    all ranges cut anywhere and that with none cut; only ranges in which an end
    may fall for a capacity in between are summed with more bits, until the two
    capacities agree or those ranges hold one group each.
    """
    spark = groups.sparkSession
    shift = KEY_BITS - LEVEL_BITS
    ranges = _sums(groups, shift)
    while True:
        low_key, width, size, count = ranges
        sums = np.concatenate([[0], np.cumsum(size)])
        whole = (count <= 1) | (width == 0)
        above = smallest_capacity(sums, loads)
        below = smallest_capacity(sums, loads, whole)
        if above > below and not whole.all():
            first = first_cuts(sums, loads, below, whole)
            last = first_cuts(sums, loads, above, whole)
            inside = np.zeros(len(size), dtype=bool)
            for a, b in zip(first, last):
                inside[max(0, np.searchsorted(sums, a, side="right") - 2) : np.searchsorted(sums, b, side="right") + 1] = True
            inside &= ~whole
            if inside.any():
                finer = max(1, LEVEL_BITS - math.ceil(math.log2(inside.sum() + 1)))
                old = int(width[inside].max())
                new = max(0, old - finer)
                named = spark.createDataFrame([(int(k) >> old,) for k in low_key[inside]], "head long")
                parts = groups.withColumn("head", F.shiftright("key", old)).join(F.broadcast(named), "head", "left_semi")
                more = _sums(parts, new)
                keep = ~inside
                merged = [np.concatenate([x[keep], y]) for x, y in zip(ranges, more)]
                order = np.argsort(merged[0], kind="stable")
                ranges = tuple(x[order] for x in merged)
                continue
        cuts = []
        for end in even_cuts(sums, loads, above)[:-1]:
            k = int(np.searchsorted(sums, end, side="left"))
            cuts.append(int(low_key[k]) if k < len(low_key) else 1 << 62)
        return cuts


def _sums(groups: DataFrame, shift: int) -> tuple[np.ndarray, ...]:
    """Start, width in bits, size and number of groups of the key ranges that hold any, in order."""
    rows = groups.groupBy(F.shiftright("key", shift).alias("head")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows.sort()
    head, size, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    return head << shift, np.full(len(head), shift, dtype=np.int64), size, n


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row; sizes of shards near equal.

    Equal texts are one group and stay together (NULL texts are a group; texts
    that share a 63-bit hash are too). Groups above a sixteenth of a mean shard,
    of which there are few, are dealt out largest first; a shard's run of the
    others follows them, cut from the order of their hashes so that the fullest
    shard is as small as it can be. Slots count from 0 without gaps in each
    shard, numbered in parts whose rows do not grow with the table. Repeated
    rows count each time; an empty table gives an empty table.
    """
    rows = saved(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(utf8(F.col(text))).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("key"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    whole, count = total["size"] or 0, total["n"] or 0
    limit = whole // (shards * BIG_PART)
    big = [(r["size"], r["key"]) for r in groups.where(F.col("size") > limit).select("size", "key").collect()] if count else []
    place, loads = place_big(big, shards)
    order = np.argsort(-loads, kind="stable")
    cuts = key_cuts(groups.where(F.col("size") <= limit), loads[order])
    number = {int(s): i for i, s in enumerate(order)}
    named = docs.sparkSession.createDataFrame([(k, number[s]) for k, s in place.items()], "key long, big_shard int")
    run = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    placed = rows.join(F.broadcast(named), "key", "left").withColumn("shard", F.coalesce("big_shard", run).cast("int"))
    parts = max(1, -(-count // (shards * SLOT_ROWS)))
    salted = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    sizes = salted.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "part").orderBy("key", "doc_id", "row")) - 1
    numbered = salted.withColumn("inside", inside).join(starts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("inside") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
