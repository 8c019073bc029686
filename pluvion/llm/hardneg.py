"""Hard negatives: exact scores by residue-number-system products, then selection in a window below each positive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import forget, saved, short_batches

#: Rows of a shard, anchors of a block and rows of a product.
SHARD_ROWS, BLOCK_ANCHORS, TILE = 16384, 512, 4096
#: Lists of one anchor that a merge puts together.
FAN_IN = 16
SCALE = 256
#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A product of this many dimensions stays below 2^24 with centred residues of primes below 1024, so float32 holds every sum exactly.
SLICE = 64
#: Scores stop at the ends of 64 bits.
LOW, HIGH = -(2**63), 2**63 - 1


def _primes_below(top: int) -> Iterator[int]:
    for n in range(top - 1, 2, -1):
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            yield n


PRIMES = list(_primes_below(1024))


def moduli(bound: int) -> list[int]:
    """The fewest largest primes below 1024 whose product tells all whole numbers of at most ``bound`` in size apart."""
    out, product = [], 1
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * bound + 1:
            return out
    raise OverflowError("the components are too large for the primes below 1024")


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """Residues between -p/2 and p/2 of whole numbers in double precision, as float32."""
    r = np.fmod(matrix, p)
    half = p // 2
    r = np.where(r > half, r - p, np.where(r < -half, r + p, r))
    return r.astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` from centred residues, 0 to p - 1."""
    total = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], SLICE):
        total += np.mod((a[:, at : at + SLICE] @ b[:, at : at + SLICE].T).astype(np.int32), np.int32(p))
    return np.mod(total, np.int32(p))


def signed_scores(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Whole numbers between minus and plus half the product of ``primes`` from their residues, by mixed-radix Chinese remaindering.

    Within 62 bits the digits are put together in 64-bit integers, beyond in
    Python's own; what lies outside 64 bits stops at their ends.
    """
    digits = []
    for i, p in enumerate(primes):
        d = parts[i].astype(np.int64)
        for q, digit in zip(primes, digits):
            d = (d - digit) * pow(q, -1, p) % p
        digits.append(d)
    product = 1
    for p in primes:
        product *= p
    wide = product >= 1 << 62
    value = np.zeros(digits[0].shape, object if wide else np.int64)
    for p, digit in zip(reversed(primes), reversed(digits)):
        value = value * p + (digit.astype(object) if wide else digit)
    value = np.where(value > product // 2, value - product, value)
    return np.clip(value, LOW, HIGH).astype(np.int64) if wide else value


class ResidueRows:
    """Rows of a shard whose residues are kept per prime, so that every block of anchors finds them ready."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.largest = _largest(matrix)
        self.held: dict[int, np.ndarray] = {}

    def scores(self, anchors: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Exact inner products of ``anchors`` and the rows from ``start`` to ``stop``."""
        primes = moduli(_largest(anchors) * self.largest * max(1, anchors.shape[1]))
        for p in primes:
            if p not in self.held:
                self.held[p] = residues(self.matrix, p)
        return signed_scores([residue_product(residues(anchors, p), self.held[p][start:stop], p) for p in primes], primes)


def _largest(matrix: np.ndarray) -> int:
    return int(np.abs(matrix).max()) if matrix.size else 0


def floors(score):
    """Smallest whole number n with 100 n >= 80 score, without leaving 64 bits."""
    return score - score // 5


def usable_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str, shift_every: int, classes: int) -> DataFrame:
    """``(vec_id, label, v, size)`` with ``v`` as ``floor(256 x)`` in double precision; one row per id.

    Rows without an id or label, and vectors that are NULL or empty or hold
    NULL or non-finite components take no part; components from 1e150 on in size
    count as non-finite. An id that repeats is one row,
    that with the smallest vector in array order, then the smallest label.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e150)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", fine))
    moved = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") % classes + 1) % classes).otherwise(F.col("label"))
    scaled = rows.select("vec_id", moved.alias("label"), F.transform("e", lambda x: x.cast("double") * SCALE).alias("v"))
    one = scaled.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")
    return one.withColumn("size", F.size("v"))


def mine(
    vectors: DataFrame,
    anchor_every: int = 100,
    shift_every: int = 7,
    classes: int = 10,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    The first pass over the grid of shards and anchor blocks finds each
    anchor's best rows of its own label, the second one the best rows of other
    labels whose score lies between 0.8 times a positive's and the positive's.
    A cell of the grid keeps a few rows per anchor, lists are merged ``FAN_IN``
    at a time. Ties go to the smaller id. Vectors of another length than the
    anchor's have no score with it. Anchors without positives and positives
    without negatives have no rows; an empty table gives an empty table.
    """
    rows = saved(usable_rows(vectors, vec_id, embedding, label, shift_every, classes), "rows")
    count = max(1, rows.count())
    shards, blocks = -(-count // SHARD_ROWS), -(-count // (anchor_every * BLOCK_ANCHORS))
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    none = F.array().cast("array<long>")
    found = _grid(rows, anchors.withColumn("below", none), shards, blocks, lambda cell: _positives(cell, positives), "anchor_id long, slot int, shard int, best array<struct<score: long, id: long>>")
    best = saved(_merge(found, shards, positives), "positives")
    below = best.select(F.col("anchor_id").alias("vec_id"), F.transform("best", lambda b: b["score"]).alias("below"))
    found = _grid(rows, anchors.join(below, "vec_id"), shards, blocks, lambda cell: _negatives(cell, negatives), "anchor_id long, slot int, shard int, best array<struct<score: long, id: long>>")
    chosen = saved(_merge(found, shards, negatives), "negatives")
    forget(rows)
    told = best.select("anchor_id", F.posexplode("best").alias("slot", "p"))
    each = chosen.select("anchor_id", "slot", F.posexplode("best").alias("at", "n"))
    return told.join(each, ["anchor_id", "slot"]).select(
        "anchor_id",
        F.col("p.id").alias("positive_id"),
        (F.col("at") + 1).alias("rank"),
        F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("n.score").alias("negative_score"),
    )


def _grid(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, select, schema: str) -> DataFrame:
    """``select`` applied to every cell: the rows of a shard and the anchors of a block, of one vector length."""
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    dealt = rows.select(part(shards, 1).alias("shard"), "size", F.lit(-1).alias("block"), "vec_id", "label", "v", F.array().cast("array<long>").alias("below"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = anchors.select(every, "size", part(blocks, 2).alias("block"), "vec_id", "label", "v", "below")
    cells = dealt.unionByName(asked).repartition(shards, "shard", "size").sortWithinPartitions("shard", "size", "block", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, of = None, None, None
        for key, part in _runs(batches):
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            matrix = np.floor(part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), key[1])
            if key[2] < 0:
                at, held, of = key[:2], ResidueRows(matrix), (ids, labels)
            elif at == key[:2]:
                for i in range(0, len(ids), BLOCK_ANCHORS):
                    take = slice(i, i + BLOCK_ANCHORS)
                    below = part.column("below").slice(i, BLOCK_ANCHORS).to_pylist()
                    yield from select((key[0], ids[take], labels[take], matrix[take], below, *of, held))

    short_batches(rows.sparkSession)
    return cells.mapInArrow(run, T.StructType.fromDDL(schema))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of one (shard, size, block), put together over batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "size", "block")]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = np.concatenate([[0], change, [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _first(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row the ``k`` highest allowed scores with their ids, ties to the smaller id (``ids`` ascending)."""
    out = []
    for row, may in zip(scores, allowed):
        at = np.flatnonzero(may)
        if len(at) > k:
            edge = np.partition(row[at], len(at) - k)[len(at) - k]
            above, level = at[row[at] > edge], at[row[at] == edge]
            at = np.concatenate([above, level[: k - len(above)]])
        at = at[np.lexsort((ids[at], ~row[at]))]
        out.append((row[at], ids[at]))
    return out


def _lists(shard: int, found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Lists ``(anchor, slot, scores, ids)`` as a batch."""
    if not found:
        return
    offsets = np.concatenate([[0], np.cumsum([len(s) for _, _, s, _ in found])]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([s for _, _, s, _ in found]), pa.int64()), pa.array(np.concatenate([i for *_, i in found]), pa.int64())], ["score", "id"])
    columns = [
        pa.array([a for a, *_ in found], pa.int64()),
        pa.array([slot for _, slot, *_ in found], pa.int32()),
        pa.array(np.full(len(found), shard, np.int32)),
        pa.ListArray.from_arrays(pa.array(offsets), pairs),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "slot", "shard", "best"])


def _positives(cell: tuple, k: int) -> Iterator[pa.RecordBatch]:
    shard, anchor_ids, anchor_labels, anchors, _, ids, labels, rows = cell
    found = []
    for start in range(0, len(ids), TILE):
        part = slice(start, start + TILE)
        scores = rows.scores(anchors, start, start + TILE)
        allowed = (anchor_labels[:, None] == labels[None, part]) & (anchor_ids[:, None] != ids[None, part])
        found += [(a, 0, s, i) for a, (s, i) in zip(anchor_ids, _first(scores, allowed, ids[part], k)) if len(s)]
    yield from _lists(shard, found)


def _negatives(cell: tuple, k: int) -> Iterator[pa.RecordBatch]:
    shard, anchor_ids, anchor_labels, anchors, below, ids, labels, rows = cell
    found = []
    for start in range(0, len(ids), TILE):
        part = slice(start, start + TILE)
        scores = rows.scores(anchors, start, start + TILE)
        other = anchor_labels[:, None] != labels[None, part]
        for slot in range(max(map(len, below), default=0)):
            top = np.array([b[slot] if slot < len(b) else -1 for b in below], np.int64)[:, None]
            allowed = other & (scores <= top) & (scores >= floors(top))
            found += [(a, slot, s, i) for a, (s, i) in zip(anchor_ids, _first(scores, allowed, ids[part], k)) if len(s)]
    yield from _lists(shard, found)


def _merge(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """``(anchor_id, slot, best)``: the lists of all shards as one, ``FAN_IN`` shards at a time; a cell's several lists count as one shard's."""
    keyed = F.transform(F.flatten(F.collect_list("best")), lambda b: F.struct((-1 - b["score"]).alias("below"), b["id"].alias("id"), b["score"].alias("score")))
    best = F.transform(F.slice(F.sort_array(keyed), 1, k), lambda b: F.struct(b["score"].alias("score"), b["id"].alias("id")))
    lists = lists.groupBy("anchor_id", "slot", "shard").agg(best.alias("best"))
    width = shards
    while width > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")).groupBy("anchor_id", "slot", "shard").agg(best.alias("best"))
        width = -(-width // FAN_IN)
    return lists.select("anchor_id", "slot", "best")
