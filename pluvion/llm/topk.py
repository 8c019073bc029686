"""Exact top-k search: tiled matrix products, partial selection per tile, tree merge of the lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import saved

TILE_QUERIES, TILE_ROWS, FAN_IN = 512, 4096, 16
SCALE = 64
#: Integers up to here are exact in double precision.
EXACT = 2.0**53


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, v)``: components as ``floor(64 x)``, usable vectors only, one row per id.

    Vectors that are NULL or empty or hold NULL, NaN or infinite components take no
    part, nor do rows without an id. An id that repeats is one row, with its
    smallest vector in array order.
    """
    whole = F.transform(F.col("e"), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    usable = F.forall(F.col("e"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    return rows.where(usable & (F.size("e") > 0)).select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def best_per_row(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` best of each row, ties to the smaller id (``ids`` ascending)."""
    rows, columns = scores.shape
    if columns > k:
        edge = np.partition(scores, columns - k, axis=1)[:, columns - k]
        above = scores > edge[:, None]
        level = scores == edge[:, None]
        spare = k - above.sum(axis=1)
        above |= level & (level.cumsum(axis=1) <= spare[:, None])
    else:
        above = np.ones_like(scores, dtype=bool)
    return np.nonzero(above)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; double precision where that is exact, whole numbers beyond, held within 64 bits."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)))
    if float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1] < EXACT:
        return queries @ rows.T
    big = np.vectorize(int, otypes=[object])
    exact = big(queries) @ big(rows).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every``, its ``k`` best other rows.

    Shards of rows and blocks of queries meet as tiles, each tile once. A tile
    keeps ``k`` rows per query; lists are merged ``FAN_IN`` at a time, so no
    task gathers the lists of all shards. Vectors of another length than the
    query's have no inner product with it and are no candidates. Queries
    without candidates have no rows, an empty table gives an empty table.
    Scores beyond 64 bits stop at the ends of that range.
    """
    rows = saved(quantised(vectors, vec_id, embedding).withColumn("size", F.size("v")), "vectors")
    count = max(1, rows.count())
    shards, blocks = -(-count // TILE_ROWS), -(-count // (every * TILE_QUERIES))
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    sharded = rows.select(F.lit(False).alias("query"), part(shards, 1).alias("shard"), F.lit(-1).alias("block"), "size", "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).select(
        F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part(blocks, 2).alias("block"), "size", "vec_id", "v"
    )
    tiles = sharded.unionByName(asked).repartition(shards, "shard", "size").sortWithinPartitions("shard", "size", "query", "block", "vec_id")
    schema = T.StructType.fromDDL("query_id long, shard int, best array<struct<score: long, vec_id: long>>")
    lists = tiles.mapInArrow(lambda batches: _search(batches, k), schema)
    width = shards
    while width > 1:
        lists, width = _merged(lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int")), k), -(-width // FAN_IN)
    return lists.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """Lists of one query and shard group become one."""
    keyed = F.transform(F.flatten(F.collect_list("best")), lambda b: F.struct((-b["score"]).alias("below"), b["vec_id"].alias("vec_id"), b["score"].alias("score")))
    best = F.transform(F.slice(F.sort_array(keyed), 1, k), lambda b: F.struct(b["score"].alias("score"), b["vec_id"].alias("vec_id")))
    return lists.groupBy("query_id", "shard").agg(best.alias("best"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Consecutive rows of one (shard, size, query, block) as ids and a matrix, never more than a tile's side at once."""
    held, ids, values = None, [], []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "query", "block"))))
        vec_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        start, at = 0, 0
        for i, key in enumerate(keys):
            last = i + 1 == len(keys) or keys[i + 1] != key
            if not last:
                continue
            size = key[1] * (i + 1 - start)
            if held is not None and held != key:
                yield held, np.concatenate(ids), np.concatenate(values)
                ids, values = [], []
            held = key
            ids.append(vec_ids[start : i + 1])
            values.append(flat[at : at + size].reshape(-1, key[1]))
            start, at = i + 1, at + size
    if held is not None:
        yield held, np.concatenate(ids), np.concatenate(values)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    shard, size, rows, row_ids = None, None, None, None
    for key, ids, matrix in _runs(batches):
        if not key[2]:
            shard, size, rows, row_ids = key[0], key[1], matrix, ids
            continue
        if (shard, size) != key[:2]:
            continue
        for at in range(0, len(ids), TILE_QUERIES):
            yield _tile(ids[at : at + TILE_QUERIES], matrix[at : at + TILE_QUERIES], row_ids, rows, key[0], k)


def _tile(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, shard: int, k: int) -> pa.RecordBatch:
    scores = products(queries, rows)
    place = np.searchsorted(row_ids, query_ids)
    own = (place < len(row_ids)) & (row_ids[np.minimum(place, len(row_ids) - 1)] == query_ids)
    q, r = best_per_row(scores, row_ids, k + 1)
    keep = ~(own[q] & (place[q] == r))
    q, r = q[keep], r[keep]
    found = scores[q, r]
    order = np.lexsort((row_ids[r], -found, q))
    q, r, found = q[order], r[order], found[order]
    counts = np.bincount(q, minlength=len(query_ids))
    first = np.cumsum(counts) - counts
    keep = np.arange(len(q)) - first[q] < k
    q, r, found = q[keep], r[keep], found[keep]
    counts = np.bincount(q, minlength=len(query_ids))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    best = pa.StructArray.from_arrays([pa.array(found.astype(np.int64)), pa.array(row_ids[r])], ["score", "vec_id"])
    out = pa.RecordBatch.from_arrays(
        [pa.array(query_ids), pa.array(np.full(len(query_ids), shard, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), best)], ["query_id", "shard", "best"]
    )
    return out.filter(pa.array(counts > 0))
