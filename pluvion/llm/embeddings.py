"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import forest, saved
from pluvion.llm.components import components

#: Tables, projections per table and cell width. A pair at cosine 0.95 lies 0.32 apart on the unit sphere and
#: shares a projection's cell with probability 0.87, so it meets in one of the tables with probability 0.995.
TABLES, PROJECTIONS, WIDTH = 18, 10, 2.0
#: Rows of a bucket that one task compares with each other; larger buckets are cut into blocks.
BLOCK = 2048
TILE = 512


class PStable:
    """Quantised Gaussian projections of unit vectors, one 64-bit key per table."""

    def __init__(self, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 11):
        self.tables, self.projections, self.width, self.seed = tables, projections, width, seed
        self.made: dict[int, tuple] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """``(rows, tables)`` bucket keys."""
        dim = unit.shape[1]
        if dim not in self.made:
            draw = np.random.default_rng([self.seed, dim])
            count = self.tables * self.projections
            odd = draw.integers(1, 1 << 62, size=self.projections, dtype=np.int64) * 2 + 1
            self.made[dim] = draw.standard_normal((dim, count)), draw.uniform(0, self.width, count), odd
        planes, shift, odd = self.made[dim]
        cells = np.floor((unit @ planes + shift) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.projections)
        mixed = (cells * odd).sum(axis=2) + dim
        mixed ^= mixed >> 29
        return mixed * np.int64(-4417276706812531889)


def unit_vectors(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their scale."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, by vector length."""
    lists = batch.column("v")
    size = np.diff(lists.offsets.to_numpy())
    starts = lists.offsets.to_numpy()[:-1]
    flat = lists.values.to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[starts[at][:, None] + np.arange(n)[None, :]]


def usable():
    """Whether a row of ``(vec_id, e)`` has an id and a vector with a direction: finite, not empty, not zero."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", lsh: PStable | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Equal vectors are one node with a weight. Nodes that share a bucket in some
    table are compared exactly; a pair counts in the first table in which it
    meets, so links need no deduplication and a bucket gives one count per
    node and a forest of links. Buckets beyond ``BLOCK`` nodes are cut into
    blocks, and every two blocks meet in a task of their own; none is capped.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components
    link with nothing and are their own component; vectors of different length
    are not compared. Rows that share an id are rows of their own in the
    counts. A row without an id links with nothing, its component is NULL and
    it is not kept. An empty table gives an empty table.
    """
    lsh = lsh or PStable()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    marks = {"h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(1), "e")}
    good = rows.where(usable()).withColumn("e", F.transform("e", lambda x: x + 0.0)).withColumns(marks)
    distinct = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.min("e").alias("v"))
    nodes = saved(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # ids may repeat, these numbers do not
    found = saved(bucket_links(nodes.select("node", "weight", "v"), threshold, lsh), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    placed = components(found.where("b is not null").select("a", "b"))
    groups = (
        nodes.select("h1", "h2", "node", "low", "weight")
        .join(counts, "node", "left")
        .join(placed, "node", "left")
        .select("h1", "h2", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    groups = saved(groups, "groups")
    lowest = saved(groups.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    groups = groups.join(lowest, "component").select("h1", "h2", "n_links", "component_id")
    linked = good.select("vec_id", "h1", "h2").join(groups, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def bucket_links(nodes: DataFrame, threshold: float, lsh: PStable) -> DataFrame:
    """Rows ``(a, NULL, n)``: node ``a`` has links to nodes of weight ``n``; rows ``(a, b, 0)``: links that join what is linked."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in _matrices(batch):
                k = lsh.keys(unit_vectors(matrix))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(lsh.tables, dtype=np.int32), len(k))), pa.array(k.ravel())], ["t", "bucket"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _matrices(batch):
                k = lsh.keys(unit_vectors(matrix))
                for t in range(lsh.tables):
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(k[:, t]), *part.columns], ["t", "bucket", *part.schema.names])

    seen = nodes.select("v").mapInArrow(keys, "t int, bucket long").groupBy("t", "bucket").count()
    large = saved(seen.where(F.col("count") > BLOCK).select("t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    rows = nodes.mapInArrow(spread, T.StructType([T.StructField("t", T.IntegerType()), T.StructField("bucket", T.LongType()), *nodes.schema.fields]))
    cut = rows.join(large, ["t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int")
    paired = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = paired.select("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "weight", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("t", "bucket", "i", "j")):
            yield from _links(group, threshold, lsh)

    return tiles.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j", "own", "node").mapInArrow(compare, "a long, b long, n long")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of equal keys with at least two rows, put together over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = np.concatenate([[0], change, [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in columns)
            if key != last:
                if held and sum(x.num_rows for x in held) > 1:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, last = [], key
            held.append(batch.slice(a, b - a))
    if held and sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _links(group: pa.RecordBatch, threshold: float, lsh: PStable) -> Iterator[pa.RecordBatch]:
    t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
    own, node, weight = (group.column(c).to_numpy(zero_copy_only=False) for c in ("own", "node", "weight"))
    for at, matrix in _matrices(group):
        unit = unit_vectors(matrix)
        keys = lsh.keys(unit)[:, :t]
        links = np.zeros(len(at), np.int64)
        lefts, rights = [], []
        left_rows = np.flatnonzero(own[at] == i)
        right_rows = left_rows if i == j else np.flatnonzero(own[at] == j)
        for a in range(0, len(left_rows), TILE):
            tile = left_rows[a : a + TILE]
            p, q = np.nonzero(unit[tile] @ unit[right_rows].T >= threshold)
            p, q = tile[p], right_rows[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for s in range(t):
                apart = keys[p, s] != keys[q, s]
                p, q = p[apart], q[apart]
            np.add.at(links, p, weight[at][q])
            np.add.at(links, q, weight[at][p])
            if len(p):
                label = forest(p, q, len(at))
                far = np.flatnonzero(label != np.arange(len(at)))
                lefts.append(label[far])
                rights.append(far)
        some = np.flatnonzero(links)
        if len(some):
            ids = node[at]
            p, q = np.concatenate(lefts), np.concatenate(rights)
            label = forest(p, q, len(at))
            far = np.flatnonzero(label != np.arange(len(at)))
            a = np.concatenate([ids[some], ids[label[far]]])
            b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[far])])
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[some], np.zeros(len(far), np.int64)]))], ["a", "b", "n"])
