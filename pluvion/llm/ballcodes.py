"""Vector code compression: product codes whose codebooks are trained by ball k-means on whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import forget, saved, short_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components stop here.
FURTHEST = 1 << 62
#: Below this size squared distances of up to 2^5 components and their sums are exact in 64 bits; beyond, Python's own integers are used.
NARROW = 1 << 20


class Codebook:
    """Entries of one part position, with each entry's other entries in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = entries[:, None, :] - entries[None, :, :]
        self.between = (apart * apart).sum(axis=2)
        self.order = np.argsort(self.between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.between, self.order, axis=1)

    def distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = x - self.entries[at]
        return (apart * apart).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every row, ties to the lower index, against all entries."""
        best = np.zeros(len(x), np.int64)
        least = self.distances(x, best)
        for j in range(1, len(self.entries)):
            found = self.distances(x, np.full(len(x), j))
            closer = found < least
            best[closer], least[closer] = j, found[closer]
        return best, least

    def move(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same as :meth:`nearest` for rows that were at the entries ``held``, by ball k-means.

        The rows at an entry form a ball; another entry is a neighbour if it is
        no farther from the ball's centre than twice its radius. A row whose
        distance to its entry is below half the distance to the entry's first
        neighbour lies in the stable core and stays. The other rows lie in rings
        between the half distances to one neighbour and the next: only the
        neighbours up to its ring can be as near to a row as its own entry.
        """
        best, least = held.copy(), self.distances(x, held)
        own = np.argsort(held, kind="stable")
        edges = np.searchsorted(held[own], np.arange(len(self.entries) + 1))
        rings = np.ones(len(x), np.int64)
        for i in range(len(self.entries)):
            ball = own[edges[i] : edges[i + 1]]
            if len(ball):
                reach = 4 * least[ball]
                neighbours = self.sorted[i][: np.searchsorted(self.sorted[i], reach.max(), side="right")]
                rings[ball] = np.searchsorted(neighbours, reach, side="right")
        outside = np.flatnonzero(rings > 1)
        outside = outside[np.argsort(-rings[outside], kind="stable")]
        inner = rings[outside]
        points, centre = x[outside], held[outside]
        near, nearest = best[outside], least[outside]
        for t in range(int(inner[0]) if len(inner) else 0):
            n = int(np.searchsorted(-inner, -t, side="left"))
            j = self.order[centre[:n], t]
            found = self.distances(points[:n], j)
            closer = (found < nearest[:n]) | ((found == nearest[:n]) & (j < near[:n]))
            near[:n][closer], nearest[:n][closer] = j[closer], found[closer]
        best[outside], least[outside] = near, nearest
        return best, least


def codebooks(entries: np.ndarray) -> list[Codebook]:
    """A codebook per part of ``(parts, entries, components)``."""
    return [Codebook(part) for part in entries]


def narrowed(matrix: np.ndarray, *others: np.ndarray) -> bool:
    """Whether 64-bit arithmetic is exact for these whole numbers."""
    return all(not m.size or int(np.abs(m).max()) < NARROW for m in (matrix, *others)) and matrix.shape[-1] <= 32


def encode(matrix: np.ndarray, entries: np.ndarray, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(rows, parts)`` and the squared distances summed over the parts; ``held`` are the codes of the round before."""
    parts = len(entries)
    cut = matrix.reshape(len(matrix), parts, -1)
    kind = np.int64 if narrowed(cut, entries) else object
    cut, books = cut.astype(kind), codebooks(entries.astype(kind))
    codes = np.zeros((len(matrix), parts), np.uint8)
    error = np.zeros(len(matrix), kind)
    for p, book in enumerate(books):
        x = np.ascontiguousarray(cut[:, p, :])
        found, least = book.nearest(x) if held is None else book.move(x, held[:, p].astype(np.int64))
        codes[:, p] = found
        error += least
    return codes, np.minimum(error, 2**63 - 1).astype(np.int64)


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v)`` with ``v`` as ``floor(256 x)``; vectors that are NULL, empty or hold NULL or non-finite components are left out."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floored = F.transform("e", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(FURTHEST)), F.lit(-FURTHEST)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e"))
    return rows.where((F.size("e") > 0) & finite).select("vec_id", "label", floored.alias("v"))


def assigned(rows: DataFrame, entries: np.ndarray, last: bool = False) -> DataFrame:
    """``rows(vec_id, label, v[, code])`` with new codes; the last assignment has ``error`` and no vectors."""
    again = "code" in rows.columns
    names = ["vec_id", "label"] + ([] if last else ["v"])
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    dim = entries.shape[0] * entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            held = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1) if again else None
            codes, error = encode(matrix, entries, held)
            made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, schema.names)

    short_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def part_sums(rows: DataFrame, entries: np.ndarray) -> list[tuple]:
    """``(part, entry, count, sums)`` of the vectors at each entry; a task adds up its own rows first."""
    parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, size), np.int64)
        sums = np.zeros((parts, size, width), object)
        at = np.arange(parts)[None, :]
        for batch in batches:
            matrix = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            part = np.zeros((parts, size, width), np.int64 if narrowed(matrix) else object)
            np.add.at(part, (at, codes), matrix if part.dtype != object else matrix.astype(object))
            np.add.at(counts, (at, codes), 1)
            sums += part.astype(object)
        p, e = np.nonzero(counts)
        told = pa.array([[str(v) for v in sums[i, j]] for i, j in zip(p, e)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), told], ["part", "entry", "n", "sums"])

    short_batches(rows.sparkSession)
    told = rows.select("v", "code").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    added = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    return [(r[0], r[1], r[2], [int(x) for x in r[3:]]) for r in told.groupBy("part", "entry").agg(F.sum("n"), *added).collect()]


def train_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """``(vec_id, label, code, error)`` of every kept vector, with one byte a part, and the final codebooks ``(parts, entries, components)``.

    The codebooks start as the parts of the ``entries`` (at most 256) smallest
    ids; each round assigns and then moves the entries to the floors of their
    means, unused ones stay. Only codebooks and their sums reach the driver.
    Codes of the round before are kept beside the vectors, so that rows in
    stable cores are not compared again.

    Rows that repeat an id are rows of their own, in order of their vectors.
    Rows without an id are left out, as are vectors of another length than
    that of the smallest id. If that length cannot be cut into ``parts`` equal
    parts, or no vector is left, nothing is coded and the codebooks are None.
    Components stop at 2^62 in size.
    """
    rows = whole_vectors(vectors, vec_id, embedding, label).where("vec_id is not null")
    first = rows.select("vec_id", "v").orderBy("vec_id", "v").limit(1).collect()
    dim = len(first[0].v) if first else 0
    rows = saved(rows.where(F.size("v") == dim), "vectors")
    if not dim or dim % parts:
        kind = rows.schema["label"].dataType
        fields = [T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
        return rows.sparkSession.createDataFrame([], T.StructType(fields)), None
    start = [r.v for r in rows.select("vec_id", "v").orderBy("vec_id", "v").limit(entries).collect()]
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        moved = saved(assigned(rows, books).drop("error"), "codes")
        forget(rows)
        rows, books = moved, _moved(books, part_sums(moved, books))
    return assigned(rows, books, last=True), books


def _moved(books: np.ndarray, sums: list[tuple]) -> np.ndarray:
    out = books.astype(object)
    for part, entry, n, total in sums:
        out[part, entry] = [s // n for s in total]
    return out.astype(np.int64)


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)``: codes as text with the error of each row and of all rows of its label.

    NULL labels are a label of their own. Errors stop at the end of 64 bits.
    See :func:`train_codes` for what is left out; an empty table gives an empty table.
    """
    coded, books = train_codes(vectors, vec_id=vec_id, embedding=embedding, label=label)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() if books is not None else ""
    coded = saved(coded, "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    labels = saved(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label_errors")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
