"""Near-duplicates by min-wise hashing: bands that collide, then the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import WordHash, forget, representatives, saved, short_batches
from pluvion.llm.components import components

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9998 at 0.8.
BANDS, ROWS = 16, 4
#: Shingles that are hashed at a time.
BLOCK = 1 << 12

_DRAW = np.random.default_rng(5)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _DRAW.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, hashes: WordHash, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run, one without words has none.

    A-Z are lower-cased and words are runs of bytes other than ASCII white space.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    size = min(words, len(parts))
    each, total = hashes.of(parts), len(parts) - size + 1
    runs = np.full(total, size, dtype=np.uint64)
    for k in range(size):
        runs += each[k : k + total] * _PLACES[k]
    return np.unique(_mixed(runs))


def bands(found: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of the smallest hashes under ``BANDS * ROWS`` permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (found[None, at : at + BLOCK] * _FACTORS[:, None]).min(axis=1), out=least)
    parts = _mixed(least).reshape(BANDS, ROWS) * _PLACES[:ROWS]
    return _mixed(parts.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, text_mark, key, n, bands)`` of ``docs(doc_id, text_mark, text)``; texts of the same shingles have the same key."""
    schema = T.StructType.fromDDL("doc_id long, text_mark long, key long, n int, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(17)
        for batch in batches:
            keys, sizes, marks = [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                found = shingles(text, hashes, words)
                keys.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sizes.append(len(found))
                marks.append(bands(found).view(np.int64))
            flat = np.concatenate(marks) if marks else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            made = [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_mark"), *made], schema.names)

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text_mark", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``(key, members)`` of ``docs(key, text)``: the hashes of :func:`shingles` as bytes."""
    schema = T.StructType.fromDDL("key long, members binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(17)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            sets = pa.array([shingles(x, hashes, words).tobytes() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), sets], schema.names)

    short_batches(docs.sparkSession)
    return docs.select("key", "text").mapInArrow(run, schema)


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a Jaccard similarity of at least ``least``."""
    left = sets.select(F.col("key").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("key").alias("b"), F.col("members").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    short_batches(pairs.sparkSession)
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def prefixes(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(token, key, n, pos, index)``: the rarest shingles of each open key, enough of them to meet every partner.

    Shingles are ordered by how many open keys hold them. Two sets of similarity
    ``least`` share one among the first ``n - least n + 1`` of the larger and the
    first ``n - 2 least / (1 + least) n + 1`` of the smaller; the latter rows
    have ``index``. Shingles of one key only are counted, not listed.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("members")]
            keys = np.repeat(batch.column("key").to_numpy(), [len(x) for x in found])
            tokens = np.concatenate(found) if found else np.empty(0, np.int64)
            for at in range(0, len(tokens), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 18)]), pa.array(tokens[at : at + (1 << 18)])], ["key", "token"])

    short_batches(sets.sparkSession)
    tokens = sets.join(open_, "key", "left_semi").select("key", "members").mapInArrow(spread, "key long, token long")
    counts = saved(tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "counts")
    ordered = tokens.join(counts, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    length = lambda share: F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1
    listed = F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), length(least) - alone).cast("int"))).alias("at", "s")
    rows = ordered.join(open_.select("key", "n"), "key").select("key", "n", alone.alias("alone"), listed).withColumn("pos", (F.col("alone") + F.col("at")).cast("int"))
    made = saved(rows.select("s.token", "key", "n", "pos", (F.col("pos") < length(2 * least / (1 + least))).alias("index")), "prefixes")
    forget(counts)
    return made


#: Makes links ``(a, b)`` of keys to be checked from ``docs(doc_id, text_mark, text)`` and ``nodes(key, doc_id, text_mark)``.
Offer = Callable[[DataFrame, DataFrame], DataFrame]


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8, offer: Offer | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes(key, doc_id, text_mark)`` with the first row of each set of shingles, and ``(node, component)`` of the linked keys.

    ``docs`` has ``doc_id``, ``text_mark`` and ``text``. Keys that share a
    bucket (the number of a band) are compared with its smallest key. Keys of
    buckets that hold more than one component after that are open: they go on
    by their rarest shingles (:func:`prefixes`). Those that share one are
    compared with the key that has it first of all, which is near the text the
    others were copied from, and then, where their components still differ and
    the positions of the shingle allow the similarity, with each other. So the
    pairs grow with the shared rare shingles, not with the square of a bucket,
    and no pair of open keys is left out. Links that ``offer`` makes are checked
    along with the first pairs.
    """
    marked = saved(sketches(docs, words), "sketches")
    nodes = saved(
        marked.groupBy("key").agg(F.min(F.struct("doc_id", "text_mark")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .select("key", "first.doc_id", "first.text_mark", "n", "bands"),
        "nodes",
    )
    forget(marked)
    places = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    shared = saved(places.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("low"), F.max("key").alias("high")).where("low.key < high").drop("high"), "buckets")
    members = saved(places.join(shared, "bucket"), "members")
    forget(shared)
    offered = saved(offer(docs, nodes.select("key", "doc_id", "text_mark")), "offered") if offer else None
    touched = members.select("key")
    if offered is not None:
        touched = touched.union(offered.select("a")).union(offered.select("b"))
    wanted = nodes.join(touched.distinct(), "key").select("key", "doc_id", "text_mark")
    texts = docs.join(wanted, ["doc_id", "text_mark"]).dropDuplicates(["doc_id", "text_mark"])
    sets = saved(shingle_sets(texts, words), "sets")
    close = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    tables = []

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        held = saved(both, "pairs")
        tables.append(saved(similar(held, sets, least), "near"))
        forget(held)
        return tables[-1]

    def labelled(rows: DataFrame, by: str, links: DataFrame) -> DataFrame:
        """``rows`` of those values of ``by`` that hold more than one component, with it; tables on either side, so that large partitions can be split."""
        found = components(links)
        placed = rows.join(found, rows["key"] == found["node"], "left").withColumn("label", F.coalesce("component", "key")).drop("node", "component")
        placed = saved(placed, "labels")
        mixed = saved(placed.groupBy(by).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(by), "mixed")
        forget(found)
        tables.extend([placed, mixed])
        return placed.join(mixed, by)

    first = members.where("key <> low.key").where(close("n", "low.n"))
    pairs = first.select(F.col("key").alias("a"), F.col("low.key").alias("b"))
    links = checked(pairs if offered is None else pairs.union(offered))
    if offered is not None:
        forget(offered)
    open_ = saved(labelled(members, "bucket", links).select("key", "n").distinct(), "open")
    forget(members)
    rare = prefixes(open_, sets, least)
    rest = labelled(rare, "token", links)
    hubs = saved(rest.where("index").groupBy("token").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("at"), "key", "n", "label")).alias("hub")), "hubs")
    tables.extend([open_, rare, hubs])
    spokes = rest.join(hubs, "token").where("label <> hub.label").where(close("n", "hub.n"))
    links = links.union(checked(spokes.select(F.col("key").alias("a"), F.col("hub.key").alias("b"))))
    rest = saved(labelled(rare, "token", links), "rest")
    tables.append(rest)
    x, y = rest.where("index").alias("x"), rest.alias("y")
    ahead = F.expr("x.n < y.n or (x.n = y.n and x.key < y.key)") & F.expr("x.label <> y.label")
    after = 1 + F.least(F.expr("x.n - x.pos - 1"), F.expr("y.n - y.pos - 1")) >= least / (1 + least) * F.expr("x.n + y.n") - 1e-9
    each = x.join(y, (F.col("x.token") == F.col("y.token")) & ahead & close("x.n", "y.n") & after)
    links = links.union(checked(each.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))))
    found = components(links)
    for done in [sets, *tables]:
        forget(done)
    return nodes.select("key", "doc_id", "text_mark"), found


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, offer: Offer | None = None
) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates, columns unchanged.

    Texts are linked from a Jaccard similarity of ``least`` on; those without
    words, NULL and empty ones too, are one group. Of rows that share this id
    the smallest text hash stays. Rows without an id belong to no group and
    stay. Texts of any length are hashed whole, other columns may have any
    name, an empty table gives an empty table.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_mark"), F.col(text).alias("text"))
    nodes, found = near_groups(plain.where("doc_id is not null"), words, least, offer)
    placed = nodes.join(found, nodes["key"] == found["node"], "left").withColumn("component", F.coalesce("component", "key"))
    keep = saved(placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_mark")).alias("first")).select("first.doc_id", "first.text_mark"), "keep")
    forget(nodes)
    forget(found)
    return representatives(docs, keep, doc_id, text)
