"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm import minhash
from pluvion.llm.base import forest, forget, map_text, representatives, saved
from pluvion.llm.components import components

SHINGLE_BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    size = min(words, len(parts))
    line = b" ".join(parts)
    ends = list(accumulate(parts, lambda end, word: end + 1 + len(word), initial=-1))
    counts = np.zeros(64, dtype=np.int64)
    total = len(parts) - size + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SHINGLE_BLOCK):
        stop = min(total, at + SHINGLE_BLOCK)
        hashes = np.fromiter((digest(line[ends[i] + 1 : ends[i + size]], seed) for i in range(at, stop)), "<u8", stop - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without its text and with its fingerprint as a signed long.

    A-Z are lower-cased and words are runs of bytes other than ASCII white
    space. NULL and empty texts have fingerprint zero.
    """
    others = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(out, T.LongType())])

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        marks = np.array([fingerprint(x, words, seed) for x in texts], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(marks)], others + [out])

    return map_text(docs.select(*others, text), text, run, schema)


def masks(bits: int, flips: int) -> np.ndarray:
    """All words of ``bits`` bits with at most ``flips`` bits set, fewest first."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


def ball_links(marks: DataFrame, radius: int = 4, head: int = 12) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints ``mark`` (distinct longs) within ``radius`` bits of each other.

    Every fingerprint has a ball of variants within half the radius. Two
    fingerprints within the radius share a variant, and two that share one are
    within the radius. Variants are shuffled by their first ``head`` bits: a
    fingerprint goes once to every head its ball touches, and the task of that
    head writes out the rest of the ball. Fingerprints of one variant are
    linked to the smallest, checked bit by bit, and thinned to a forest, so
    groups of any size give links in proportion to their members.
    """
    if radius % 2:
        raise ValueError("the radius must be even: both sides reach half of it")
    half = radius // 2
    head = max(head, math.ceil(math.log2(max(1, marks.count()) / 16_000)))
    tail = 64 - head
    flips = F.explode(F.array(*[F.lit(int(m)).cast("long") for m in masks(head, half)]))
    spread = marks.select("mark", flips.alias("flip")).select(F.shiftrightunsigned("mark", tail).bitwiseXOR(F.col("flip")).alias("head"), "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = [masks(tail, half - used) for used in range(half + 1)]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            top, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(top):
                continue
            held.append((top, mark))
            if held[0][0][0] == top[-1]:
                continue
            top, mark = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(top, top[-1])
            held = [(top[cut:], mark[cut:])]
            yield _linked(top[:cut], mark[:cut], tails, tail, radius)
        if held:
            top, mark = (np.concatenate(x) for x in zip(*held))
            yield _linked(top, mark, tails, tail, radius)

    return spread.repartition("head").sortWithinPartitions("head", "mark").mapInArrow(run, "a long, b long").distinct()


def _linked(top: np.ndarray, mark: np.ndarray, tails: list[np.ndarray], tail: int, radius: int) -> pa.RecordBatch:
    """A forest over the fingerprints of whole heads that share a variant."""
    own = mark.view(np.uint64)
    top = top.astype(np.uint64)
    used = np.bitwise_count((own >> np.uint64(tail)) ^ top)
    base = (top << np.uint64(tail)) | (own & np.uint64((1 << tail) - 1))
    balls, rows = [], []
    for k, flips in enumerate(tails):
        at = np.flatnonzero(used == k)
        balls.append((base[at][:, None] ^ flips[None, :]).ravel())
        rows.append(np.repeat(at, len(flips)))
    variant, row = np.concatenate(balls), np.concatenate(rows)
    order = np.argsort(variant)
    variant, row = variant[order], row[order]
    same = np.flatnonzero(variant[1:] == variant[:-1])
    lefts, rights = row[same], row[same + 1]
    near = np.bitwise_count(own[lefts] ^ own[rights]) <= radius
    lefts, rights = lefts[near], rights[near]
    if not len(lefts):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    nodes, place = np.unique(mark[np.concatenate([lefts, rights])], return_inverse=True)
    label = forest(place[: len(lefts)], place[len(lefts) :], len(nodes))
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[label[far]]), pa.array(nodes[far])], ["a", "b"])


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row; the component is the smallest id reachable over links.

    Equal texts have equal fingerprints and are one node of the graph, so
    groups of copies are never expanded. Rows without an id keep their
    fingerprint and take the component of its rows with ids (NULL if there are
    none); a fingerprint that only such rows have links nothing. Repeated rows
    stay, an empty table gives an empty table.
    """
    marked = saved(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words), "fingerprints")
    nodes = saved(marked.where("doc_id is not null").groupBy(F.col("fingerprint").alias("mark")).agg(F.min("doc_id").alias("node")), "marks")
    links = ball_links(nodes.select("mark"), radius)
    ends = (
        links.join(nodes.select(F.col("mark").alias("a"), F.col("node").alias("na")), "a")
        .join(nodes.select(F.col("mark").alias("b"), F.col("node").alias("nb")), "b")
        .select(F.col("na").alias("a"), F.col("nb").alias("b"))
    )
    found = components(ends)
    placed = nodes.join(found, "node", "left").select(F.col("mark").alias("fingerprint"), F.coalesce("component", "node").alias("component_id"))
    return marked.join(placed, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def key_links(docs: DataFrame, nodes: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """Links ``(a, b)`` of the keys of ``nodes(key, doc_id, text_mark)`` whose texts in ``docs`` have fingerprints within ``radius`` bits.

    Keys of one fingerprint are linked to the smallest, which stands for it in the ball search.
    """
    prints = saved(fingerprints(docs.select("doc_id", "text_mark", "text"), words=words), "fingerprints")
    marked = saved(prints.join(nodes, ["doc_id", "text_mark"]).select("key", "fingerprint").distinct(), "marked")
    forget(prints)
    marks = saved(marked.groupBy("fingerprint").agg(F.min("key").alias("node")), "marks")
    same = marked.join(marks, "fingerprint").where("key <> node").select(F.col("node").alias("a"), F.col("key").alias("b"))
    links = ball_links(marks.select(F.col("fingerprint").alias("mark")), radius)
    ends = (
        links.join(marks.select(F.col("fingerprint").alias("a"), F.col("node").alias("na")), "a")
        .join(marks.select(F.col("fingerprint").alias("b"), F.col("node").alias("nb")), "b")
        .select(F.col("na").alias("a"), F.col("nb").alias("b"))
    )
    made = saved(same.union(ends), "links")
    forget(marked)
    forget(marks)
    return made


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4, least: float | None = None
) -> DataFrame:
    """The row with the smallest id of each near-duplicate group, columns unchanged.

    Groups are made of fingerprints, so rows that share an id but not a group
    stand for themselves; in one group they count once, by the smallest text
    hash. Rows without an id belong to no group and stay.

    With ``least`` a link counts only if the exact Jaccard similarity of the
    word shingles is at least that, and pairs that similar whose fingerprints
    lie further apart are linked too (see :mod:`minhash`).
    """
    if least is not None:
        return minhash.deduplicate(docs, doc_id, text, words, least, lambda texts, nodes: key_links(texts, nodes, radius, words))
    plain = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_mark"), F.col(text).alias("text"))
    marked = saved(fingerprints(plain, words=words), "fingerprints")
    found = components(ball_links(marked.select(F.col("fingerprint").alias("mark")).distinct(), radius))
    placed = marked.join(found, marked["fingerprint"] == found["node"], "left").withColumn("component", F.coalesce("component", "fingerprint"))
    keep = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_mark")).alias("first")).select("first.doc_id", "first.text_mark")
    return representatives(docs, keep, doc_id, text)
