"""Exact substring deduplication: seeds are winnowed anchors, extended to full windows on both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import WordHash, fresh, map_text, saved, short_batches

#: Odd multipliers of the two rolling hashes and of the mixing step.
ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xFF51AFD7ED558CCD
ROWS = 50_000


class Rolling:
    """Hashes of all runs of ``k`` consecutive words from prefix sums modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, factor, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        n = len(words)
        self._powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * self.up[:n], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        grams ^= grams >> np.uint64(33)
        grams *= np.uint64(MIX)
        return grams ^ grams >> np.uint64(29)


class Winnow:
    """Anchors of a text: the smallest hash of half-window runs in each window.

    A window of ``window`` words holds ``window - seed + 1`` runs of ``seed``
    words; the window's anchor is the first smallest of them. It depends on the
    words of the window alone, so equal windows have equal anchors.
    """

    def __init__(self, window: int):
        self.window, self.seed = window, window // 2
        self.hash, self.short, self.long = WordHash(), Rolling(ROLL[0]), Rolling(ROLL[1])

    def anchors(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, their hashes, and the anchor of every window in order of its start."""
        words = (text or b"").split()
        if len(words) < self.window:
            return len(words), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        hashes = self.hash.of(words)
        grams = self.short.grams(hashes, self.seed)
        runs = np.lib.stride_tricks.sliding_window_view(grams, self.window - self.seed + 1)
        return len(words), hashes, grams[np.arange(len(runs)) + runs.argmin(axis=1)]


def marked(docs: DataFrame) -> DataFrame:
    """Two 64-bit hashes of the text: ``mark`` tells apart the texts of one id, both together tell apart all texts."""
    return docs.withColumns({"mark": F.xxhash64("text"), "mark2": F.xxhash64(F.lit(1), "text")})


def seeds(docs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, mark, mark2, n_words, anchors)``; the anchors of a text's windows count once."""
    schema = T.StructType.fromDDL("doc_id long, mark long, mark2 long, n_words long, anchors array<long>")

    winnow = Winnow(window)  # every task has its own copy, which goes with it

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        counts, found = [], []
        for text in texts:
            n, _, anchors = winnow.anchors(text)
            counts.append(n)
            found.append(np.unique(anchors))
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
        return pa.RecordBatch.from_arrays([*map(batch.column, schema.names[:3]), pa.array(counts, pa.int64()), lists], schema.names)

    return map_text(marked(docs.select("doc_id", "text")).select("doc_id", "mark", "mark2", "text"), "text", run, schema)


def extended(docs: DataFrame, window: int) -> DataFrame:
    """``(anchor, window, doc_id, mark, start)`` of the windows around the anchors listed in the column ``shared``."""
    schema = T.StructType.fromDDL("anchor long, window long, doc_id long, mark long, start int")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnow(window)
        for batch in batches:
            rows, held = [], 0
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc_id, mark, shared, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "shared")), texts):
                _, hashes, anchors = winnow.anchors(text)
                anchors = anchors.view(np.int64)
                starts = np.flatnonzero(np.isin(anchors, np.array(shared, dtype=np.int64)))
                whole = winnow.long.grams(hashes, window).view(np.int64)[starts]
                rows.append((anchors[starts], whole, np.full(len(starts), doc_id), np.full(len(starts), mark), starts.astype(np.int32)))
                held += len(starts)
                if held >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "mark", "shared", "text").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """Windows of ``docs(doc_id, text)`` whose words also start in a document with a smaller id.

    Returns the table of :func:`seeds` and ``(doc_id, mark, starts, all)``: the
    first words of those windows, or ``all`` for a text that is repeated as a
    whole. Steps: equal texts count once, by their smallest id; an anchor is
    shared if two ids have it; windows around shared anchors are extended to
    full length and compared as groups, never pair by pair, so a passage of many
    documents costs one row for each place. Groups are told apart by 128 bits.
    """
    found = saved(seeds(docs, window), "seeds")
    texts = found.where(f"n_words >= {window} and doc_id is not null")
    lead = saved(texts.groupBy("mark", "mark2").agg(F.min("doc_id").alias("lead")), "leads")
    again = texts.select("doc_id", "mark", "mark2").join(lead, ["mark", "mark2"]).where("doc_id > lead").select("doc_id", "mark").distinct()
    first = texts.join(lead.select("mark", "mark2", F.col("lead").alias("doc_id")), ["mark", "mark2", "doc_id"])
    places = first.select("doc_id", "mark", F.explode("anchors").alias("anchor"))
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = saved(shared, "anchors")  # a table on either side: the join's large partitions can be split
    wanted = saved(places.join(shared, "anchor").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("shared")), "shared")
    windows = saved(extended(marked(docs.where("doc_id is not null")).join(wanted, ["doc_id", "mark"]), window), "windows")
    lowest = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    lowest = saved(lowest, "lowest")
    starts = windows.join(lowest, ["anchor", "window"]).where("doc_id > low").groupBy("doc_id", "mark").agg(F.collect_set("start").alias("starts"))
    return found, starts.select("doc_id", "mark", "starts", F.lit(False).alias("all")).unionByName(
        again.select("doc_id", "mark", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("all"))
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space.

    A word goes if it lies in a window of ``window`` words that also starts in
    a document with a smaller id; windows are judged on the input. Words are
    runs of bytes other than ASCII white space. NULL and empty texts have no
    words. Rows that share an id are one document for this: they take nothing
    from each other. A row without an id is compared with nothing and keeps
    all. Bytes that are not UTF-8 stay as they are. An empty table gives an
    empty table. Columns called like the new ones are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept")))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    _, repeats = repeated_windows(plain, window)
    key, mark, starts, every = fresh(docs, "repeat_id", "repeat_mark", "repeat_starts", "repeat_all")
    repeats = repeats.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("starts").alias(starts), F.col("all").alias(every))
    joined = docs.join(repeats, (docs[doc_id] == repeats[key]) & (F.xxhash64(docs[text]) == repeats[mark]), "left").drop(key, mark)
    others = docs.columns
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("n_words long, n_removed long, kept string").fields)

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        counts, removed, kept = [], [], []
        for x, at, gone in zip(texts, batch.column(starts), batch.column(every).to_pylist()):
            words = (x or b"").split()
            n = len(words)
            if gone:
                words = []
            elif at.is_valid:
                steps = np.zeros(n + 1, dtype=np.int64)
                begin = at.values.to_numpy()
                np.add.at(steps, begin, 1)
                np.add.at(steps, begin + window, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:n]) == 0)]
            counts.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words))
        bytes_kept = pa.array(kept, pa.binary()).view(pa.string())  # the bytes of the text as they are, also where they are not UTF-8
        columns = [batch.column(c) for c in others] + [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), bytes_kept]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return map_text(joined, text, run, schema)
