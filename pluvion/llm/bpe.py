"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pluvion.llm.base import map_text

#: Pre-tokens kept with their ids (twice so many, as the last filling stays), but none of so many characters.
CACHE = 120_000
LONG_TOKEN = 1 << 10
#: Characters from which a text is split bit by bit, and pre-tokens held as a list.
LONG_TEXT = 1 << 20
HELD_TOKENS = 500_000
#: Bytes of new pre-tokens that share a queue, and bytes from which one has a queue of its own.
MERGE_BYTES = 1 << 20
LONG_PIECE = 64
#: Stands between pieces; no token has this id.
EDGE = (1 << 31) - 1


class RankQueue:
    """Positions bucketed by merge rank; a bitmap of two levels over the ranks finds the lowest filled bucket.

    A bit of ``top`` tells whether a word of ``words`` has a bit set, and a bit
    of a word whether the bucket of a rank is filled, so the first rank is found
    with two find-first-sets. Words have about as many bits as there are words.
    """

    def __init__(self, ranks: int):
        self.shift = (ranks.bit_length() + 1) // 2
        self.low = (1 << self.shift) - 1
        self.words = [0] * ((ranks >> self.shift) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self._fill(rank, position)

    def add(self, rank: int, positions: np.ndarray) -> None:
        """Put an array of positions into a bucket that :meth:`take` empties as a whole."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
        else:
            self._fill(rank, positions)

    def _fill(self, rank: int, entry) -> None:
        self.buckets[rank] = [entry]
        word = rank >> self.shift
        self.words[word] |= 1 << (rank & self.low)
        self.top |= 1 << word

    def first(self) -> int | None:
        """The lowest rank whose bucket is filled."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        return word << self.shift | (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> np.ndarray:
        """All positions of a bucket in order; the bucket is gone then."""
        bucket = self.buckets[rank]
        self.drop(rank)
        return np.sort(np.concatenate(bucket)) if len(bucket) > 1 else bucket[0]

    def drop(self, rank: int) -> None:
        """Take a bucket out of the bitmap."""
        del self.buckets[rank]
        word = rank >> self.shift
        self.words[word] ^= 1 << (rank & self.low)
        if not self.words[word]:
            self.top ^= 1 << word

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank."""
        rank = self.first()
        if rank is None:
            return None
        position = heappop(self.buckets[rank])
        if not self.buckets[rank]:
            self.drop(rank)
        return rank, position


class BytePairs(dict):
    """Ranks of a ``.tiktoken`` file and the pattern that splits texts before the merges.

    As a dictionary it holds the packed ids of pre-tokens met lately (little-endian
    unsigned 32-bit integers). Beyond ``CACHE`` of them it starts anew, and those of
    the last filling are looked up before anything is merged again.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.vocabulary = {i: token for token, i in self.ranks.items()}
        self.queue = RankQueue(max(self.vocabulary))
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([i])] for i in range(256)])

    @cached_property
    def joins(self) -> dict[int, int]:
        """Rank by ``left << 32 | right`` for each way to cut a token into two others; other pairs never merge."""
        rank_of = self.ranks.get
        return {
            left << 32 | right: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := rank_of(token[:cut])) is not None and (right := rank_of(token[cut:])) is not None
        }

    @cached_property
    def sorted_joins(self) -> tuple[np.ndarray, np.ndarray]:
        """:attr:`joins` as sorted keys and their ranks; the last key is above all others."""
        keys = np.fromiter([*self.joins, np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        return keys[order], np.fromiter([*self.joins.values(), -1], np.int64)[order]

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair of tokens merges into, or -1."""
        keys, ranks = self.sorted_joins
        wanted = left << 32 | right
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, ranks[at], -1)

    def _enqueue(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put positions whose pair has a rank into the buckets."""
        has = ranks >= 0
        ranks, positions = ranks[has], positions[has]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
            self.queue.add(rank, positions[a:b])

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token: lowest rank first, leftmost first among equals.

        All pieces share one queue and one linked list of positions, with an
        ``EDGE`` between them that joins with nothing. A turn takes the lowest
        bucket and merges its leftmost position in each piece; the others go back,
        so each piece is merged as if it were alone. A merge leaves its neighbours'
        old queue entries behind; they are stale, as the pair at that position now
        has another rank, and are skipped when they come up.
        """
        queue = self.queue
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)])
        inside = np.ones(edges[-1] + 1, bool)
        inside[edges] = False
        owner = np.cumsum(~inside)
        tokens = np.full(len(inside), EDGE)
        tokens[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, len(tokens) + 1)
        before = np.arange(-1, len(tokens) - 1)
        pair = np.append(self._join(tokens[:-1], tokens[1:]), -1)
        self._enqueue(pair, np.arange(len(pair)))
        while (rank := queue.first()) is not None:
            i = queue.take(rank)
            i = i[pair[i] == rank]
            if not len(i):
                continue
            if len(i) > 1:
                own = owner[i]
                again = np.append(False, own[1:] == own[:-1])
                if again.any():
                    queue.add(rank, i[again])
                    i = i[~again]
            j = after[i]
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            pair[j] = tokens[j] = -1
            tokens[i] = rank
            changed = np.concatenate([h, i])
            ranks = pair[changed] = self._join(tokens[changed], tokens[np.concatenate([i, k])])
            self._enqueue(ranks, changed)
        live = inside & (tokens >= 0)
        packed = tokens[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live)[edges]).tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def merge_long(self, piece: bytes) -> bytes:
        """As :meth:`merge`, for one long pre-token: position by position, in time n log n."""
        join, queue = self.joins.get, self.queue
        tokens = [*self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), EDGE, EDGE]
        n = len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n + 1))
        pair = [join(a << 32 | b, -1) for a, b in zip(tokens, tokens[1:])]
        for i, rank in enumerate(pair):
            if rank >= 0:
                queue.push(rank, i)
        while (found := queue.pop()) is not None:
            rank, i = found
            if pair[i] != rank:
                continue
            j, h = after[i], before[i]
            k = after[i] = after[j]
            before[k] = i
            pair[j], tokens[j], tokens[i] = -1, -1, rank
            for at, key in ((h, tokens[h] << 32 | rank), (i, rank << 32 | tokens[k])):
                if at >= 0:
                    pair[at] = join(key, -1)
                    if pair[at] >= 0:
                        queue.push(pair[at], at)
        return np.array([t for t in tokens[:n] if t >= 0], dtype="<u4").tobytes()

    def learn(self, tokens: set[str]) -> None:
        """Keep the packed ids of pre-tokens that are not kept yet, merging about ``MERGE_BYTES`` at once."""
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        held, size = [], 0
        for token in tokens:
            if token in self or token in self.older:
                continue
            piece = token.encode("utf-8")
            whole = self.ranks.get(piece)
            if whole is not None:
                self[token] = struct.pack("<I", whole)
                continue
            if len(piece) >= LONG_PIECE:
                self[token] = self.merge_long(piece)
                continue
            held.append((token, piece))
            size += len(piece)
            if size >= MERGE_BYTES:
                self.update(zip((t for t, _ in held), self.merge([p for _, p in held])))
                held, size = [], 0
        if held:
            self.update(zip((t for t, _ in held), self.merge([p for _, p in held])))

    def __missing__(self, token: str) -> bytes:
        packed = self[token] = self.older[token]
        return packed

    def split(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text in lists, so that a very long text is never held as a whole list of them."""
        if len(text) < LONG_TEXT:
            yield self.pattern.findall(text)
            return
        matches = (match.group() for match in self.pattern.finditer(text))
        while part := list(islice(matches, HELD_TOKENS)):
            yield part

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for row, text in enumerate(texts):
            for part in self.split(text):
                held.append((row, part))
                size += len(part)
                if size >= HELD_TOKENS:
                    self._pack(held, out)
                    held, size = [], 0
        self._pack(held, out)
        return [b"".join(parts) for parts in out]

    def _pack(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        tokens = set().union(*(part for _, part in held))
        self.learn(tokens)
        for row, part in held:
            out[row].append(b"".join(map(self.__getitem__, part)))
        for token in tokens:
            if len(token) >= LONG_TOKEN:
                self.pop(token, None)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One coder per worker; every worker reads the vocabulary file by its own path."""
    return BytePairs(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``: token ids as packed little-endian unsigned 32-bit integers.

    NULL and empty texts give no ids. Repeated rows stay, other columns pass
    through, a column called like ``ids`` is replaced, and an empty table gives
    an empty table. Long pre-tokens take time n log n. Bytes that are not UTF-8
    count as U+FFFD.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == ids.lower()))

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        coder = byte_pairs(path, pattern)
        packed = coder.encode_all([x.decode("utf-8", "replace") if x else "" for x in texts])
        return batch.append_column(ids, pa.array(packed, pa.binary()))

    return map_text(docs, text, run, T.StructType(docs.schema.fields + [T.StructField(ids, T.BinaryType())]))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the column ``out``: the bytes that the ids stand for (NULL ids: none)."""
    tokens = tokens.drop(out) if out in tokens.columns else tokens

    def run(batch: pa.RecordBatch, packed: list) -> pa.RecordBatch:
        coder = byte_pairs(path, pattern)
        return batch.append_column(out, pa.array([coder.decode(x) if x else b"" for x in packed], pa.binary()))

    return map_text(tokens, ids, run, T.StructType(tokens.schema.fields + [T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` without its text, with the columns of :func:`encode` and :func:`decode`, in one pass.

    Both steps share one worker and one vocabulary; the decoder sees nothing
    but the packed ids. Cases are those of the two functions.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (ids.lower(), out.lower())))
    others = [c for c in docs.columns if c != text]
    fields = [docs.schema[c] for c in others] + T.StructType.fromDDL("i binary, d binary").fields
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip([*others, ids, out], fields)])

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        coder = byte_pairs(path, pattern)
        packed = coder.encode_all([x.decode("utf-8", "replace") if x else "" for x in texts])
        made = [pa.array(packed, pa.binary()), pa.array(list(map(coder.decode, packed)), pa.binary())]
        return pa.RecordBatch.from_arrays([*map(batch.column, others), *made], schema.names)

    return map_text(docs, text, run, schema)
