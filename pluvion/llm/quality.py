"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pluvion.llm.base import map_text
from pluvion.llm.labelled import labelled_texts

#: The symbol after the 256 bytes fills chunks that end early.
PAD = 256
#: Bounds of the sample that the network is fitted on.
LABELLED_ROWS, LABELLED_BYTES = 3000, 12_000
CHUNKS_AT_ONCE = 48


class ByteNet:
    """Filters over byte windows, max-pooled per chunk; chunk peaks give one probability per text.

    Chunks of ``chunk`` bytes start every ``step`` bytes and overlap by more than a
    filter's width, so each window of the text lies in some chunk. The text is
    described by the largest, mean and smallest chunk peak of every filter.
    """

    def __init__(self, width: int = 8, dim: int = 4, filters: int = 24, hidden: int = 16, chunk: int = 256, step: int = 240, seed: int = 5):
        draw = np.random.default_rng(seed)
        normal = lambda *shape: draw.standard_normal(shape).astype(np.float32)
        self.width, self.dim, self.filters, self.chunk, self.step = width, dim, filters, chunk, step
        self.weights = {
            "bytes": normal(257, dim) * 0.5,
            "conv": normal(width * dim, filters) / np.float32(np.sqrt(width * dim)),
            "conv_bias": np.zeros(filters, np.float32),
            "hidden": normal(3 * filters, hidden) / np.float32(np.sqrt(3 * filters)),
            "hidden_bias": np.zeros(hidden, np.float32),
            "out": normal(hidden) / np.float32(np.sqrt(hidden)),
            "out_bias": np.zeros(1, np.float32),
        }

    def chunks(self, text: bytes) -> np.ndarray:
        """``(chunks, chunk)`` byte symbols; an empty text is one chunk of filling."""
        n = len(text)
        count = 1 + max(0, -(-(n - self.chunk) // self.step))
        symbols = np.full((count - 1) * self.step + self.chunk, PAD, dtype=np.uint16)
        symbols[:n] = np.frombuffer(text, np.uint8)
        return np.lib.stride_tricks.as_strided(symbols, (count, self.chunk), (self.step * 2, 2))

    def peaks(self, chunks: np.ndarray, where: bool = False):
        """Largest filter response per chunk, and the place of it if asked for."""
        w, size = self.weights, self.chunk - self.width + 1
        out = np.empty((len(chunks), self.filters), np.float32)
        at = np.empty((len(chunks), self.filters), np.int32) if where else None
        for i in range(0, len(chunks), CHUNKS_AT_ONCE):
            vectors = w["bytes"][chunks[i : i + CHUNKS_AT_ONCE]]
            rows = len(vectors)
            windows = np.lib.stride_tricks.as_strided(
                vectors, (rows, size, self.width * self.dim), (vectors.strides[0], vectors.strides[1], vectors.strides[2])
            )
            found = (windows.reshape(rows * size, -1) @ w["conv"]).reshape(rows, size, self.filters)
            if where:
                at[i : i + rows] = found.argmax(axis=1)
            out[i : i + rows] = found.max(axis=1)
        return np.maximum(out + w["conv_bias"], 0), at

    def describe(self, texts: list[bytes], where: bool = False):
        parts = [self.chunks(x) for x in texts]
        first = np.cumsum([0] + [len(p) for p in parts])
        chunks = np.concatenate(parts)
        peaks, at = self.peaks(chunks, where)
        high = np.maximum.reduceat(peaks, first[:-1])
        low = np.minimum.reduceat(peaks, first[:-1])
        mean = np.add.reduceat(peaks, first[:-1]) / np.diff(first)[:, None].astype(np.float32)
        return np.concatenate([high, mean, low], axis=1), (chunks, peaks, at, first)

    def logits(self, described: np.ndarray):
        w = self.weights
        inner = np.maximum(described @ w["hidden"] + w["hidden_bias"], 0)
        return inner @ w["out"] + w["out_bias"][0], inner

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 per text."""
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.logits(self.describe(texts)[0])[0].astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.filters
        described, (chunks, peaks, at, first) = self.describe(texts, True)
        logit, inner = self.logits(described)
        error = ((1 / (1 + np.exp(-logit)) - y) * weight / len(texts)).astype(np.float32)
        d_inner = error[:, None] * w["out"][None, :] * (inner > 0)
        d_text = d_inner @ w["hidden"].T
        counts = np.diff(first)
        text_of = np.repeat(np.arange(len(texts)), counts)
        d_peak = d_text[text_of, f : 2 * f] / counts[text_of][:, None].astype(np.float32)
        for part, value in ((0, described[:, :f]), (2, described[:, 2 * f :])):
            hit = peaks == value[text_of]
            shared = np.add.reduceat(hit, first[:-1], axis=0, dtype=np.float32)
            d_peak = d_peak + hit * (d_text[:, part * f : (part + 1) * f] / shared)[text_of]
        d_peak = d_peak * (peaks > 0)
        rows = np.arange(len(chunks))[:, None]
        grads = {
            "out": inner.T @ error,
            "out_bias": np.array([error.sum()], np.float32),
            "hidden": described.T @ d_inner,
            "hidden_bias": d_inner.sum(axis=0),
            "conv_bias": d_peak.sum(axis=0),
            "conv": np.zeros_like(w["conv"]),
            "bytes": np.zeros_like(w["bytes"]),
        }
        d = self.dim
        for k in range(self.width):
            symbol = chunks[rows, at + k]
            block = slice(k * d, (k + 1) * d)
            grads["conv"][block] = np.einsum("cfd,cf->df", w["bytes"][symbol], d_peak)
            np.add.at(grads["bytes"], symbol.ravel(), (d_peak[:, :, None] * w["conv"][block].T[None]).reshape(-1, d))
        return grads

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 4e-3, seed: int = 3) -> ByteNet:
        """Adam on the log loss; both labels weigh in by the square root of their odds, so the rarer one is not drowned."""
        draw = np.random.default_rng(seed)
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y > 0, 1.0, np.sqrt(share / (1 - share)) if share > 0.5 else 1.0)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        t, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(texts))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                grads = self.gradients([texts[j] for j in at], y[at], weight[at])
                t += 1
                pace = rate * (1 - 0.9 * t / total)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.weights[k] -= (pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED_ROWS, most_bytes: int = LABELLED_BYTES) -> ByteNet:
    """Fit on at most ``rows`` labelled texts of at most ``most_bytes`` bytes, none of them held out.

    Without usable labels the network stays as it was drawn, with its last
    layer at zero: every text scores one half.
    """
    sample = labelled_texts(docs, labels, label, None, rows, most_bytes)
    net = ByteNet()
    if not sample:
        net.weights["out"][:] = 0
        return net
    return net.fit([x for x, _ in sample], np.array([y for _, y in sample], np.float32))


def score_texts(docs: DataFrame, net, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of label 1 for every whole text (NULL like the empty text).

    Rows that repeat keep equal scores, other columns pass through, a column
    called like ``out``, whatever its case, is replaced, an empty table gives an
    empty table.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == out.lower()))

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        scores = np.zeros(len(texts))
        for at in _runs(texts):
            scores[at] = net.score([texts[i] or b"" for i in at])
        return batch.append_column(out, pa.array(scores, pa.float64()))

    return map_text(docs, text, run, T.StructType(docs.schema.fields + [T.StructField(out, T.DoubleType())]))


def _runs(texts: list, most_bytes: int = 1 << 20) -> list[range]:
    """Rows in runs of about ``most_bytes`` bytes."""
    out, start, held = [], 0, 0
    for i, x in enumerate(texts):
        held += len(x or b"")
        if held >= most_bytes:
            out.append(range(start, i + 1))
            start, held = i + 1, 0
    return out + ([range(start, len(texts))] if start < len(texts) else [])
