"""Toxicity: non-negative positive-unlabelled learning with numpy classifiers."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from pluvion.llm.labelled import any_texts, labelled_texts
from pluvion.llm.quality import score_texts

#: Bounds of the samples that the classifiers are fitted on.
POSITIVE_ROWS, UNLABELLED_ROWS, SAMPLE_BYTES = 2500, 5000, 20_000
#: A-Z become a-z; digits, letters and bytes beyond ASCII make words, all else parts them.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STEMS = (4, 5, 6)


def features(text: bytes) -> set[bytes]:
    """Distinct words of a text and their first four, five and six bytes, marked as stems."""
    words = set(text.translate(LETTERS).split())
    return words | {b"^" + w[:n] for w in words if len(w) > 3 for n in STEMS}


class NonNegativePU:
    """Linear classifiers over selected features, fitted with the non-negative risk of positive and unlabelled texts.

    With class prior p the risk is p R+(P) + max(0, R-(U) - p R-(P)). When the
    part for negatives falls below zero, a step goes back on it alone, so the
    classifier cannot win by overfitting the unlabelled texts.
    """

    def __init__(self, prior: float, size: int = 800, members: int = 3):
        self.prior, self.size, self.members = prior, size, members
        self.column: dict[bytes, int] = {}
        self.weights = np.zeros((0, members))
        self.bias = np.full(members, np.log(prior / (1 - prior)))

    def select(self, positive: list[bytes], unlabelled: list[bytes], least: float = 3.0) -> None:
        """Features that positives hold more often than unlabelled texts, by at least so many standard deviations."""
        p, u = Counter(), Counter()
        for x in positive:
            p.update(features(x))
        p = Counter({f: n for f, n in p.items() if n >= 3})
        for x in unlabelled:
            u.update(p.keys() & features(x))
        scale = len(positive) / len(unlabelled)
        gain = {f: (n - scale * u[f]) / np.sqrt(n + scale * scale * u[f] + 1) for f, n in p.items()}
        best = sorted((-g, f) for f, g in gain.items() if g > least)[: self.size]
        self.column = {f: i for i, (_, f) in enumerate(best)}

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.column)), np.float32)
        for i, x in enumerate(texts):
            at = [self.column[f] for f in features(x) & self.column.keys()]
            out[i, at] = 1
        return out

    def fit(self, positive: list[bytes], unlabelled: list[bytes], steps: int = 250, rate: float = 0.05, decay: float = 1e-3, seed: int = 9) -> NonNegativePU:
        if not positive or not unlabelled:
            return self
        self.select(positive, unlabelled)
        xp, xu = self.matrix(positive), self.matrix(unlabelled)
        draw = np.random.default_rng(seed)
        self.weights = np.zeros((len(self.column), self.members))
        for k in range(self.members):
            p = xp[draw.integers(0, len(xp), len(xp))]
            u = xu[draw.integers(0, len(xu), len(xu))]
            self.weights[:, k], self.bias[k] = self._member(p, u, steps, rate, decay)
        return self

    def _member(self, p: np.ndarray, u: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        w, b = np.zeros(p.shape[1] + 1), float(self.bias[0])
        w[-1] = b
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
            negative = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp = self.prior * (sigmoid(zp) - 1 - sigmoid(zp)) / len(zp)
                gu = sigmoid(zu) / len(zu)
            else:
                gp = self.prior * sigmoid(zp) / len(zp)
                gu = -sigmoid(zu) / len(zu)
            g = np.append(gp @ p + gu @ u + decay * w[:-1] * (negative >= 0), gp.sum() + gu.sum())
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return w[:-1], w[-1]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of the classifiers per text."""
        out = np.empty(len(texts))
        known = self.column.get
        for i, text in enumerate(texts):
            at = [c for c in map(known, features(text)) if c is not None]
            z = self.bias + self.weights[at].sum(axis=0)
            out[i] = (1 / (1 + np.exp(-np.clip(z, -40, 40)))).mean()
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", prior: float | None = None) -> NonNegativePU:
    """Fit on confirmed positives and on texts of unknown label, both bounded, none of them held out.

    ``prior`` is the share of positives among all texts; if not given, it is
    their share among the labelled rows that are not held out. Without
    positives every text scores the prior.
    """
    from pyspark.sql import functions as F

    from pluvion.llm.base import held_out

    if prior is None:
        row = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.when(F.col(label).isin(0, 1), F.col(label))).alias("p")).first()
        prior = row["p"] if row["p"] is not None else 0.05
    prior = float(np.clip(prior, 0.001, 0.5))
    positive = [x for x, _ in labelled_texts(docs, labels, label, 1, POSITIVE_ROWS, SAMPLE_BYTES)]
    return NonNegativePU(prior).fit(positive, any_texts(docs, UNLABELLED_ROWS, SAMPLE_BYTES))


__all__ = ["NonNegativePU", "features", "fit_toxicity", "score_texts"]
