"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import forget, map_text, saved, utf8

#: Bounds of the sample the classifiers are fitted on: rows of one language, rows in all, bytes of one text.
LANGUAGE_ROWS, SAMPLE_ROWS, SAMPLE_BYTES = 1000, 5000, 12_000
#: Columns that the byte runs of one to four bytes are hashed into.
COLUMNS, LONGEST = 4096, 4
#: Bytes of a text that are counted at a time.
BLOCK = 1 << 18
#: Value for texts without a letter.
UNDETERMINED = "und"

#: Languages of a family by ISO 639-1 code. A language that stands nowhere is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
}

_NO_LETTERS = regex.compile(r"\P{L}+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def letters(text: bytes | str | None) -> bytes:
    """Lower-cased runs of letters, each with a space on both sides; empty where there is no letter."""
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    kept = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} ".encode("utf-8", "replace") if kept else b""


def profile(found: bytes) -> np.ndarray:
    """Square roots of the shares of the hashed runs of one to four bytes of the whole of ``found``, of length one."""
    counts = np.zeros(COLUMNS)
    symbols = np.frombuffer(found, np.uint8)
    for at in range(0, len(symbols), BLOCK):
        for n in range(1, LONGEST + 1):
            part = symbols[at : at + BLOCK + n - 1].astype(np.uint32)
            total = len(part) - n + 1
            if total < 1:
                continue
            code = np.full(total, n, np.uint32)
            for k in range(n):
                code = (code ^ part[k : k + total]) * _FACTORS[k]
                code ^= code >> np.uint32(15)
            counts += np.bincount(code % np.uint32(COLUMNS), minlength=COLUMNS)
    root = np.sqrt(counts)
    return root / max(np.sqrt((root * root).sum()), 1e-12)


class LinearSVM:
    """Binary support vector machine with squared hinge loss; both classes weigh the same. Margins become probabilities by a fitted sigmoid."""

    def __init__(self, cost: float = 20.0, steps: int = 250):
        self.cost, self.steps = cost, steps
        self.weights, self.bias, self.slope, self.shift = np.zeros(COLUMNS), 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, positive: np.ndarray) -> LinearSVM:
        """Accelerated gradient steps on the whole sample, the same from run to run."""
        y = np.where(positive, 1.0, -1.0).astype(np.float32)
        part = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
        full = np.hstack([x, np.ones((len(x), 1), np.float32)])
        pace = 1.0 / (1.0 + 2 * self.cost * self._curvature(full, part))
        w = np.zeros(full.shape[1], np.float32)
        ahead, t = w.copy(), 1.0
        for _ in range(self.steps):
            short = np.maximum(0, 1 - y * (full @ ahead))
            step = ahead - pace * (ahead - 2 * self.cost * (full.T @ (part * y * short)))
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = step + np.float32((t - 1) / t_next) * (step - w), step, t_next
        self.weights, self.bias = w[:-1].astype(float), float(w[-1])
        self._calibrate(self.margin(x), positive)
        return self

    @staticmethod
    def _curvature(x: np.ndarray, part: np.ndarray) -> float:
        v = np.ones(x.shape[1], np.float32)
        size = 1.0
        for _ in range(20):
            v = x.T @ (part * (x @ v))
            size = float(np.sqrt(v @ v))
            v /= max(size, 1e-12)
        return 1.05 * size

    def _calibrate(self, margin: np.ndarray, positive: np.ndarray) -> None:
        """Slope and shift of the sigmoid by Newton steps on smoothed targets."""
        up, down = positive.sum(), (~positive).sum()
        want = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
        columns = np.stack([margin, np.ones_like(margin)])
        at = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(at @ columns, -30, 30)))
            slope = columns @ (p - want) + 1e-3 * (at - [1.0, 0.0])
            curve = (columns * (p * (1 - p))) @ columns.T + 1e-3 * np.eye(2)
            at = at - np.clip(np.linalg.solve(curve, slope), -1, 1)
        self.slope, self.shift = max(float(at[0]), 1e-3), float(at[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


class FamilyTree:
    """One machine per family against the rest, and one per two languages of a family.

    A text goes to the family with the highest probability. There every two
    languages vote by the sign of their margin; equal votes go to the larger
    sum of margins, then to the first language in order. The score is the
    probability of the family among all times the mean probability of the
    winner against the other languages of its family.
    """

    def __init__(self, families: dict[str, tuple[str, ...]] | None = None):
        given = FAMILIES if families is None else families
        self.family_of = {lang: family for family, langs in given.items() for lang in langs}
        self.members: dict[str, list[str]] = {}
        self.against_rest: dict[str, LinearSVM] = {}
        self.pairs: dict[tuple[str, str], LinearSVM] = {}

    def fit(self, texts: list[bytes], langs: list[str]) -> FamilyTree:
        found = [(letters(text), lang) for text, lang in zip(texts, langs)]
        found = [(text, lang) for text, lang in found if text]
        if not found:
            return self
        x = np.stack([profile(text) for text, _ in found]).astype(np.float32)
        y = np.array([lang for _, lang in found], dtype=object)
        family = {lang: self.family_of.get(lang.split("-")[0].lower(), f"only {lang}") for lang in sorted(set(y))}
        for lang, name in family.items():
            self.members.setdefault(name, []).append(lang)
        of = np.array([family[lang] for lang in y], dtype=object)
        if len(self.members) > 1:
            self.against_rest = {name: LinearSVM().fit(x, of == name) for name in sorted(self.members)}
        for name in self.members:
            for a, b in combinations(self.members[name], 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = LinearSVM().fit(x[rows], y[rows] == a)
        return self

    def predict(self, text: bytes | str | None) -> tuple[str, float]:
        """Language and score of a whole text; ``und`` and 0 without letters or without anything learnt."""
        found = letters(text)
        if not found or not self.members:
            return UNDETERMINED, 0.0
        x = profile(found)
        name, share = self._family(x)
        lang, sure = self._language(x, self.members[name])
        return lang, float(share * sure)

    def _family(self, x: np.ndarray) -> tuple[str, float]:
        if not self.against_rest:
            return next(iter(self.members)), 1.0
        chances = {name: float(svm.probability(svm.margin(x))) for name, svm in self.against_rest.items()}
        best = max(chances, key=lambda name: chances[name])
        return best, chances[best] / sum(chances.values())

    def _language(self, x: np.ndarray, langs: list[str]) -> tuple[str, float]:
        if len(langs) == 1:
            return langs[0], 1.0
        votes = {lang: [0, 0.0, 0.0] for lang in langs}
        for a, b in combinations(langs, 2):
            svm = self.pairs[a, b]
            margin = float(svm.margin(x))
            chance = float(svm.probability(margin))
            for lang, side, p in ((a, margin, chance), (b, -margin, 1 - chance)):
                votes[lang][0] += side > 0
                votes[lang][1] += side
                votes[lang][2] += p
        best = max(langs, key=lambda lang: (votes[lang][0], votes[lang][1]))
        return best, votes[best][2] / (len(langs) - 1)


def held_out(doc_id) -> F.Column:
    """Rows that nothing may be learnt from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(utf8(doc_id.cast("string"))) % 4 == 2, F.lit(False))


def fit_languages(
    docs: DataFrame,
    families: dict[str, tuple[str, ...]] | None = None,
    language_rows: int = LANGUAGE_ROWS,
    rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES,
    seed: int = 6,
) -> FamilyTree:
    """Fit on at most ``language_rows`` texts a language and ``rows`` texts in all, of at most ``most_bytes`` bytes each.

    ``docs`` has ``doc_id``, ``text`` and ``lang``. Held-out rows and those
    without id, text or language teach nothing. Languages are counted first;
    a row is then a candidate by a hash of its id and text against twice the share
    wanted of its language, so that ranks are given to a bounded number of
    rows however large a language is. If there are too many languages for
    ``rows``, each gives fewer texts. Equal rows count once.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= most_bytes))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    counts = saved(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # of known size, so that texts are not dealt out by language
    drawn = usable.select("doc_id", "lang", F.xxhash64("text").alias("mark"), draw.alias("draw"))
    drawn = drawn.join(counts, "lang").where(F.col("draw") * F.col("n") <= 2 * language_rows + 50)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "mark")
    ranked = drawn.select("doc_id", "lang", "mark", "draw").distinct().withColumn("place", F.row_number().over(order))
    wanted = ranked.where(F.col("place") <= language_rows).orderBy("place", "draw", "lang").limit(rows).select("doc_id", "lang", "mark")
    joined = usable.withColumn("mark", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "lang", "mark"])
    sample = sorted((r.lang, r.text) for r in joined.groupBy("doc_id", "lang", "mark").agg(F.min("text").alias("text")).collect())
    forget(counts)
    return FamilyTree(families).fit([text for _, text in sample], [lang for lang, _ in sample])


def predict_languages(docs: DataFrame, model: FamilyTree, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with a predicted language and its score for every whole text.

    NULL, empty and letterless texts are ``und`` with score 0; a text of any
    length is counted whole, in blocks. Equal texts get equal results, bytes
    that are not UTF-8 are no letters. Other columns pass through; those called
    like the results, whatever their case, are replaced. An empty table gives
    an empty table.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (lang.lower(), score.lower())))

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        found = [model.predict(x) for x in texts]
        return batch.append_column(lang, pa.array([x for x, _ in found], pa.string())).append_column(score, pa.array([s for _, s in found], pa.float64()))

    fields = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]
    return map_text(docs, text, run, T.StructType(docs.schema.fields + fields))
