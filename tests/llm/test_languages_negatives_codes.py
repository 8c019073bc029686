"""Language identification, hard negatives and vector codes against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pluvion.llm import ballcodes, hardneg, langid
from pluvion.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def speech(draw, words, n):
    return " ".join(draw.choice(words) for _ in range(n))


WORDS = {
    "de": "der die das und nicht straße über schön zeit".split(),
    "en": "the and of with thing where house there when".split(),
    "fr": "le les été où garçon être sœur mais avec".split(),
    "es": "el los niño qué también señor pero donde año".split(),
    "xx": "zzq qqz zqz qzz qzq".split(),
}


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(2)
    rows = [(i, speech(draw, WORDS[lang], draw.randint(3, 40)), lang, 0) for i, lang in enumerate(sorted(WORDS) * 40)]
    rows += [(1000, None, "en", 0), (1001, "", "en", 0), (1002, "12 !? 3", "de", 0), (1003, "the house", None, 0), (None, "the thing", "en", 0), rows[1], rows[1]]
    rows += [(1004, speech(draw, WORDS["fr"], 60_000), "fr", 0), (1005, "²³", "fr", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE int").repartition(3).cache()


def test_profile_counts_the_whole_text(monkeypatch):
    text = langid.letters("Ärger, où? 12 Straße!" * 40)
    assert langid.letters(None) == langid.letters("12 ²!") == b"" and langid.letters(b"a\xff\xfeB") == b" a b "
    want = np.zeros(langid.COLUMNS)
    for n in range(1, 5):
        for i in range(len(text) - n + 1):
            code = n
            for k, factor in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)[:n]):
                code = ((code ^ text[i + k]) * factor) & 0xFFFFFFFF
                code ^= code >> 15
            want[code % langid.COLUMNS] += 1
    want = np.sqrt(want) / np.sqrt(want.sum())
    assert np.allclose(langid.profile(text), want)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.allclose(langid.profile(text), want)


def test_machine_minimises_its_loss():
    draw = np.random.default_rng(1)
    x = draw.random((60, langid.COLUMNS)).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    positive = draw.random(60) < 0.3
    svm = langid.LinearSVM(cost=5.0, steps=1500).fit(x, positive)
    full = np.hstack([x, np.ones((60, 1))])
    w = np.append(svm.weights, svm.bias)
    y, part = np.where(positive, 1, -1), np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    slope = w - 10.0 * full.T @ (part * y * np.maximum(0, 1 - y * (full @ w)))
    assert np.abs(slope).max() < 1e-3


def plain_prediction(model, text):
    """Family by probability, then votes of the pairs, from the weights alone."""
    x = langid.profile(langid.letters(text))
    sure = lambda m: 1 / (1 + np.exp(-(m.slope * (x @ m.weights + m.bias) + m.shift)))
    family = max(model.against_rest, key=lambda f: sure(model.against_rest[f]))
    langs = model.members[family]
    votes, sums = Counter(), Counter()
    for (a, b), svm in model.pairs.items():
        if a in langs:
            margin = x @ svm.weights + svm.bias
            votes[a if margin > 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
    return max(langs, key=lambda lang: (votes[lang], sums[lang]))


def test_languages(spark, spoken):
    model = langid.fit_languages(spoken)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "only xx": ["xx"]} and len(model.pairs) == 2
    out = langid.predict_languages(spoken, model)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == spoken.count()
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == plain_prediction(model, r.text) and 0 < r.score <= 1
            assert r.lang is None or r.lang_pred == r.lang
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1


def test_fit_learns_from_bounded_rows_that_are_not_held_out(spark, spoken, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.FamilyTree, "fit", lambda self, texts, langs: seen.append((texts, langs)) or self)
    langid.fit_languages(spoken)
    taught = {r.text for r in spoken.collect() if r.doc_id is not None and r.lang and r.text is not None and len(r.text.encode()) <= langid.SAMPLE_BYTES and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert set(seen[0][0]) == taught
    langid.fit_languages(spoken, language_rows=7)
    assert set(Counter(seen[1][1]).values()) == {7}
    langid.fit_languages(spoken, language_rows=7, rows=10)
    assert Counter(seen[2][1]) == dict.fromkeys(WORDS, 2)


def test_languages_without_rows_or_labels(spark, spoken):
    none = spoken.where("false")
    model = langid.fit_languages(none)
    assert langid.predict_languages(none, model).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict_languages(spoken, model).collect()} == {("und", 0.0)}
    one = langid.fit_languages(spoken.where("lang = 'de'"))
    assert one.predict("anything") == ("de", 1.0) and one.predict("") == ("und", 0.0)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op11_language"](spark, SF).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


VECTORS = "vec_id long, embedding array<float>, label int, SIZE string, code string"


def vector_rows():
    draw = np.random.default_rng(8)
    rows = []
    for i in range(420):
        v = draw.standard_normal(32)
        rows.append((i, [float(np.float32(x)) for x in v / np.sqrt(v @ v)], int(draw.integers(4)), "s", "c"))
    rows += [(500 + i, rows[i][1], rows[i][2], "s", None) for i in range(60)] + [(600, rows[100][1], rows[100][2], "s", None)]
    rows += [(700, None, 1, None, None), (701, [0.1] * 31 + [None], 1, None, None), (702, [float("nan")] * 32, 1, None, None), (703, rows[5][1], None, None, None)]
    rows += [(704, [float("inf")] + [0.0] * 31, 2, None, None), (705, [0.0] * 32, 3, None, None), (706, [0.5, 0.5], 3, None, None), (707, [], 3, None, None)]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def plain_negatives(rows):
    kept = {}
    for i, v, label, *_ in rows:
        if i is not None and usable(v) and label is not None:
            kept[i] = ([int(np.floor(x * 256.0)) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a, (x, label) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (y, other) in kept.items() if i != a and len(y) == len(x))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            near = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, n, -s, -m) for k, (m, n, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("shard", [hardneg.SHARD_ROWS, 7])
def test_hard_negatives(spark, monkeypatch, shard):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", shard)
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(hardneg, "TILE", 5)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS)
    got = hardneg.mine(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 30
    assert hardneg.mine(frame.where("false")).count() == 0
    assert hardneg.mine(frame.where("vec_id = 100")).count() == 0
    twice = frame.union(frame.where("vec_id < 30"))
    assert sorted(tuple(r) for r in hardneg.mine(twice).collect()) == want


@pytest.mark.parametrize("size", [1, 300, 1e6, 1e12, 1e40])
def test_residue_products_are_exact(size):
    draw = np.random.default_rng(3)
    a, b = (np.floor(draw.uniform(-size, size, (n, 70))) for n in (6, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    got = hardneg.ResidueRows(b).scores(a, 0, 9)
    assert got.tolist() == [[min(max(v, hardneg.LOW), hardneg.HIGH) for v in row] for row in want]


def test_window_edges():
    for p in list(range(0, 500)) + [10**18 + 7, hardneg.HIGH]:
        low = hardneg.floors(p)
        assert 100 * low >= 80 * p and 100 * (low - 1) < 80 * p


def plain_codes(rows):
    """Lloyd rounds with every distance, whole numbers only."""
    kept = sorted((r for r in rows if usable(r[1]) and len(r[1]) == len(rows[0][1])), key=lambda r: (r[0], r[1]))
    whole = [[int(np.floor(x * 256.0)) for x in r[1]] for r in kept]
    width = len(whole[0]) // 16
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(16)] for v in whole]
    books = [[v[p] for v in cut[:64]] for p in range(16)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    place = lambda v: [min((far(v[p], c), e) for e, c in enumerate(books[p])) for p in range(16)]
    for _ in range(2):
        at = [place(v) for v in cut]
        for p in range(16):
            for e in range(len(books[p])):
                own = [v[p] for v, a in zip(cut, at) if a[p][1] == e]
                if own:
                    books[p][e] = tuple(sum(x[k] for x in own) // len(own) for k in range(width))
    at = [place(v) for v in cut]
    errors = [sum(d for d, _ in a) for a in at]
    by_label = Counter()
    for r, error in zip(kept, errors):
        by_label[r[2]] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((r[0], "".join(f"{e:02x}" for _, e in a), error, by_label[r[2]], digest) for r, a, error in zip(kept, at, errors))


def coded(frame):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in ballcodes.compress(frame).collect())


def test_ball_codes(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert coded(frame) == plain_codes(rows)
    assert coded(frame.union(frame.where("vec_id in (2, 3)"))) == plain_codes(rows + rows[2:4])
    few = rows[:9]
    assert coded(spark.createDataFrame(few, VECTORS)) == plain_codes(few)
    assert ballcodes.compress(frame.where("false")).count() == 0
    assert ballcodes.compress(frame.where("vec_id = 706")).count() == 0


def test_ball_codes_of_large_components(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.uniform(-1e7, 1e7, 16)], 1, None, None) for i in range(150)]
    assert coded(spark.createDataFrame(rows, VECTORS)) == plain_codes(rows)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_balls_agree_with_all_distances(kind):
    draw = np.random.default_rng(5)
    for spread in (3, 40, 4000):
        x = draw.integers(-spread, spread, (700, 4)).astype(kind)
        entries = draw.integers(-spread, spread, (64, 4)).astype(kind)
        entries[9] = entries[30]
        book = ballcodes.Codebook(entries)
        best, least = book.nearest(x)
        for held in (np.zeros(700, np.int64), draw.integers(0, 64, 700), best):
            got = book.move(x, held)
            assert got[0].tolist() == best.tolist() and got[1].tolist() == least.tolist()
