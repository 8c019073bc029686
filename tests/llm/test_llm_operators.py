"""The ten operators against brute-force versions, with nulls, empty and long texts, ties, repeats and empty tables."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from pluvion.llm import bpe, embeddings, licenses, mixing, quality, sharding, simhash, substrings, topk, toxicity
from pluvion.llm.components import components

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, window long, head string, anchor string"


def corpus():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdeé!") for _ in range(draw.randint(1, 6)))
    texts = [" ".join(word() for _ in range(draw.randint(1, 90))) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    texts += [passage, f"x {passage} y", f"{texts[0]}\t{passage}\n{texts[1]}", passage + " z", passage]
    texts += [texts[3]] * 6 + [texts[4] + " tail", "", "   \n", None, None, "All rights reserved. CC BY, cc by", "one", "two words"]
    texts += [" ".join(word() for _ in range(6000)), "w" * 50_000]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 1, 0, 0, "h", "a") for i, t in enumerate(texts)]
    rows += [rows[41], rows[3], (None, passage, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_components(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and {x for p in pairs if p[0] != p[1] for x in p} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == coder.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    own = bpe.byte_pairs(PATH, PATTERN)
    for text in ("ab" * 20_000, "aaaa" * 3000, "   x", "<|endoftext|>", "it's 12 3 \r\n\n  z"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == coder.encode_ordinary(text)
    assert bpe.encode(none, PATH, PATTERN).count() == 0


def test_round_trip_is_encode_then_decode(docs, none):
    rows = docs.withColumnRenamed("head", "decoded")
    both = bpe.round_trip(rows, PATH, PATTERN)
    apart = bpe.decode(bpe.encode(rows, PATH, PATTERN).drop("text"), PATH, PATTERN).select(both.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    assert bpe.round_trip(none, PATH, PATTERN).count() == 0


def test_shared_queue_and_own_queue_agree():
    own, draw = bpe.byte_pairs(PATH, PATTERN), random.Random(3)
    pieces = ["".join(draw.choice(draw.choice(("ab", "etaoinshr", "a", "\u00e9\u65e5x0"))) for _ in range(draw.randint(1, 60))) for _ in range(800)]
    pieces = [p.encode() for p in pieces]
    assert own.merge(pieces) == [own.merge_long(p) for p in pieces]


def test_new_filling_of_the_cache_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{i * k}xq" for k in range(40)) for i in range(30)] + ["", "z" * 3000]
    want = bpe.BytePairs(PATH, PATTERN).encode_all(texts)
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "HELD_TOKENS", 90)
    monkeypatch.setattr(bpe, "MERGE_BYTES", 40)
    monkeypatch.setattr(bpe, "LONG_TEXT", 200)
    assert bpe.BytePairs(PATH, PATTERN).encode_all(texts) == want


def test_rank_queue():
    queue, held, draw = bpe.RankQueue(300_000), [], random.Random(2)
    for _ in range(3000):
        if held and draw.random() < 0.45:
            assert queue.pop() == held.pop(held.index(min(held)))
        else:
            held.append((draw.randrange(300_000), draw.randrange(50)))
            queue.push(*held[-1])
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.pop() is None


def brute_fingerprint(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(marks, near):
    """Smallest id reachable for each id, all pairs."""
    low = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for a in marks:
            for b in marks:
                if low[b] < low[a] and near(a, b):
                    low[a], changed = low[b], True
    return low


def test_simhash(docs, none):
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == docs.count()
    marks = {r[0]: brute_fingerprint(r[1]) for r in corpus() if r[0] is not None}
    low = reach(marks, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 4)
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint & (1 << 64) - 1 == marks[r.doc_id] and r.component_id == low[r.doc_id]
    assert simhash.near_groups(none).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in low if low[i] == i)


def test_ball_links(spark):
    draw = random.Random(3)
    marks = [draw.getrandbits(64) for _ in range(60)]
    for m in list(marks):
        for flips in (1, 3, 4, 4, 5):
            x = m
            for b in draw.sample(range(64), flips):
                x ^= 1 << b
            marks.append(x)
    marks = sorted(set(marks) | {0, 15, 31, (1 << 64) - 1})
    low = reach(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    links = simhash.ball_links(spark.createDataFrame([(signed(m),) for m in marks], "mark long"))
    found = {r.node: r.component for r in components(links).collect()}
    groups = {}
    for m in marks:
        groups.setdefault(low[m], set()).add(found.get(signed(m), signed(m)))
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


def test_substrings(docs, none):
    data = [(i, t) for i, t, *_ in corpus()]
    first = {}
    for i, text in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        words = split(text)
        for k in range(len(words) - 49):
            first.setdefault(tuple(words[k : k + 50]), i)
    rows = substrings.remove_repeats(docs).collect()
    assert len(rows) == len(data)
    removed = 0
    for r in rows:
        words = split(r.text)
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if r.doc_id is not None and first[tuple(words[k : k + 50])] < r.doc_id:
                gone[k : k + 50] = [True] * 50
        assert r.kept == b" ".join(w for w, g in zip(words, gone) if not g).decode()
        assert (r.n_words, r.n_removed) == (len(words), sum(gone))
        removed += sum(gone)
    assert removed > 200
    assert substrings.remove_repeats(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mixed_sizes(mixing.sizes_of(docs)).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, []).append(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = {s: sum(r.size for r in sizes[s]) for s in order}
    target, free, left = {}, set(order), sum(total.values())
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
        free -= over
    target |= {s: share * weight[s] for s in free}
    for s in order:
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] for r in sizes[s])
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size for r in sizes[s])
        assert abs(sum(r.taken for r in sizes[s]) - target[s]) <= max(r.size for r in sizes[s])
    text_of = {r[0]: r[1] for r in corpus()}
    assert all(r.size == len(split(text_of[r.doc_id])) for r in rows if r.doc_id is not None)
    again = mixing.mixed_sizes(mixing.sizes_of(docs.repartition(2))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixture(docs).count() == sum(r.passes for r in rows)
    assert mixing.mixture(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, 5).collect()
    assert len(rows) == docs.count()
    text_of = {r[0]: r[1] for r in corpus()}
    place = {}
    for r in rows:
        if r.doc_id is not None:
            text = text_of[r.doc_id]
            assert r.size == len((text or "").encode()) + 16
            assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
            place.setdefault(text, set()).add(r.shard)
    assert all(len(x) == 1 for x in place.values())
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none, 5).count() == 0


def test_capacity_is_minimal():
    draw = np.random.default_rng(6)
    for _ in range(60):
        sizes = draw.integers(1, 40, size=draw.integers(1, 14))
        loads = np.sort(draw.integers(0, 30, size=3))[::-1]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        best = min(
            max(*(w for w in (sums[i] + loads[0] if i else 0, sums[j] - sums[i] + loads[1] if j > i else 0, sums[-1] - sums[j] + loads[2] if j < len(sizes) else 0)), 0)
            for i in range(len(sums))
            for j in range(i, len(sums))
        )
        capacity = sharding.smallest_capacity(sums, loads)
        assert capacity == best
        ends = sharding.even_cuts(sums, loads, capacity)
        runs = np.diff(np.concatenate([[0], ends]))
        assert ends[-1] == sums[-1] and all(n == 0 or n + load <= capacity for n, load in zip(runs, loads))


def test_shards_below_the_fullest_are_even():
    loads = np.array([4000, 90, 80, 50, 0, 0])
    sums = np.arange(0, 301, 3)
    assert sharding.common_level(300, loads) == 104
    runs = np.diff(np.concatenate([[0], sharding.even_cuts(sums, loads, 4000)]))
    assert runs[0] == 0 and np.abs(runs + loads - 104)[1:].max() <= 3


VECTORS = "vec_id long, embedding array<double>, label int, node long, v string"


def vectors():
    draw = np.random.default_rng(8)
    base = draw.standard_normal((30, 6))
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(base)]
    rows += [(100 + i, list(map(float, v + 0.1 * draw.standard_normal(6)))) for i, v in enumerate(base)]
    rows += [(200 + i, rows[5][1]) for i in range(25)] + [(240 + i, [2 * x for x in rows[6][1]]) for i in range(3)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (320, [1.0, 2.0])]
    return [(i, v, 0, 1, "x") for i, v in rows]


def test_top_k(spark):
    data = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, *_ in vectors() if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in data:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in data if i != q and len(b) == len(a))[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    rows = vectors()
    for tile in (4096, 16):
        old, topk.TILE_ROWS = topk.TILE_ROWS, tile
        try:
            got = topk.top_k(spark.createDataFrame(rows + rows[:3] + [(None, [1.0] * 6, 0, 0, "")], VECTORS), k=7).collect()
        finally:
            topk.TILE_ROWS = old
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    big = topk.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**40, 1.0]]))
    assert big.tolist() == [[2**60 + 3, 2**63 - 1]]


@pytest.mark.parametrize("block", [2048, 4])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    data = {i: np.array(v, float) for i, v, *_ in vectors() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = lambda a, b: a != b and len(data[a]) == len(data[b]) and data[a] @ data[b] / np.linalg.norm(data[a]) / np.linalg.norm(data[b]) >= 0.95
    low = reach(data, near)
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(vectors(), VECTORS)).collect()}
    assert len(got) == len(vectors())
    for i in got:
        links = sum(near(i, j) for j in data) if i in data else 0
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, low.get(i, i), low.get(i, i) == i)
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_recall():
    draw = np.random.default_rng(9)
    unit = embeddings.unit_vectors(draw.standard_normal((3000, 64)))
    other = embeddings.unit_vectors(draw.standard_normal((3000, 64)))
    other = embeddings.unit_vectors(other - (other * unit).sum(axis=1, keepdims=True) * unit)
    pair = 0.95 * unit + np.sqrt(1 - 0.95**2) * other
    lsh = embeddings.PStable()
    assert (lsh.keys(unit) == lsh.keys(pair)).any(axis=1).mean() > 0.98


def test_licenses(spark, docs, none):
    rows = licenses.labelled(docs).collect()
    assert len(rows) == docs.count()
    hit = [r for r in rows if r.text and r.text.startswith("All rights")][0]
    assert (hit.n_words, hit.n_base, hit.first_word, hit.last_word, hit.base_labels, hit.score) == (7, 3, 0, 5, "cc-by,reserved", 1.0)
    assert licenses.labelled(none).count() == 0
    draw = random.Random(5)
    vocabulary = sorted(w.decode() for w in licenses.vocabulary(licenses.TEMPLATES)) + ["foo", "bar"]
    join = licenses.ContainmentJoin(licenses.TEMPLATES, {w.encode(): draw.randrange(100) for w in vocabulary}, 0.8)
    for _ in range(150):
        words = [draw.choice(vocabulary).encode() for _ in range(draw.randint(0, 70))]
        notice = draw.choice(list(licenses.TEMPLATES)).encode().split()
        at = draw.randint(0, len(words))
        words[at:at] = [w for w in notice if draw.random() < 0.9]
        want = {}
        for number, text in enumerate(licenses.TEMPLATES):
            need = set(text.encode().split())
            for start in range(max(0, len(words) - licenses.BLOCK) + 1):
                share = len(need & set(words[start : start + licenses.BLOCK])) / len(need)
                if share >= 0.8:
                    want.setdefault(number, []).append((start, min(start + licenses.BLOCK, len(words)), share))
        runs = {}
        for number, start, stop, share in join.blocks(words):
            runs.setdefault(number, []).append((start, stop, share))
        assert set(runs) == set(want)
        for number, found in runs.items():
            assert max(c for *_, c in found) == max(c for *_, c in want[number])
            assert all(any(a < y and x < b for x, y, _ in want[number]) for a, b, _ in found)
            assert all(any(a < y and x < b for a, b, _ in found) for x, y, _ in want[number])


def test_a_long_notice_is_found_wherever_it_stands():
    notice = "this work is foo dedicated foo foo to the foo public foo foo domain foo foo foo cc0 foo foo foo foo foo foo foo foo foo 1 0".split()
    assert len(notice) == 29
    join = licenses.ContainmentJoin(licenses.TEMPLATES, {}, 0.8)
    for offset in range(40):
        words = [w.encode() for w in ["pad"] * offset + notice + ["pad"] * 50]
        assert [join.templates[n][0] for n, *_ in join.blocks(words)] == ["cc0"]


def test_plain_forward_pass():
    """The network's probability from its weights, byte by byte."""
    net = quality.ByteNet(filters=6, hidden=5, chunk=40, step=30)
    w, draw = net.weights, random.Random(8)
    for text in (b"", b"abc", bytes(draw.randrange(256) for _ in range(171))):
        count = 1 + max(0, math.ceil((len(text) - net.chunk) / net.step))
        symbols = list(text) + [quality.PAD] * ((count - 1) * net.step + net.chunk - len(text))
        peaks = []
        for c in range(count):
            part = symbols[c * net.step : c * net.step + net.chunk]
            rows = [sum((list(w["bytes"][s]) for s in part[i : i + net.width]), []) for i in range(net.chunk - net.width + 1)]
            peaks.append([max(0.0, max(sum(x * y for x, y in zip(row, w["conv"][:, f])) for row in rows) + w["conv_bias"][f]) for f in range(net.filters)])
        columns = list(zip(*peaks))
        told = [max(c) for c in columns] + [sum(c) / len(c) for c in columns] + [min(c) for c in columns]
        inner = [max(0.0, sum(x * y for x, y in zip(told, w["hidden"][:, h])) + w["hidden_bias"][h]) for h in range(5)]
        z = sum(x * y for x, y in zip(inner, w["out"])) + w["out_bias"][0]
        assert net.score([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_non_negative_risk_by_hand():
    """One member's steps against a plain computation of the corrected risk and its numerical slope."""
    draw = np.random.default_rng(6)
    p, u = (draw.random((12, 4)) < 0.6).astype(float), (draw.random((30, 4)) < 0.3).astype(float)
    loss = lambda z: float(np.mean(np.log1p(np.exp(z))))

    def parts(w, prior):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        return prior * loss(-zp), loss(zu) - prior * loss(zp)

    for prior in (0.1, 0.45):
        model = toxicity.NonNegativePU(prior)
        w, (m, v) = np.zeros(5), np.zeros((2, 5))
        w[-1] = np.log(prior / (1 - prior))
        kept = 0
        for t in range(1, 60):
            positive, negative = parts(w, prior)
            kept += negative >= 0
            value = (lambda w: sum(parts(w, prior)) + 0.5e-3 * float(w[:-1] @ w[:-1])) if negative >= 0 else (lambda w: -parts(w, prior)[1])
            g = np.array([(value(w + e) - value(w - e)) / 2e-6 for e in np.eye(5) * 1e-6])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            if t in (1, 20, 59):
                got, bias = model._member(p, u, t, 0.05, 1e-3)
                assert np.append(got, bias) == pytest.approx(w, abs=2e-3)
        assert kept


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "some words here", "x", 5, "k", 1.5, b"z"), (2, None, None, None, None, None, None), (3, "", "y", 1, "", 0.0, b"")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, IDS string, N_WORDS int, Kept string, SCORE double, decoded binary")
    assert [c for c in quality.score_texts(frame, quality.ByteNet()).columns if c.lower() == "score"] == ["score"]
    assert sorted(c.lower() for c in bpe.round_trip(frame, PATH, PATTERN).columns) == ["decoded", "doc_id", "ids", "kept", "n_words", "score"]
    assert {r.doc_id: r.n_words for r in substrings.remove_repeats(frame).collect()} == {1: 3, 2: 0, 3: 0}
    assert {r.doc_id: r.n_words for r in licenses.labelled(frame).collect()} == {1: 3, 2: 0, 3: 0}
    import corpus_pipeline

    given = spark.createDataFrame([(1, "b " * 60, 7, 2, "q"), (2, "a " + "b " * 60, 8, 3, "r")], "doc_id long, text string, kept int, n_words int, _quality string")
    assert corpus_pipeline.drop_repeats(spark, given, "").columns == given.columns
    assert {r.doc_id: (r.text, r.kept, r.n_words, r._quality) for r in corpus_pipeline.drop_repeats(spark, given, "").collect()} == {1: ("b " * 60, 7, 2, "q"), 2: ("a", 8, 3, "r")}


def test_bytes_that_are_no_utf8(spark):
    frame = spark.createDataFrame([(1, bytearray(b"\xff\xfe w" * 60)), (2, bytearray(b"x " + b"\xff\xfe w" * 60))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    rows = substrings.remove_repeats(frame).selectExpr("doc_id", "n_words", "n_removed", "cast(kept as binary) as kept").collect()
    words = {1: (b"\xff\xfe w" * 60).split(), 2: (b"x " + b"\xff\xfe w" * 60).split()}
    assert {r.doc_id: r.n_words for r in rows} == {k: len(v) for k, v in words.items()}
    assert {r.doc_id: bytes(r.kept) for r in rows} == {1: b" ".join(words[1]), 2: b"x"}


def test_embeddings_of_one_id(spark):
    """Rows that share an id and have different vectors are rows of their own."""
    e = np.eye(6)
    near = [float(x) for x in e[0] + 0.05 * e[1]]
    rows = [(5, [float(x) for x in e[0]], 0, 0, ""), (5, [float(x) for x in e[3]], 0, 0, ""), (6, near, 0, 0, "")]
    got = sorted(tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False)]


def test_byte_net_gradients():
    net = quality.ByteNet(filters=5, hidden=4, chunk=32, step=24)
    texts, y, weight = [b"", b"some text that spans more than a single chunk of bytes", b"short"], np.array([1.0, 0.0, 1.0]), np.ones(3)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)

    def loss():
        z = net.logits(net.describe(texts)[0])[0].astype(np.float64)
        return float((np.logaddexp(0, z) - y * z).mean())

    grads = net.gradients(texts, y, weight)
    for name, at in (("out", 1), ("hidden", (2, 1)), ("conv", (3, 2)), ("conv_bias", 1)):
        step, value = 1e-3, net.weights[name][at]
        net.weights[name][at] = value + step
        high = loss()
        net.weights[name][at] = value - step
        low = loss()
        net.weights[name][at] = value
        assert grads[name][at] == pytest.approx((high - low) / 2 / step, abs=3e-3)


def test_quality_covers_whole_texts(spark, docs, none):
    net = quality.ByteNet()
    text = bytes(random.Random(0).randrange(97, 120) for _ in range(10_000))
    assert net.score([text])[0] != net.score([text[:-3] + b"!!!"])[0]
    assert len(net.chunks(text)) * net.step >= len(text) - net.chunk
    rows = quality.score_texts(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_texts(none, net).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(quality.fit_quality(docs, labels).score([b"", b"text"])) == {0.5}
    assert toxicity.fit_toxicity(docs, labels).score([b"", b"text"]).tolist() == pytest.approx([0.05, 0.05])


@pytest.mark.parametrize("name, label, least", [("op9_quality", 2, 0.93), ("op1_toxicity", 1, 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    from pluvion.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    scored = QUERIES[name](spark, folder).where("held_out")
    both = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    kind = "toxic" if label == 1 else "quality"
    hits = [r.predicted == r[kind] for r in both]
    ones = [r.predicted for r in both if r[kind] == 1]
    assert sum(hits) / len(hits) > least and sum(ones) / len(ones) > 0.85


def test_digests(spark):
    from pluvion.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    text_of = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_bpe"](spark, folder).collect()
    assert len(rows) == len(text_of)
    assert all(r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest() for r in rows)


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    current, counts = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = corpus_pipeline.saved(stage(spark, current, folder), "test")
        assert current.columns == docs.columns
        counts.append(current.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, current, folder).count() == counts[-1]
