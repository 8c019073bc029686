"""The near-copy stage of the pipeline against all pairs of five-word shingles."""

import random

import corpus_pipeline
from pluvion.llm import minhash, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts whose copies have 1 to 10 of 400 words changed: similarity from about 0.98 to below 0.8, and chains of copies."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = []
    for edits in (1, 2, 3, 5, 7, 8, 9, 10) * 4:
        base = [word() for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(3):
            for at in draw.sample(range(400), edits):
                base = base[:at] + [word()] + base[at + 1 :]
            texts.append(" ".join(base))
    draw.shuffle(texts)
    return texts + ["", "  ", texts[0].upper(), "one two", "one two three", "ONE two"]


def test_near_copies_reach_five_word_jaccard(spark):
    texts = planted()
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    seen = []
    for b in range(len(texts)):
        for a in range(b):
            s = jaccard(sets[a], sets[b])
            if s >= 0.8:
                seen.append(s)
                x, y = low[a], low[b]
                low = [min(x, y) if v in (x, y) else v for v in low]
    assert any(s < 0.84 for s in seen) and any(0.9 < s < 1 for s in seen)
    docs = spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), None)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows == {i: texts[i] for i in range(len(texts)) if low[i] == i}


def test_repeated_ids_keep_the_clean_text(spark):
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(2)]
    rows = [(3, texts[0]), (5, texts[0] + " end"), (5, texts[1]), (5, texts[1]), (None, texts[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(3, texts[0]), (5, texts[1]), (None, texts[1]), (None, None)], key=str)
    assert sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, None).collect()), key=str) == want
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), None).count() == 0


def test_simhash_keeps_the_clean_text_of_a_repeated_id(spark):
    draw = random.Random(2)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(3)]
    rows = [(3, texts[0]), (5, texts[0].upper()), (5, texts[1]), (5, texts[1]), (5, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(3, texts[0]), (5, texts[1]), (5, texts[2])])
    assert sorted(map(tuple, simhash.deduplicate(docs).collect())) == want


def copies(members, least, most, words=150):
    """Copies of one text with ``least`` to ``most`` words changed."""
    draw = random.Random(members)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(members):
        text = list(base)
        for at in draw.sample(range(words), draw.randint(least, most)):
            text[at] = word()
        out.append(" ".join(text))
    return out


def compared(spark, monkeypatch, texts):
    """Component of every text, and the number of pairs that were compared."""
    pairs, kept = [], minhash.saved

    def counted(df, name):
        made = kept(df, name)
        if name == "pairs":
            pairs.append(made.count())
        return made

    monkeypatch.setattr(minhash, "saved", counted)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, text_mark long, text string")
    nodes, found = minhash.near_groups(docs)
    ids = {r.key: r.doc_id for r in nodes.collect()}
    group = {}
    for r in found.collect():
        group.setdefault(r.component, []).append(ids[r.node])
    monkeypatch.undo()
    return sorted(sorted(g) for g in group.values()), sum(pairs)


def test_pairs_grow_with_a_group_that_does_not_link(spark, monkeypatch):
    seen = []
    for members in (200, 400, 800):
        groups, pairs = compared(spark, monkeypatch, copies(members, 5, 6))
        assert groups == []
        seen.append(pairs)
    assert seen[0] < 200 * 16 and seen[2] < 3 * seen[1] < 9 * seen[0]


def test_chains_of_copies_find_every_link(spark, monkeypatch):
    texts = list(dict.fromkeys(copies(260, 0, 9)))
    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if jaccard(sets[a], sets[b]) >= 0.8 and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    want = {}
    for i, x in enumerate(low):
        want.setdefault(x, []).append(i)
    groups, pairs = compared(spark, monkeypatch, texts)
    assert groups == sorted(g for g in want.values() if len(g) > 1) and len(groups) > 0
    assert pairs < len(texts) * 30


def test_near_copies_go_through_simhash(spark, monkeypatch):
    """the stage searches the balls of the fingerprints; what they offer is checked exactly."""
    found, search = [], simhash.ball_links

    def recorded(marks, *rest):
        links = search(marks, *rest)
        found.append((marks.count(), links.count()))
        return links

    monkeypatch.setattr(simhash, "ball_links", recorded)
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(reversed(base)), " ".join(base).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()) == [0, 2]
    assert found == [(3, 1)]
