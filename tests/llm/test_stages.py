"""Stages of the pipeline against brute-force rows."""

import random
import re

import public_tokenizers
import pytest
import tiktoken.load

import corpus_pipeline
from pluvion.llm import mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_quality_keeps_what_the_network_scores_high(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if net.score([(r.text or "").encode()])[0] >= corpus_pipeline.LEAST_QUALITY}
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    assert kept.columns == docs.columns and 0 < len(want) < docs.count()
    assert {r.doc_id for r in kept.collect()} == want


def test_repeats_go_word_by_word(spark):
    draw = random.Random(1)
    some = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    first, second = some(70), some(55)
    texts = {4: some(90), 2: some(20) + first + some(30), 9: first[5:] + some(40) + second, 3: some(10) + second[:49], 7: second + first, 8: [], 6: some(60) + first[:49]}
    rows = [(k, "\n ".join(v), "s", len("\n ".join(v))) for k, v in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeats(spark, frame, SF).collect()}
    starts = {}
    for k, words in texts.items():
        for i in range(len(words) - 49):
            window = tuple(words[i : i + 50])
            starts[window] = min(k, starts.get(window, k))
    for k, words in texts.items():
        gone = {p for i in range(len(words) - 49) if starts[tuple(words[i : i + 50])] < k for p in range(i, i + 50)}
        text = " ".join(w for p, w in enumerate(words) if p not in gone) if gone else "\n ".join(words)
        assert got[k] == (text, len(text))
    assert any(len(got[k][0].split()) < len(texts[k]) for k in texts)


def test_mix_writes_each_document_as_often_as_it_is_taken(spark, docs):
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(mixing.sizes_of(docs)).collect()}
    counts = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    text = {r.doc_id: r.text for r in docs.collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in text.items()}
    assert all(counts.get(k, 0) * size[k] == taken[k] for k in text)


def test_tokens_are_those_of_the_library(spark, docs):
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.encode_tokens(spark, docs, SF).collect():
        ids = codec.encode_ordinary(text[r.doc_id] or "")
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
