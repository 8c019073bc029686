"""License scans: exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvion.llm.base import arrow_schema, map_text, short_batches
from pluvion.llm.toxicity import LETTERS

#: Phrases that always count, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices that a block may contain, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is dedicated to the public domain cc0 1 0": "cc0",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "all rights reserved no part of this publication may be reproduced": "reserved",
}
THRESHOLD = 0.8
#: Words of a block; blocks start at every word.
BLOCK = 32


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and characters beyond ASCII."""
    return (text or b"").translate(LETTERS).split()


def vocabulary(templates: dict[str, str]) -> set[bytes]:
    return {w for t in templates for w in t.encode().split()}


def token_counts(docs: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each template word stands in all texts. The result has one number per template word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                total.update(filter(words.__contains__, words_of(x)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    short_batches(docs.sparkSession)
    found = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in found}


class ContainmentJoin:
    """Templates indexed by their rarest words.

    Words are ordered by corpus frequency, rarest first. A block holds a share
    ``threshold`` of a template's distinct words only if it holds one of the
    template's first ``size - needed + 1`` words (prefix filter), if it has
    ``needed`` template words at all (length filter), and if enough words stand
    after the first common one on both sides (positional filter). Only the
    stretches around prefix words are looked at; in them the block moves on from
    one template word to the next with running counts.
    """

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float):
        words = sorted(vocabulary(templates), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(words)}
        self.templates, self.holders, prefix = [], [[] for _ in words], set()
        for text, label in templates.items():
            order = sorted({self.rank[w] for w in text.encode().split()})
            needed = max(1, math.ceil(threshold * len(order) - 1e-9))
            prefix.update(order[: len(order) - needed + 1])
            for token in order:
                self.holders[token].append(len(self.templates))
            self.templates.append((label, order, len(order), needed))
        self.prefix = prefix
        self.fewest = min((needed for *_, needed in self.templates), default=1)

    def stretches(self, words: list[bytes]) -> Iterator[list[tuple[int, int]]]:
        """``(position, rank)`` of the template words in each stretch that a block with a prefix word can lie in."""
        near = [(i, r) for i, r in ((i, self.rank.get(w)) for i, w in enumerate(words)) if r is not None]
        start, end, at = 0, -1, 0
        for place, (i, r) in enumerate(near):
            if r not in self.prefix:
                continue
            if end >= 0 and i - BLOCK >= end:
                yield [x for x in near[start:place] if x[0] < end]
                end = -1
            if end < 0:
                at = max(at, start)
                while near[at][0] <= i - BLOCK:
                    at += 1
                start = at
            end = i + BLOCK
        if end >= 0:
            yield [x for x in near[start:] if x[0] < end]

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """``(template, start, stop, containment)`` of all runs of blocks that meet the threshold.

        A run goes from the first word of its first block to the last of its
        last one; the containment is the best of its blocks. Blocks that start
        at a template word tell all: any other block holds no word more than
        the next of these, or than the text's last block.
        """
        found = []
        for stretch in self.stretches(words):
            held, common, runs = {}, [0] * len(self.templates), {}
            stop = 0
            for place, (start, first) in enumerate(stretch):
                while stop < len(stretch) and stretch[stop][0] < start + BLOCK:
                    token = stretch[stop][1]
                    held[token] = held.get(token, 0) + 1
                    if held[token] == 1:
                        for number in self.holders[token]:
                            common[number] += 1
                    stop += 1
                if len(held) >= self.fewest:
                    for number, (_, order, size, needed) in enumerate(self.templates):
                        if common[number] >= needed and self._can_reach(order, held, size, needed):
                            share = common[number] / size
                            last = min(start + BLOCK, len(words))
                            run = runs.get(number)
                            if run and start < run[2]:
                                runs[number] = (run[0], run[1], last, max(run[3], share))
                            else:
                                if run:
                                    found.append(run)
                                runs[number] = (number, start, last, share)
                held[first] -= 1
                if not held[first]:
                    del held[first]
                    for number in self.holders[first]:
                        common[number] -= 1
            found.extend(runs.values())
        return sorted(found)

    @staticmethod
    def _can_reach(order: list[int], held: dict[int, int], size: int, needed: int) -> bool:
        """Positional filter: what stands after the first common word on both sides."""
        place = next(i for i, token in enumerate(order) if token in held)
        return 1 + min(size - place - 1, sum(token > order[place] for token in held)) >= needed


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place where a phrase's words stand in a row."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        at, seen, number = line.find(wanted), 0, 0
        while at >= 0:
            number += line.count(b" ", seen, at)
            seen = at
            found.append((number, label))
            at = line.find(wanted, at + 1)
    return found


SCHEMA = (
    "n_words long, base array<struct<word: long, label: string>>, "
    "blocks array<struct<label: string, start: long, stop: long, containment: double>>"
)


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` (phrase places) and ``blocks`` (all that meet the threshold).

    Blocks of ``BLOCK`` words start at every word, to the end of every text;
    those of one notice are one run. Texts that are NULL or have no words have neither places nor blocks.
    Repeated rows are scanned alike; columns called like the new ones are
    replaced; an empty table gives an empty table.
    """
    templates = TEMPLATES if templates is None else templates
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "base", "blocks")))
    counts = token_counts(docs, vocabulary(templates), text)
    added = T.StructType.fromDDL(SCHEMA)
    schema, fields = T.StructType(docs.schema.fields + added.fields), list(arrow_schema(added))
    join = ContainmentJoin(templates, counts, threshold)

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        counts, base, blocks = [], [], []
        for x in texts:
            words = words_of(x)
            counts.append(len(words))
            base.append([{"word": at, "label": label} for at, label in sorted(phrase_places(words, PHRASES))])
            blocks.append([{"label": join.templates[n][0], "start": a, "stop": b, "containment": c} for n, a, b, c in join.blocks(words)])
        made = [pa.array(values, field.type) for values, field in zip((counts, base, blocks), fields)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(field.name for field in fields)])

    return map_text(docs, text, run, schema)


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts, labels and a score: 1 if a phrase stands in the text, else the best containment of a block.

    Texts that are NULL or empty have no words, empty labels and score 0. Equal
    rows get equal results, columns called like the new ones are replaced, an
    empty table gives an empty table.
    """
    found = scan(docs, text)
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("blocks", lambda b: b["label"]))))
    return found.withColumns(
        {
            "n_base": F.size("base").cast("long"),
            "first_word": F.array_min(F.transform("base", lambda b: b["word"])),
            "last_word": F.array_max(F.transform("base", lambda b: b["word"])),
            "base_labels": F.array_join(base, ","),
            "labels": F.array_join(every, ","),
            "score": F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))),
        }
    )
