"""The operators bound to the driver tables, with SQL twins where DuckDB can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.llm import ballcodes, bpe, embeddings, hardneg, langid, licenses, mixing, quality, sharding, simhash, substrings, topk, toxicity
from pluvion.llm.base import held_out, table

QUERIES, ORACLES = {}, {}

#: The shared vocabulary file and the pattern that belongs to it.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes_of(table(spark, sf_dir, "documents"))
    return mixing.mixed_sizes(sized).select("doc_id", "size", "source_size", "target", "taken")


@query(
    r"""
    with parts as (
      select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
    ), starts as (
      select doc_id, w, unnest(case when len(w) >= 50 then range(1, len(w) - 48) else [] end) as s from parts
    ), windows as (
      select doc_id, s, sha256(array_to_string(w[s : s + 49], ' ')) as h from starts
    ), flagged as (
      select doc_id, s from windows qualify doc_id > min(doc_id) over (partition by h)
    ), gone as (
      select distinct doc_id, unnest(range(s, s + 50)) as p from flagged
    ), words as (
      select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from parts
    ), left_over as (
      select doc_id, count(*) as n_left, string_agg(word, ' ' order by p) as kept from words anti join gone using (doc_id, p) group by doc_id
    )
    select doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n_left, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from parts left join left_over using (doc_id)
    """
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN).select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _predicted(toxicity.score_texts(docs, model), 0.5)


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _predicted(quality.score_texts(docs, net), 0.3)


def _predicted(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query()
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query(
    """
    with usable as (
      select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
      select q.vec_id as query_id, r.vec_id, list_inner_product(q.v, r.v)::bigint as score
      from usable q join usable r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0
    ), ranked as (
      select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from scored
    )
    select query_id, rank, vec_id, score from ranked where rank <= 20
    """
)
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query(
    """
    with recursive unit as (
      select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
    ), links as (
      select a.vec_id as a, b.vec_id as b from unit a join unit b
        on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95
    ), reach as (
      select vec_id as node, vec_id as found from unit
      union
      select r.node, l.b from reach r join links l on l.a = r.found
    ), groups as (
      select node, min(found) as component_id from reach group by node
    )
    select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept
    from unit join groups on node = vec_id
    """
)
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query(
    r"""
    with parts as (
      select doc_id, list_filter(
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda x: x <> '') as w
      from documents
    ), words as (
      select doc_id, unnest(w) as word, unnest(range(0, len(w))) as p from parts
    ), ahead as (
      select doc_id, p, word, lead(word) over after as word2, lead(word, 2) over after as word3 from words
      window after as (partition by doc_id order by p)
    ), base as (
      select doc_id, p, case when word = 'cc' then 'cc-by' when word = 'general' then 'gpl' else 'reserved' end as label from ahead
      where (word = 'cc' and word2 = 'by') or (word = 'general' and word2 = 'public' and word3 = 'license')
        or (word = 'all' and word2 = 'rights' and word3 = 'reserved')
    ), templates as (
      select label, list_distinct(string_split(template, ' ')) as t from (values
        ('licensed under the apache license version 2 0', 'apache-2.0'),
        ('you may not use this file except in compliance with the license', 'apache-2.0'),
        ('released under the mit license', 'mit'),
        ('permission is hereby granted free of charge to any person obtaining a copy of this software', 'mit'),
        ('redistribution and use in source and binary forms with or without modification are permitted', 'bsd'),
        ('this work is licensed under the gnu general public license version 3', 'gpl'),
        ('this program is free software you can redistribute it and or modify it', 'gpl'),
        ('licensed under cc by nc 4 0', 'cc-by-nc'),
        ('licensed under a creative commons attribution 4 0 international license', 'cc-by'),
        ('licensed under a creative commons attribution sharealike 4 0 international license', 'cc-by-sa'),
        ('this work is dedicated to the public domain cc0 1 0', 'cc0'),
        ('this source code form is subject to the terms of the mozilla public license', 'mpl-2.0'),
        ('all rights reserved no part of this publication may be reproduced', 'reserved')) as given(template, label)
    ), tokens as (
      select number, label, len(t) as size, unnest(t) as word from (select row_number() over (order by label, t) as number, label, t from templates)
    ), occurs as (
      select doc_id, number, label, size, p, word from words join tokens using (word)
    ), shares as (
      select a.doc_id, a.label, a.size, a.number, a.p, count(distinct b.word) as common
      from occurs a join occurs b on a.doc_id = b.doc_id and a.number = b.number and b.p between a.p and a.p + 31
      group by a.doc_id, a.label, a.size, a.number, a.p
    ), near as (
      select doc_id, label, common::double / size as share from shares where common * 5 >= size * 4
    ), told as (
      select doc_id, label from base union select doc_id, label from near
    ), placed as (
      select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id
    ), named as (
      select doc_id, string_agg(label, ',' order by label) as labels from told group by doc_id
    ), best as (
      select doc_id, max(share) as share from near group by doc_id
    )
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
      coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(share, 0) end as score
    from parts left join placed using (doc_id) left join named using (doc_id) left join best using (doc_id)
    """
)
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.labelled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query()
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.select("doc_id", "text", "lang"))
    found = langid.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query(
    """
    with usable as (
      select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
      from embeddings
      where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
      select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
      from usable a join usable r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
    ), positives as (
      select anchor_id, other_id as positive_id, score as positive_score from scored where same
      qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
    )
    select anchor_id, positive_id, row_number() over within_window::integer as rank, s.other_id as negative_id, positive_score, s.score as negative_score
    from positives join scored s using (anchor_id)
    where not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score
    window within_window as (partition by anchor_id, positive_id order by s.score desc, s.other_id)
    qualify row_number() over within_window <= 5
    """
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


@query(
    """
    with kept as (
      select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), parts as (
      select vec_id, label, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] as x from kept, range(16) as places(p)
    ), book0 as (
      select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c
      from parts where vec_id in (select vec_id from kept order by vec_id limit 64)
    ), near1 as (
      select vec_id, p, any_value(x) as x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) ** 2))::bigint, e := e)) as best
      from parts join book0 using (p) group by vec_id, p
    ), means1 as (
      select p, e, list(m order by k) as c from (
        select p, best.e as e, k, floor(sum(x[k])::double / count(*))::bigint as m from near1, range(1, 1025) as t(k) where k <= len(x) group by all
      ) group by p, e
    ), book1 as (
      select p, e, coalesce(means1.c, book0.c) as c from book0 left join means1 using (p, e)
    ), near2 as (
      select vec_id, p, any_value(x) as x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) ** 2))::bigint, e := e)) as best
      from parts join book1 using (p) group by vec_id, p
    ), means2 as (
      select p, e, list(m order by k) as c from (
        select p, best.e as e, k, floor(sum(x[k])::double / count(*))::bigint as m from near2, range(1, 1025) as t(k) where k <= len(x) group by all
      ) group by p, e
    ), book2 as (
      select p, e, coalesce(means2.c, book1.c) as c from book1 left join means2 using (p, e)
    ), near3 as (
      select vec_id, p, any_value(label) as label, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) ** 2))::bigint, e := e)) as best
      from parts join book2 using (p) group by vec_id, p
    ), coded as (
      select vec_id, any_value(label) as label, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error
      from near3 group by vec_id
    ), told as (
      select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book2
    )
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, told
    """
)
def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ballcodes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
