"""The registered queries of the training-data operators, under their contracts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costsieve.llm import (
    bitslice,
    bpe,
    chat,
    ctw,
    decontaminate,
    divergence,
    filter_audit,
    langid,
    licenses,
    mixing,
    paragraphs,
    pii,
    simhash,
)
from costsieve.llm.common import crc_mod, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_matches(docs, read_table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.filter(F.col("matches")["item_id"], lambda x: x.isNotNull())))
    n_hit = decontaminate.hit_words(F.col("matches"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), n_hit).alias("contaminated"))


@query
def op10_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = langid.train(langid.training_sample(docs, ~held_out))
    found = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 7) == 2
    found = ctw.score(docs, ~held_out)
    return found.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score", "bits_per_byte")


@query
def op3_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE["op3_bit_sliced_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op6_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_log(chat.log_of_turns(turns.unionByName(own))))


ORACLE["op6_event_sourced_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + 2 * length(role) - length(regexp_replace(role, '[\\#<\n]', '', 'g'))
    + 2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op8_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"), licenses.label_list(base).alias("base_labels"),
        licenses.label_list(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.col("places")["share"]), F.lit(0.0)).alias("score"))


ORACLE["op8_rare_token_licenses"] = r"""
WITH t(label, k, w, base) AS (VALUES
  ('mit', 'under the mit license', 'released under the mit license', true),
  ('apache-2', 'apache license version 2', 'licensed under the apache license version 2 0', true),
  ('cc-by-nc', 'cc by nc', 'licensed under cc by nc 4 0', true),
  ('gpl-3', 'gnu general public license version 3', 'this work is licensed under the gnu general public license version 3', false),
  ('gpl-2', 'gnu general public license version 2', 'this work is licensed under the gnu general public license version 2', false),
  ('lgpl', 'gnu lesser general public license', 'the terms of the gnu lesser general public license', false),
  ('agpl', 'gnu affero general public license', 'the terms of the gnu affero general public license', false),
  ('mpl-2', 'mozilla public license', 'subject to the terms of the mozilla public license v 2 0', false),
  ('cc-by-sa', 'cc by sa', 'licensed under cc by sa 4 0', false),
  ('cc0', 'cc0 1 0 universal', 'creative commons cc0 1 0 universal', false),
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy', 'permission is hereby granted free of charge to any person obtaining a copy of this software', false),
  ('bsd', 'redistribution and use in source and binary forms', 'redistribution and use in source and binary forms with or without modification are permitted', false),
  ('isc', 'permission to use copy modify and or distribute this software', 'permission to use copy modify and or distribute this software for any purpose with or without fee', false),
  ('unlicense', 'free and unencumbered software', 'this is free and unencumbered software released into the public domain', false)
), ts AS (
  SELECT label, base, k AS phrase, string_split(k, ' ') AS k, string_split(w, ' ') AS w,
    len(string_split(string_split(' ' || w || ' ', ' ' || k || ' ')[1], ' ')) - 1 AS ahead FROM t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), c AS (
  SELECT d.r, d.w, ts.label, ts.base, ts.k, ts.w AS line, ts.ahead FROM d JOIN ts
    ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || ts.phrase || ' ')
), p AS (
  SELECT r, w, label, base, line, ahead, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(k)] = k)) AS start FROM c
), s AS (
  SELECT r, label, base, start, len(list_filter(range(len(line)), lambda j: start - ahead + j >= 0 AND w[start - ahead + j + 1] = line[j + 1])) / len(line) AS share FROM p
), g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM s GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (r)
"""

ORACLE["op9_suffix_array_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(len(w) - least(13, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, p, n, array_to_string(w[p + 1:p + n], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT r, p, n, item_id FROM dw JOIN bw USING (n, win)
), words AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


SURROGATE_KEY = b"corpus surrogate key"


@query
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, SURROGATE_KEY)[0]


@query
def op7_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


@query
def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)


@query
def op11_filter_decision_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.text_audit(docs, read_table(spark, sf_dir, "labels"))


ORACLE["op11_filter_decision_diagrams"] = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM documents
), m AS (
  SELECT part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM d
), g AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f
), l AS (
  SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT array_to_string(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, i AS step, o[i] AS v, o[1:i - 1] AS before FROM o, l
), r AS (
  SELECT part, filter_order, step, v, n, good, toxic, len(list_filter(before, lambda x: f[x])) = 0 AS here, f[v] AS fails,
    len(list_filter(f, lambda x: x)) = 1 AS alone FROM g, s
), a AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, v, CAST(coalesce(sum(n) FILTER (here AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (here AND fails), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND NOT here), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails AND alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (here AND fails), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (here AND fails), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley FROM a
"""


@query
def op12_byte_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)
    return found.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), grp AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT grp.lang, grp.source, k.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (grp.n + 2 * v.v))::BIGINT AS p
  FROM grp JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = k.term
), lt AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL
), q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (lt.n + 2)) // (sum(lt.n) OVER (PARTITION BY lang) + 2 * v.v))::BIGINT AS q FROM lt JOIN v USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL BY NAME
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term QUALIFY rank <= 10
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
