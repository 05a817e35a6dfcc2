"""Registered corpus queries and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from skysieve.llm.deleted_interpolation import interpolated_scores
from skysieve.llm.factorisation import quality_scores
from skysieve.llm.grace_dedup import grace_dedup
from skysieve.llm.hard_negatives import hard_negatives
from skysieve.llm.language_id import predict_language
from skysieve.llm.nn_descent import nearest_neighbours
from skysieve.llm.pattern_packing import pack_documents
from skysieve.llm.prefix_trie import prefix_trie, share_openings, turn_sequences
from skysieve.llm.shared import table
from skysieve.llm.simhash_ball import simhash_components
from skysieve.llm.source_mixing import mix_sources
from skysieve.llm.topk_search import top_k
from skysieve.llm.toxicity import toxicity_scores
from skysieve.llm.url_cascade import judge_urls

QUERIES, TWINS = {}, {}


def query(name: str, twin: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if twin:
            TWINS[name] = twin
        return fn

    return put


def queries():
    return dict(QUERIES)


def twins():
    return dict(TWINS)


#: The rules that the contract names.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query(
    "op8_url_filter",
    r"""
    WITH cut AS (
        SELECT page_id,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
        FROM pages
    ), parts AS (
        SELECT page_id, path,
               translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
        FROM cut
    ), rules(rule, rule_host, rule_path, rule_verdict) AS (
        VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
               ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
    ), ruled AS (
        SELECT p.*, (
            SELECT max_by(struct_pack(r := rule, v := rule_verdict), length(rule)) FROM rules
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ) AS best
        FROM parts p
    )
    SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM ruled
    """,
)
def op8(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in URL_RULES])
    rules = spark.range(1).select(F.inline(rows))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query(
    "op10_mix_sources",
    r"""
    WITH sizes AS (
        SELECT doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
        FROM documents
    ), per AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
        FROM sizes GROUP BY source
    ), lined AS (
        SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM per
    ), levels AS (
        SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM lined WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
    ), plan AS (
        SELECT source, source_size,
               CASE WHEN level * weight >= cap THEN cap
                    ELSE weight * max(CASE WHEN level * weight >= cap THEN NULL ELSE level END) OVER () END AS target
        FROM levels
    ), ordered AS (
        SELECT s.doc_id, s.size, p.source_size, p.target,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
    ), epochs AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS whole FROM ordered
    )
    SELECT doc_id, size, source_size, target,
           (whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)))::BIGINT AS taken
    FROM epochs
    """,
)
def op10(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op5_exact_dedup",
    r"""
    WITH norm AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM norm WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op5(spark, sf_dir):
    return grace_dedup(table(spark, sf_dir, "documents"))


@query("op2_simhash_dedup")
def op2(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3)


@query(
    "op4_topk_search",
    """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS w
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, vec_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM scored QUALIFY rank <= 20
    """,
)
def op4(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality")
def op9(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return predict_language(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_lm_scores")
def op6(spark, sf_dir):
    return interpolated_scores(table(spark, sf_dir, "documents"))


@query(
    "op11_prefix_trie",
    """
    WITH turns AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
               substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id
        FROM conversations WHERE conv_id IS NOT NULL
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS i FROM turns
    ), convs AS (
        -- crc32 of the decimal digits, bit by bit
        SELECT c, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda crc, x: list_reduce(
                [xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))
        ), 4294967295::BIGINT) % 9 AS h
        FROM (SELECT DISTINCT c FROM placed)
    ), rebuilt AS (
        SELECT k.c, 0 AS part, t.i, t.id, t.text FROM convs k JOIN placed t ON t.c = k.c - k.c % 5 AND t.i <= k.h
        UNION ALL
        SELECT k.c, 1, t.i, t.id, t.text FROM convs k JOIN placed t ON t.c = k.c AND t.i > k.h
    ), lined AS (
        SELECT c, id, octet_length(encode(text)) AS bytes, row_number() OVER (PARTITION BY c ORDER BY part, i) AS depth FROM rebuilt
    ), prefixes AS (
        SELECT c, depth, bytes, string_agg(id, '') OVER (PARTITION BY c ORDER BY depth) AS prefix FROM lined
        UNION ALL
        SELECT c, 0, 0, '' FROM convs
    ), nodes AS (
        SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM prefixes GROUP BY prefix, depth
    ), up AS (
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id
        FROM nodes n JOIN prefixes a ON a.c = n.conv_id AND a.depth = n.depth - 1 JOIN nodes p ON p.prefix = a.prefix
    ), kids AS (
        SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL
    ), known AS (
        SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.depth = n.depth
    ), below AS (
        SELECT a.prefix, sum((k.n_convs - 1) * k.bytes)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
        FROM known k JOIN prefixes a ON a.c = k.conv_id AND a.depth <= k.depth GROUP BY a.prefix
    ), ends AS (
        SELECT prefix, string_agg(c::VARCHAR, ',' ORDER BY c) AS members
        FROM (SELECT c, arg_max(prefix, depth) AS prefix FROM prefixes GROUP BY c) GROUP BY prefix
    )
    SELECT k.conv_id, k.depth, u.parent_conv_id, k.n_convs, k.n_children, b.n_leaves, b.saved_tokens,
           sha256(coalesce(e.members, '')) AS ends_sha256
    FROM known k JOIN below b ON b.prefix = k.prefix LEFT JOIN ends e ON e.prefix = k.prefix
    LEFT JOIN up u ON u.conv_id = k.conv_id AND u.depth = k.depth
    """,
)
def op11(spark, sf_dir):
    return prefix_trie(share_openings(turn_sequences(table(spark, sf_dir, "conversations"))))


@query(
    "op12_hard_negatives",
    """
    WITH usable AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS w
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.w, c.w)::BIGINT AS score
        FROM usable a JOIN usable c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
    QUALIFY rank <= 10
    """,
)
def op12(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query("op13_nearest_neighbours")
def op13(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
