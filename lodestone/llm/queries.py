"""Registered queries of this package: each numbered operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, decontaminate, exact_dedup, hamming_ann, hard_negatives, lexical_search, near_dedup, ngram_quality, sentencepieces, substring_dedup, toxicity, url_filters, warc
from .common import Scratch, read

#: The public tokenizer's model; operators take any path.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), URL_RULES, Scratch(spark, "op1"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(substring_dedup.repeated_paragraphs(read(spark, sf_dir, "documents"), Scratch(spark, "op3")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepieces.decode(sentencepieces.encode(docs, PIECES).drop("text"), PIECES)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    path = scratch.path("archives")
    warc.write(warc.plan_records(read(spark, sf_dir, "pages"), scratch), path)
    # Responses are decoded; of revisits, which a pushed filter picks by their headers, nothing is.
    responses = warc.load(spark, path, payload="digest").filter("record_type = 'response'")
    revisits = warc.load(spark, path, payload="none").filter("record_type = 'revisit'")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "op7"))


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(read(spark, sf_dir, "documents"), crc_fold(5) == 1, PIECES, Scratch(spark, "op8"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "op9"))
    return decontaminate.judge(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated"
    )


def crc_fold(n: int) -> Column:
    """crc32(doc_id as text) mod n, which assigns folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_fold(4) != 2)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(crc_fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 50 == 0, Scratch(spark, "op11"))


def op12_hamming_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark, "op13"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_paragraph_dedup": op3_paragraph_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_warc": op6_warc,
    "op7_ngram_quality": op7_ngram_quality,
    "op8_attention_lm": op8_attention_lm,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_hamming_ann": op12_hamming_ann,
    "op13_lexical_search": op13_lexical_search,
}

#: RULES in SQL. No page of the given tables has a canonical or refresh link, so there the rules alone decide (the tests have links).
RULES_SQL = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

ORACLE_SQL = {
    "op1_url_filters": rf"""
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), r(rule_host, rule_path, verdict) AS (VALUES {RULES_SQL}), f AS (
            SELECT page_id, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(verdict, len(rule_host || rule_path)) AS verdict
            FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
        )
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CAST(NULL AS BIGINT) AS component FROM p LEFT JOIN f ON p.page_id = f.page_id
    """,
    "op6_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
        ), d AS (
            SELECT *, sha1(payload) AS hex FROM p
        )
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(hex, CAST((5 * i) // 4 + 1 AS INT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM d
    """,
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op9_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS win
            FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)
        ), dw AS (
            SELECT doc_id, k, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS win
            FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
        ), hits AS (
            SELECT doc_id, k, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
        ), n AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS p FROM hits) GROUP BY doc_id
        ), i AS (
            SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
    "op11_hard_negatives": r"""
        WITH e AS (
            SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, n.vec_id AS other_id, a.label = n.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, n.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM e a JOIN e n ON a.vec_id % 50 = 0 AND a.vec_id <> n.vec_id
        ), p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER w <= 3
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), t AS (
            SELECT doc, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d
        ), f AS (
            SELECT doc, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY doc, term
        ), g AS (
            SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0
        ), q AS (
            SELECT item_id, term, count(*) AS repeats
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2.0 * CAST(any_value(docs) AS DOUBLE) + 2) / (2.0 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS weight FROM f, g GROUP BY term
        ), s AS (
            SELECT item_id, doc, any_value(doc_id) AS doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
            FROM q JOIN f USING (term) JOIN w USING (term), g GROUP BY item_id, doc
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """,
}
