"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, lattice, lines, media, minhash, mixing, order, packing, quality, substring
from .common import table, tokenizer_path


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_texts(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.98, most_repeats=4.0)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.index(order.materialise(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).drop("_t", "_u")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_line_dedup, op3_source_mixing, op4_training_order, op5_minhash_near_dedup, op6_lm_scoring, op7_packing, op8_substring_dedup, op9_quality_rules, op10_html_extraction)}
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op8_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        places AS (SELECT r, w, unnest(range(len(w) - 34)) AS p FROM d WHERE len(w) >= 35),
        windows AS (SELECT r, p, array_to_string(w[p + 1 : p + 35], ' ') AS s FROM places),
        again AS (SELECT r, p, count(*) OVER (PARTITION BY s) AS n FROM windows),
        gone AS (SELECT r, list_distinct(flatten(list(range(p, p + 35)))) AS g FROM again WHERE n > 1 GROUP BY r),
        each AS (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS word FROM d),
        lost AS (SELECT r, unnest(g) AS p FROM gone),
        kept AS (SELECT e.r, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each e ANTI JOIN lost l ON e.r = l.r AND e.p = l.p GROUP BY e.r)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.r = k.r""",
    "op9_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
        places AS (SELECT r, w, unnest(range(len(w) - 2)) AS p FROM d WHERE len(w) >= 3),
        windows AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p + 1], w[p + 2], w[p + 3]) AS n FROM places),
        covered AS (SELECT r, len(list_distinct(flatten(list([p, p + 1, p + 2])))) AS k FROM windows WHERE n > 1 GROUP BY r),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(regexp_replace(t, '\\PL', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals,
            len(regexp_extract_all(t, '!')) AS n_exclamations, coalesce(k, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered ON d.r = covered.r),
        j AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
            + 16 * (NOT word_chars BETWEEN 2 * n_words AND 14 * n_words)::BIGINT + 32 * (100 * n_letters < 60 * word_chars)::BIGINT + 64 * (2 * n_capitals > n_letters)::BIGINT + 128 * (10 * n_exclamations > 3 * n_words)::BIGINT AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM j""",
}
