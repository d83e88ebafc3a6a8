"""The operators' queries over the test tables, and DuckDB SQL where it can express one.

Each callable takes ``(spark, sf_dir)``, applies its operator to the whole
table and returns the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    bagminhash,
    bpe,
    decontamination,
    hard_negatives,
    lexical_search,
    pii,
    quality_model,
    quality_rules,
    substring_dedup,
    token_counts,
    token_output,
    toxicity,
    url_filter,
)
from .common import crc_mod, table

#: The rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TOXIC_FROM, QUALITY_FROM = 0.3, 0.5
#: Tokens of a context window, above which a document is over the limit.
CONTEXT_TOKENS = 1024


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, ranks))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as vocabulary:
        path = scratch_path(spark, "tokens")
        token_output.write_tokens(table(spark, sf_dir, "documents"), vocabulary.read(), path, end_id=1)
    return token_output.digests(spark, path)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup(table(spark, sf_dir, "documents")))


def _judged(scored: DataFrame, mod: int, remainder: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", mod) == remainder, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.not_held_out(4, 2))
    return _judged(toxicity.scored(docs, lexicon), 4, 2, TOXIC_FROM)


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _judged(quality_model.learn_and_score(docs, labels, toxicity.not_held_out(3, 1)), 3, 1, QUALITY_FROM)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.fit(docs)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as vocabulary:
        return token_counts.within_limit(table(spark, sf_dir, "documents"), vocabulary.read(), CONTEXT_TOKENS)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_byte_bpe,
        op3_token_output,
        op4_substring_dedup,
        op5_toxicity,
        op6_bagminhash,
        op7_quality_model,
        op8_personal_data,
        op9_url_filter,
        op10_quality_rules,
        op11_hard_negatives,
        op12_token_counts,
        op13_lexical_search,
    )
}

ORACLE_SQL = {
    "op9_url_filter": r"""
        WITH rules(rule_host, rule_path, action) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), urls AS (
            SELECT row_number() OVER () AS row_id, page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), fitting AS (
            SELECT row_id, rule_host || rule_path AS rule, action,
                row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC, action DESC) AS nth
            FROM urls, rules
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
        FROM urls LEFT JOIN fitting ON urls.row_id = fitting.row_id AND nth = 1
    """,
    "op10_quality_rules": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
        ), parts AS (
            SELECT row_id, doc_id, text,
                regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                regexp_extract_all(text, '[^\n]*[^\x20\x09-\x0D][^\n]*') AS lines
            FROM texts
        ), grams AS (
            SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
            FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts)
        ), repeats AS (
            SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM grams) WHERE n > 1
        ), covered AS (
            SELECT row_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM repeats) GROUP BY row_id
        ), measures AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_shouts,
                CAST(len(lines) AS BIGINT) AS n_lines,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
            FROM parts LEFT JOIN covered USING (row_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 8 * word_chars
                OR 100 * n_shouts > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
                OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
        FROM measures
    """,
    "op11_hard_negatives": r"""
        WITH kept AS (
            SELECT row_number() OVER () AS row_id, vec_id,
                CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, b.row_id,
                CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM kept a, kept b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, row_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER each AS INTEGER) AS rank,
            other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW each AS (PARTITION BY anchor_id, positives.row_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER each <= 5
    """,
    "op13_lexical_search": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS row_id, doc_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), totals AS (
            SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_all FROM texts WHERE len(terms) > 0
        ), counts AS (
            SELECT row_id, doc_id, CAST(len(terms) AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf
            FROM (SELECT row_id, doc_id, terms, unnest(terms) AS term FROM texts) GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
        ), items AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), scored AS (
            SELECT item_id, row_id, doc_id,
                CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all)))) AS BIGINT) AS score
            FROM items JOIN counts USING (term) JOIN weights USING (term), totals
            GROUP BY item_id, row_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER each AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW each AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER each <= 10
    """,
}
