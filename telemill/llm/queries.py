"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, decontaminate, fertility, line_frequency, lsh_forest, periodic_runs, rule_ensemble, source_mix, spelling, substring_dedup, surrogates,
    token_files, token_rollup,
)
from .common import shared_dir, staged, tuned

#: A key for surrogates over the test tables; a deployment passes its own secret.
KEY = "telemill-test-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = staged(token_rollup.count_tokens(table(spark, sf_dir, "documents")))
    return token_rollup.maintained(counts, "byte_bpe_50k/1", "byte_bpe_50k/2", shared_dir(spark))


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))
    docs = table(spark, sf_dir, "documents")
    counts = staged(docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("digest"), words.cast("long").alias("n_tokens")))
    return token_rollup.maintained(counts, "words/1", "words/2", shared_dir(spark))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.jaccard_join(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(decontaminate.index(table(spark, sf_dir, "documents")))
    return decontaminate.near_items(decontaminate.search(stored, table(spark, sf_dir, "benchmark"), slack=decontaminate.SLACK))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.page_lines(table(spark, sf_dir, "pages"))


def line_frequency_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.document_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars", "text")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(table(spark, sf_dir, "documents"), KEY).select("doc_id", "n_entities", "text")


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_ensemble.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.with_slips(spelling.letter_runs(table(spark, sf_dir, "documents")))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.with_repeats(table(spark, sf_dir, "documents")))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


_WORDS_SQL = """
WITH c AS (SELECT doc_id, source, lang, text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS copy FROM c)
SELECT source, lang, CASE WHEN lang = 'fr' THEN 'words/2' ELSE 'words/1' END AS tokenizer,
  count(*) AS n_docs, CAST(sum(n + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS BIGINT) AS n_tokens
FROM m WHERE NOT copy GROUP BY 1, 2, 3
"""

_BOILERPLATE_SQL = """
totals AS (SELECT host, count(*) AS pages FROM made WHERE host IS NOT NULL AND lines IS NOT NULL GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(list_filter(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> ''))) AS line FROM made WHERE host IS NOT NULL) GROUP BY host, line),
often AS (SELECT c.host, list(line) AS often FROM counts c JOIN totals t ON c.host = t.host WHERE pages >= 10 AND n > 0.1 * pages GROUP BY c.host),
done AS (SELECT made.*, CASE WHEN often IS NULL THEN lines ELSE list_filter(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13)) = '' OR NOT list_contains(often, x)) END AS stays FROM made LEFT JOIN often USING (host))
"""

_PAGES_SQL = (
    r"""
WITH made AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'),
    '(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|article|section|header|footer|main|title|head|body|html)(?:[ \t\n/][^>]*)?>', chr(10), 'g'),
    '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') AS lines FROM pages),
"""
    + _BOILERPLATE_SQL
    + """
SELECT page_id, host, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines), 0) - coalesce(len(stays), 0) AS n_dropped, array_to_string(stays, chr(10)) AS text FROM done
"""
)

_SOURCES_SQL = (
    "WITH made AS (SELECT doc_id, source, source AS host, string_split(text, chr(10)) AS lines FROM documents),"
    + _BOILERPLATE_SQL
    + "SELECT doc_id, source, length(array_to_string(stays, chr(10))) AS n_chars, array_to_string(stays, chr(10)) AS text FROM done"
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_tokenizer_fertility, op2_token_rollup, token_rollup_words, op3_byte_bpe, op4_ngram_jaccard_join, op5_benchmark_decontamination,
        op6_substring_dedup, op7_line_frequency, line_frequency_documents, op8_token_files, op9_pii_surrogates, op10_rule_ensemble,
        op11_spelling_variants, op12_periodic_runs, op13_source_mix,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"token_rollup_words": _WORDS_SQL, "op7_line_frequency": _PAGES_SQL, "line_frequency_documents": _SOURCES_SQL}
