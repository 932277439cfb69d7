"""A training corpus from raw documents: quality, boilerplate lines, near copies, test leaks, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import byte_bpe, decontaminate, line_frequency, lsh_forest, rule_ensemble
from telemill.llm.common import owned, removed, scratch, shared_dir
from telemill.llm.queries import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their source's boilerplate lines; copies, and most near copies, count as one document.

    They are told by the least hash of their five-word runs.  All in SQL functions.
    """
    return line_frequency.document_lines(docs, near_copies_as_one=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return lsh_forest.keep_one_of_each_group(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests: encoded and decoded again."""
    out = byte_bpe.round_trip(docs)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", leaks),
    ("byte_bpe", tokens),
]

#: SQL has neither the fitted classifier nor the tokenizer: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again by the next.

    A stage owns the folders that it stages; they go once its rows are written, and those rows once the next stage's are.
    Null and empty texts, an empty table, repeated rows and further columns pass as in the stages' operators: nothing is
    learned from an empty text, which has no lines, no near copies and no tokens.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = owned(shared_dir(spark))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
