"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.keyword_pages import keyword_pages
from scoreloom.llm.leaks import find_leaks
from scoreloom.llm.pairs import pair_defects
from scoreloom.llm.residue import residue
from scoreloom.llm.tokens import encode_corpus
from scoreloom.llm.top_items import top_n_per_group
from scoreloom.llm.truncation import source_key, storage_limits
from scoreloom.sources.tables import table

#: Where the public vocabularies lie; a parameter, never part of this repository.
TOKENIZERS = "/opt/tokenizers"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "analyzed_results").select("prompt_type", "result_id", "reasoning_average", "run_timestamp")
    best = top_n_per_group(rows, "prompt_type", "reasoning_average", "result_id", 5, [F.col("run_timestamp").asc_nulls_last()])
    return best.select("prompt_type", "result_id")


def _pairs(spark: SparkSession, folder: str, only: tuple[str, str] | None = None) -> DataFrame:
    rows = table(spark, folder, "analyzed_results")
    return pair_defects(rows, "result_id", "question_text", ["response", "expected_answer"], "response", "model_name", only=only)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "analyzed_results")
    return residue(rows, "result_id", ["response", "error_explanation"]).select("result_id", "text_field")


def p3_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of each field are residue, by kind, and their mean matched share."""
    rows = table(spark, folder, "analyzed_results")
    found = residue(rows, "result_id", ["response", "error_explanation"])
    return found.groupBy("text_field", "kind").agg(F.count("*").alias("n_texts"), F.round(F.avg("share"), 6).alias("mean_share"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, ("response", "truncated")).select("result_id")


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The storage limits that the lengths of responses expose."""
    rows = table(spark, folder, "analyzed_results")
    return storage_limits(rows, "model_name", "response").select("source", "measure", "size", "n_texts")


def p4_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of truncated responses by model_name, written alike."""
    rows = table(spark, folder, "analyzed_results").select("result_id", source_key(F.col("model_name")).alias("source"))
    cut = p4_found(spark, folder).withColumn("cut", F.lit(1))
    joined = rows.join(cut, "result_id", "left")
    return joined.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count("cut").alias("n_truncated"), F.round(F.count("cut") / F.count("*"), 6).alias("truncated_share")
    )


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"), "doc_id", "text", "item_id", "text")


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 12 words of an item in a row with at most two character edits in them, as typing errors are."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"), "doc_id", "text", "item_id", "text", edits=2)


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaked item with its benchmark and the number of documents that hold it."""
    items = table(spark, folder, "benchmark_items").select("item_id", "benchmark")
    counts = p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return counts.join(items, "item_id").select("item_id", "benchmark", "n_documents")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_pages(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p3_excluded, p4_found, p4_limits, p4_share, p6_ids, p7_found, p7_near, p7_leaked_items, p8_found)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT prompt_type, result_id FROM (
                SELECT prompt_type, result_id, row_number() OVER (
                    PARTITION BY prompt_type
                    ORDER BY reasoning_average DESC, run_timestamp ASC NULLS LAST, result_id ASC) AS place
                FROM analyzed_results
                WHERE prompt_type IS NOT NULL AND reasoning_average IS NOT NULL AND NOT isnan(reasoning_average))
            WHERE place <= 5""",
    }
