"""Registration of queries, and the result rows as every query sees them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns of scores; NaN in them means "no value", as null does.
SCORES = (
    "latency", "reasoning_accuracy", "reasoning_reasoning", "reasoning_completeness", "reasoning_explanation", "reasoning_cultural_context",
    "reasoning_average", "f1_score", "meteor_score", "bert_score", "exact_match", "rouge1_f", "rouge2_f", "rougel_f", "bleu", "bleu1", "bleu2", "bleu4",
)
LEGACY_SCORES = ("elapsed_time", "correctness_score", "reasoning_score", "confidence_score", "subject_score", "bias_correction", "consistency_score", "efficiency_score", "complexity_score")


def _sql_no_nan(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}"


#: The same rows in SQL: `r` are result rows, `p` legacy scored rows.
R = (
    "r AS (SELECT * REPLACE (lower(trim(model_name)) AS model_name, nullif(error_type, '') AS error_type, "
    "nullif(error_explanation, '') AS error_explanation, " + ", ".join(map(_sql_no_nan, SCORES)) + ") FROM analyzed_results)"
)
P = (
    "p AS (SELECT * REPLACE (lower(trim(model_name)) AS model_name, " + ", ".join(map(_sql_no_nan, LEGACY_SCORES)) + ") FROM processed_results)"
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def no_nan(c: str) -> Column:
    """The column with NaN as null."""
    return F.when(~F.isnan(c), F.col(c)).alias(c)


def _normalised(df: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    changed = {c: no_nan(c) for c in scores} | {"model_name": F.lower(F.trim("model_name"))}
    for c in ("error_type", "error_explanation"):
        if c in df.columns:
            changed[c] = F.nullif(F.col(c), F.lit(""))
    return df.withColumns(changed)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows: model names written alike, NaN and '' as null."""
    return _normalised(table(spark, folder, "analyzed_results"), SCORES)


def legacy(spark: SparkSession, folder: str) -> DataFrame:
    """Legacy scored rows, normalised the same way."""
    return _normalised(table(spark, folder, "processed_results"), LEGACY_SCORES)
