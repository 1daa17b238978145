"""Scaling, principal components and clusters of performance figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.numbers import round6


def standardise(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Each metric less its mean over its population deviation; 0 if it doesn't vary, nulls count as 0 before."""
    rows = df.select(key, *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics))
    s = rows.agg(*(F.avg(m).alias(f"a_{m}") for m in metrics), *(F.stddev_pop(m).alias(f"s_{m}") for m in metrics))
    scaled = lambda m: F.when(F.col(f"s_{m}") > 0, (F.col(m) - F.col(f"a_{m}")) / F.col(f"s_{m}")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(s)).select(key, *(round6(scaled(m)).alias(m) for m in metrics))


def _vectors(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(metrics), outputCol="features").transform(standardise(df, key, metrics)).select(key, "features")


def components(df: DataFrame, key: str, metrics: Sequence[str], k: int = 2) -> DataFrame:
    """The first k principal components of each row; an empty table has none."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    if df.isEmpty():
        return df.select(key, *(F.lit(0.0).alias(f"pc{i + 1}") for i in range(k)))
    rows = _vectors(df, key, metrics)
    out = PCA(k=k, inputCol="features", outputCol="pc").fit(rows).transform(rows)
    return out.select(key, *(round6(vector_to_array("pc")[i]).alias(f"pc{i + 1}") for i in range(k)))


def clusters(df: DataFrame, key: str, metrics: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """The k-means cluster of each row; an empty table has none."""
    from pyspark.ml.clustering import KMeans

    if df.isEmpty():
        return df.select(key, F.lit(0).cast("bigint").alias("cluster"))
    rows = _vectors(df, key, metrics)
    return KMeans(k=k, seed=seed, featuresCol="features").fit(rows).transform(rows).select(key, F.col("prediction").cast("bigint").alias("cluster"))
