"""The N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subgroups into which stage one splits each group.
SALTS = 32


def top_n_per_group(
    df: DataFrame,
    group: str,
    score: str,
    id_col: str,
    n: int,
    ties: Sequence[Column] = (),
    salts: int = SALTS,
) -> DataFrame:
    """The `n` rows of each group with the highest score.

    Rows are ordered by score descending, then by `ties`, then by `id_col`
    ascending, so the result is the same in every run. Stage one hashes each
    group into `salts` subgroups by `id_col` and keeps `n` rows of each; a group
    of any size is so spread over `salts` tasks, and Spark's group limit already
    drops rows before the shuffle. Stage two ranks at most `n * salts` survivors
    a group. The columns are those of `df`.

    Rows with a null group, or with a null or NaN score, are left out. Groups of
    fewer than `n` rows stay whole; repeated rows count one by one; an empty
    input gives an empty result. Extra columns pass through unchanged, those
    named like the working columns of this function included.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    salt, rank = "__salt", "__rank"
    while {salt, rank} & set(df.columns):
        salt, rank = salt + "_", rank + "_"
    value = F.col(f"`{score}`").cast("double")
    kept = df.where(F.col(f"`{group}`").isNotNull() & value.isNotNull() & ~F.isnan(value))
    order = [value.desc(), *ties, F.col(f"`{id_col}`").asc_nulls_last()]
    salted = kept.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).cast("int"))
    first = Window.partitionBy(F.col(f"`{group}`"), F.col(salt)).orderBy(*order)
    second = Window.partitionBy(F.col(f"`{group}`")).orderBy(*order)
    survivors = salted.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= n).drop(rank, salt)
    return survivors.withColumn(rank, F.row_number().over(second)).where(F.col(rank) <= n).drop(rank)
