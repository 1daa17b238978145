"""Windows, top-k, sampling and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.numbers import round6


#: A group is split at so many quantiles of its order.
SPLITS = 64


def rolling(df: DataFrame, key: str, order: Sequence[str], metric: str, size: int = 5) -> DataFrame:
    """Mean and deviation of the last `size` rows of each group; null before there are so many.

    Groups are split at quantiles of their first order column, a time or a number,
    and the last rows before each part are carried into it, so that no task holds a
    group. A null metric counts as a row without a value.
    """
    first = F.unix_micros(F.col(order[0]).cast("timestamp")) if dict(df.dtypes)[order[0]].startswith("timestamp") else F.col(order[0]).cast("double")
    rows = df.select(F.col(key).alias("__key"), *order, F.col(metric).alias("__metric"), first.alias("__at"))
    # The points at which a group is split: approximate, but the same for all its rows.
    cuts = rows.groupBy("__key").agg(F.array_sort(F.array_distinct(F.percentile_approx("__at", F.array(*(F.lit(k / SPLITS) for k in range(1, SPLITS))), F.lit(10 * SPLITS)))).alias("__cuts"))
    split = F.size(F.filter("__cuts", lambda c: c < F.col("__at")))
    rows = rows.join(cuts, "__key").select("__key", *order, "__metric", split.alias("__split"))
    one = F.struct(*order, "__metric")
    last = Window.partitionBy("__key", "__split").orderBy(*(F.desc(o) for o in order))
    ends = rows.withColumn("__place", F.row_number().over(last)).where(F.col("__place") < size)
    ends = ends.groupBy("__key", "__split").agg(F.array_sort(F.collect_list(one)).alias("ends"))
    # Every part has a row, so the parts before it that matter are at most size - 1.
    before = Window.partitionBy("__key").orderBy("__split").rowsBetween(1 - size, -1)
    carried = ends.select("__key", "__split", F.flatten(F.collect_list("ends").over(before)).alias("all"))
    carried = carried.select("__key", "__split", F.explode(F.slice(F.reverse("all"), 1, size - 1)).alias("r"))
    carried = carried.select("__key", *(F.col(f"r.{o}").alias(o) for o in order), F.col("r.__metric").alias("__metric"), "__split", F.lit(False).alias("__own"))
    rows = rows.select("__key", *order, "__metric", "__split", F.lit(True).alias("__own")).unionByName(carried)
    w = Window.partitionBy("__key", "__split").orderBy(*order).rowsBetween(1 - size, 0)
    full = F.count(F.lit(1)).over(w) == size
    out = rows.select(
        F.col("__key").alias(key), *order, round6(F.when(full, F.avg("__metric").over(w))).alias("rolling_mean"), round6(F.when(full, F.stddev_samp("__metric").over(w))).alias("rolling_std"), "__own"
    )
    return out.where("__own").drop("__own")


def last_n(df: DataFrame, key: str, order: Sequence[str], n: int, salts: int = 32) -> DataFrame:
    """The last n rows of each group, by subgroups first, so that no task holds a group."""
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    part = Window.partitionBy(key, salt).orderBy(*(F.desc(o) for o in order))
    rows = df.withColumn("__place", F.row_number().over(part)).where(F.col("__place") <= n)
    whole = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("__place", F.row_number().over(whole)).where(F.col("__place") <= n).drop("__place")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= n).drop("__place")


def question_spread(df: DataFrame, question: str, model: str, correct: Column) -> DataFrame:
    """For each question: mean, greatest difference and deviation of the models' accuracies, and how mixed they are."""
    per_model = df.where(F.col(question).isNotNull() & F.col(model).isNotNull()).groupBy(question, model).agg(F.avg(correct).alias("a"))
    g = per_model.groupBy(question).agg(F.count("*").alias("n_models"), F.avg("a").alias("m"), (F.max("a") - F.min("a")).alias("d"), F.stddev_samp("a").alias("s"))
    return g.select(
        question, "n_models", round6(F.col("m")).alias("accuracy"), round6(F.col("d")).alias("spread"), round6((0.5 - F.abs(F.col("m") - 0.5)) * F.col("s")).alias("mixedness")
    )


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of seed and key: the same in every run and engine."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key).limit(n)


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
