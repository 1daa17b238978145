"""Arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(c: Column) -> Column:
    """Six decimals, as sums depend on their order beyond that; never a negative zero.

    Means of a few decimals often lie halfway between two results; they go up.
    """
    return F.round(c + F.lit(1e-10), 6) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0; null where either is."""
    return F.when(b == 0, F.when(a.isNotNull(), 0.0)).otherwise(a.cast("double") / b.cast("double"))


def clamp01(c: Column) -> Column:
    """The value within 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def row_mean(*columns: str) -> Column:
    """Mean of the non-null values of a row; null if there is none."""
    present = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def number_equal(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Equality within a relative tolerance, or an absolute one if both are at most 1."""
    d = F.abs(a - b)
    big = (F.abs(a) > 1) | (F.abs(b) > 1)
    return F.when((a == 0) & (b == 0), True).when(big, d <= tolerance * F.greatest(F.abs(a), F.abs(b))).otherwise(d <= tolerance)


def fraction_equal(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a / b = c / d: by cross multiplication, or within 1e-4; null with a zero denominator."""
    close = F.abs(a.cast("double") / b - c.cast("double") / d) < 1e-4
    return F.when((b != 0) & (d != 0), (a * d == c * b) | close)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 96 of them suffice for 64-bit numbers."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step, lambda s: s["x"])


def let(f, *values: Column) -> Column:
    """f of the values, each computed once, however often f uses it.

    A column that a lambda uses is computed again for every element; bound to a
    lambda's own variable it isn't.
    """
    bound = F.array(F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values))))
    return F.get(F.transform(bound, lambda s: f(*(s[f"v{k}"] for k in range(len(values))))), F.lit(0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows that have both values; null where one of them doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
