"""Measures of uneven work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness(c: Column) -> Column:
    """Aggregate: the largest value over the mean, 1 if the mean is 0."""
    return F.when(F.avg(c) == 0, F.lit(1.0)).otherwise(F.max(c) / F.avg(c))


def _pearson(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's coefficient of two columns of doubles, null if either does not vary.

    Equal values are told by their extremes: merged partial deviations of equal
    values are often a little above 0 by rounding.
    """
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's coefficient, 0 if either side sums to 0 or does not vary."""
    a, b = a.cast("double"), b.cast("double")
    return F.when((F.sum(a) == 0) | (F.sum(b) == 0), F.lit(0.0)).otherwise(F.coalesce(_pearson(a, b), F.lit(0.0)))


def defined_correlation(a: Column, b: Column) -> Column:
    """Aggregate: 1 wherever Pearson's coefficient is defined, else 0; for plans made by analyzers that discard the coefficient."""
    r = _pearson(a.cast("double"), b.cast("double"))
    return F.when(r.isNotNull() & ~F.isnan(r), F.lit(1.0)).otherwise(F.lit(0.0))
