"""Roundings and correlations that agree with SQL's on edge cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation of the pairs without a null; NaN where one side doesn't vary (there `F.corr` fails by a
    division by zero), null where there is no pair."""
    both = a.isNotNull() & b.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (a, b))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(spread == 0, float("nan")).otherwise(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def half_up(value: Column, places: int) -> Column:
    """A double that isn't negative, rounded as SQL rounds doubles: by its product with a power of ten, so that a value which
    the sum of doubles left a hair under a tie goes up; `F.round` goes by the shortest decimal and takes it down."""
    return F.floor(value * float(10**places) + 0.5) / float(10**places)
