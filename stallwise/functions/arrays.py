"""Column expressions over arrays: means, quantiles of small arrays, grids of quantile predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Mean of the elements that are not null; null of none."""
    kept = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, total(kept) / F.size(kept))


def spread(a: Column) -> Column:
    """Sample standard deviation of the elements that are not null; null of fewer than two."""
    kept = F.filter(a, lambda x: x.isNotNull())
    centre, n = mean(a), F.size(kept)
    return F.when(n > 1, F.sqrt(total(F.transform(kept, lambda x: (x - centre) * (x - centre))) / (n - 1)))


def interpolated(ordered: Column, place: Column) -> Column:
    """The element of a sorted array at a fractional place from 0."""
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.size(ordered) - 1)
    return F.get(ordered, low) + (F.get(ordered, high) - F.get(ordered, low)) * (place - low)


def quantile_name(level: float) -> str:
    """pred_qNN; the percent is rounded half to even."""
    return f"pred_q{round(100 * level):02d}"


def uncrossed(columns: Sequence[str]) -> Column:
    """Predicted quantiles, not below zero, in order."""
    return F.array_sort(F.array(*(F.greatest(F.col(c), F.lit(0.0)) for c in columns)))


def at_level(grid: Column, levels: Sequence[float], level: float) -> Column:
    """A quantile between predicted ones, linear between neighbours and flat beyond the ends."""
    if level <= levels[0]:
        return F.get(grid, F.lit(0))
    for k in range(1, len(levels)):
        if level <= levels[k]:
            part = (level - levels[k - 1]) / (levels[k] - levels[k - 1])
            return F.get(grid, F.lit(k - 1)) + (F.get(grid, F.lit(k)) - F.get(grid, F.lit(k - 1))) * part
    return F.get(grid, F.lit(len(levels) - 1))


def nearly_equal(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-6) -> Column:
    """Equal within tolerance; nulls are equal."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def arrays_nearly_equal(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: nearly_equal(x, y)), lambda x: x), F.lit(False))
