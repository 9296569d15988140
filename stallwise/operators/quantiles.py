"""Exact quantiles of groups of any size, without gathering a group.

A first pass cuts each group at approximate quantiles and counts the rows between the cuts; that tells which cuts hold
the sought places. Only rows there are looked at again, counted by value, and ranked. So a task holds the distinct
values between two cuts, about one in `bins` of a group, and the result does not depend on where the cuts fell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.arrays import interpolated
from stallwise.operators.lineage import written


def levels(*wanted: float) -> Callable[[Column], Column]:
    """Places of quantile levels among n sorted values, linear between ranks."""
    return lambda n: F.array(*((n - 1) * F.lit(float(q)) for q in wanted))


def conformal_level(alpha: float) -> Callable[[Column], Column]:
    """Place of the finite-sample quantile: level ceil((n + 1)(1 - alpha)) / n, at most 1."""
    return lambda n: F.array(F.least(F.ceil((n + 1) * F.lit(1 - alpha)) / n, F.lit(1.0)) * (n - 1))


def below(cuts: Column, value: Column, most: int) -> Column:
    """How many of at most so many sorted cuts are less than a value, by halving."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when(F.get(cuts, at + s - 1) < value, s).otherwise(0))


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, places: Callable[[Column], Column], bins: int = 256, few: int = 1_000_000, n_rows: int | None = None) -> DataFrame:
    """(keys, n, q): q holds the values at the places (from 0, fractions between neighbours) of each group's sorted
    values that are not null. Groups without a value have no row; keys are not null. Up to `few` rows in all are
    gathered by group instead, which is quicker and gives the same; n_rows: their number at most, where it is known. Places
    may depend on the keys."""
    by = ["_g", *keys]
    own = rows.filter(F.col(value).isNotNull()).select(F.lit(0).alias("_g"), *keys, F.col(value).cast("double").alias("_v"))
    if (own.count() if n_rows is None else n_rows) <= few:
        gathered = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_v")).alias("_all"))
        return gathered.select(*keys, "n", F.transform(places(F.col("n")), lambda p: interpolated(F.col("_all"), p)).alias("q"))
    # Three jobs read the rows, which may be costly to make.
    own = own.persist()
    grid = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    cuts = written(own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", grid, F.lit(16 * bins)).alias("_cuts")))
    placed = own.join(cuts.select(*by, "_cuts"), by).select(*by, "_v", below(F.col("_cuts"), F.col("_v"), bins - 1).alias("_bin"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin"))
    counts = placed.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumn("_from", upto - F.col("_c"))
    ranks = F.array_distinct(F.flatten(F.transform(places(F.col("n")), lambda p: F.array(F.floor(p), F.ceil(p)))))
    wanted = cuts.select(*by, F.explode(ranks).alias("_rank")).join(counts, by).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_c")))
    wanted = written(wanted.select(*by, "_bin", "_from", "_rank"))
    inside = placed.join(wanted.select(*by, "_bin", "_from").distinct(), [*by, "_bin"]).groupBy(*by, "_bin", "_from", "_v").agg(F.count(F.lit(1)).alias("_c"))
    low = F.col("_from") + F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy("_v")) - F.col("_c")
    ranked = inside.withColumn("_low", low).drop("_from")
    met = wanted.drop("_from").join(ranked, [*by, "_bin"]).filter((F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_low") + F.col("_c")))
    found = met.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(p: Column) -> Column:
        a, b = F.element_at("_at", F.floor(p)), F.element_at("_at", F.ceil(p))
        return a + (b - a) * (p - F.floor(p))

    done = written(cuts.join(found, by).select(*keys, "n", F.transform(places(F.col("n")), between).alias("q")))
    own.unpersist()
    return done
