"""Roundings and correlations on the edge cases where Spark's own functions fail or differ from SQL."""

import datetime as dt
from math import isnan

from pyspark.sql import functions as F

from stallwise.functions import statistics
from stallwise.operators import leakage, segments

DAY = dt.date(2024, 1, 1)


def test_a_column_that_does_not_vary_has_no_correlation_and_is_no_error(spark):
    rows = spark.createDataFrame([(h % 7.0, h % 7.0, 0.0, None, h % 7.0 if h % 2 else None) for h in range(40)], "y double, same double, flat double, none double, some double")
    found = {r["feature"]: r for r in leakage.target_correlations(rows, ["same", "flat", "none", "some"], least=10).collect()}
    assert set(found) == {"same", "some"} and all(abs(r["corr"] - 1) < 1e-12 and r["leaks"] for r in found.values())
    found = {r["feature"]: r for r in leakage.target_correlations(rows, ["same", "flat", "none"], every=True).collect()}
    assert isnan(found["flat"]["corr"]) and found["flat"]["leaks"] and found["none"]["corr"] is None and found["none"]["leaks"] is None
    mixed = spark.range(50).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * F.col("id") % 11).alias("b"))
    ours, theirs = mixed.agg(statistics.correlation(F.col("a"), F.col("b")), F.corr("a", "b")).first()
    assert abs(ours - theirs) < 1e-12


def test_shapes_of_a_series_that_never_moves(spark):
    rows = [("a", DAY + dt.timedelta(k), 2.0, False) for k in range(30)] + [("b", DAY + dt.timedelta(k), float(k % 7), False) for k in range(30)]
    panel = spark.createDataFrame(rows, "series_id string, dt date, demand_latent double, is_censored boolean")
    assert {r["series_id"]: round(r["autocorr_7"], 9) for r in segments.shape_features(panel).collect()} == {"a": 0.0, "b": 1.0}


def test_a_mean_a_hair_under_a_tie_goes_up_as_in_sql(spark):
    # The first is the mean of 0.96125 after sums of doubles.
    means = [0.9612499999999999, 0.95125, 0.9512, 0.95124, 1.0]
    rows = spark.createDataFrame([(m,) for m in means], "m double").select(statistics.half_up(F.col("m"), 4).alias("r"))
    assert [r["r"] for r in rows.collect()] == [0.9613, 0.9513, 0.9512, 0.9512, 1.0]
