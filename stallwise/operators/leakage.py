"""Checks that no feature knows the future."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.statistics import correlation
from stallwise.operators.numbering import numbered
from stallwise.operators.quantiles import exact_quantiles, levels


def varying_features(supervised: DataFrame, allowed: Sequence[str] = ("h", "discount", "activity_flag")) -> DataFrame:
    """(feature, groups): features that vary within a (series, origin), with how often; there should be none but those
    allowed, which are known ahead."""
    skip = {"series_id", "origin_date", "dt", "y", "y_observed", *allowed}
    names = [c for c in supervised.columns if c not in skip]
    varies = lambda c: (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) > 1
    each = supervised.groupBy("series_id", "origin_date").agg(*(varies(c).cast("int").alias(c) for c in names))
    wide = each.agg(*(F.sum(c).alias(c) for c in names))
    return wide.unpivot([], names, "feature", "groups").filter("groups > 0")


def lag_violations(panel: DataFrame, lagged: str, target: str, lag: int) -> DataFrame:
    """(rule, violations): first rows of a series whose lag is not null, and rows whose lag is not the value so many
    rows before."""
    w = Window.partitionBy("series_id").orderBy("dt")
    rows = panel.select(F.col(lagged).alias("got"), F.lag(target, lag).over(w).alias("true"), F.row_number().over(w).alias("n"))
    one = rows.agg(F.count_if((F.col("n") <= lag) & F.col("got").isNotNull()).alias("crosses_series"), F.count_if(~F.col("got").eqNullSafe(F.col("true"))).alias("wrong_value"))
    return one.unpivot([], one.columns, "rule", "violations")


def global_aggregates(train: DataFrame, full: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column): constant in training and equal to the mean over all rows, so filled from the future."""
    a = train.agg(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns))
    b = full.agg(*(F.avg(c).alias(f"{c}_mean") for c in columns))
    rows = a.crossJoin(b).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.low").cast("double").alias("low"), F.col(f"{c}.high").cast("double").alias("high"), F.col(f"{c}_mean").alias("mean")) for c in columns))).alias("x"))
    return rows.filter("x.low = x.high and abs(x.low - x.mean) < 1e-9").select("x.column")


def target_correlations(supervised: DataFrame, features: Sequence[str], threshold: float = 0.999, least: int = 30, every: bool = False) -> DataFrame:
    """(feature, corr, leaks): absolute correlation with the label, of features with enough pairs that vary; with every, of
    all features: NaN, which counts as a leak, where one side doesn't vary, and null without a pair."""
    stats = [F.struct(F.lit(c).alias("feature"), F.abs(correlation(F.col(c), F.col("y"))).alias("corr"), F.count_if(F.col(c).isNotNull() & F.col("y").isNotNull()).alias("n"), F.stddev_pop(c).alias("sd")).alias(c) for c in features]
    rows = supervised.agg(*stats).select(F.explode(F.array(*features)).alias("x"))
    kept = rows if every else rows.filter((F.col("x.n") >= least) & (F.col("x.sd") > 0))
    return kept.select("x.feature", "x.corr", (F.col("x.corr") >= threshold).alias("leaks"))


def shuffled(df: DataFrame, column: str, keys: Sequence[str] = ("series_id", "dt"), seed: int = 42) -> DataFrame:
    """The rows with a column's values dealt out anew over the whole table: the row that is n-th by its keys gets the value
    of the row that is n-th by the MD5 of its keys and the seed. Keys are unique and not null."""
    mark = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))
    left = numbered(df.drop(column), keys, "_n")
    right = numbered(df.select(F.col(column), mark.alias("_m")), ("_m",), "_n").drop("_m")
    return left.join(right, "_n").drop("_n")


def shuffle_test(fit_predict: Callable[[DataFrame, DataFrame], DataFrame], train: DataFrame, test: DataFrame, target: str = "y", ratio: float = 1.25, keys: Sequence[str] = ("series_id", "dt"), seed: int = 42) -> DataFrame:
    """One row: error of a model trained on true and on shuffled labels, and of the best constant. A model that does as
    well on shuffled labels, or better than a constant, has seen the test labels. fit_predict returns y_true, y_pred."""
    error = lambda df, name: df.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias(name))
    true, mixed = error(fit_predict(train, test), "mae"), error(fit_predict(shuffled(train, target, keys, seed), test), "mae_shuffled")
    median = exact_quantiles(train, [], target, levels(0.5)).select(F.col("q")[0].alias("median"))
    centre = train.agg(F.avg(target).alias("mean")).crossJoin(F.broadcast(median))
    constant = test.crossJoin(F.broadcast(centre)).agg(F.least(F.avg(F.abs(F.col(target) - F.col("mean"))), F.avg(F.abs(F.col(target) - F.col("median")))).alias("mae_constant"))
    one = true.crossJoin(mixed).crossJoin(constant)
    return one.withColumn("passes", (F.col("mae_shuffled") >= ratio * F.col("mae")) & (F.col("mae_shuffled") >= 0.95 * F.col("mae_constant")))


def fitted_elsewhere(learned: dict[str, float], train: DataFrame, full: DataFrame) -> DataFrame:
    """(feature, learned, train_mean, full_mean, leaks): means that an encoding has learned, which must not lie nearer to
    those of all rows than to those of the training rows."""
    means = lambda df, name: df.agg(*(F.avg(c).alias(c) for c in learned)).unpivot([], list(learned), "feature", name)
    known = train.sparkSession.createDataFrame(list(learned.items()), "feature string, learned double")
    met = known.join(means(train, "train_mean"), "feature").join(means(full, "full_mean"), "feature")
    return met.withColumn("leaks", F.abs(F.col("learned") - F.col("full_mean")) < F.abs(F.col("learned") - F.col("train_mean")))


def target_shift(result: DataFrame, shifts: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """(shift, mae): error of forecasts against labels moved by a day within each (model, origin, series); the aligned
    one must be the lowest."""
    w = Window.partitionBy("model", "origin", "series_id").orderBy("h")
    moved = result.select("model", "y_pred", *(F.lag("y_true", s).over(w).alias(f"s{s}") if s > 0 else F.lead("y_true", -s).over(w).alias(f"s{s}") if s else F.col("y_true").alias("s0") for s in shifts))
    rows = moved.select("model", F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), F.abs(F.col(f"s{s}") - F.col("y_pred")).alias("e")) for s in shifts))).alias("x"))
    return rows.groupBy("model", "x.shift").agg(F.avg("x.e").alias("mae"))


def future_shift(by_step: DataFrame, metric: str = "mae", slack: float = 0.02) -> DataFrame:
    """(model, early, late, passes): error of the later half of steps should not fall below the earlier half's."""
    middle = by_step.agg(F.max("h").alias("_h"))
    met = by_step.crossJoin(F.broadcast(middle))
    late = F.col("h") > F.col("_h") / 2
    sums = met.groupBy("model").agg(F.avg(F.when(~late, F.col(metric))).alias("early"), F.avg(F.when(late, F.col(metric))).alias("late"))
    return sums.withColumn("passes", F.col("late") >= F.col("early") * (1 - slack))


def unmatched_share(future: DataFrame, state: DataFrame) -> DataFrame:
    """One row: future rows and the share of them whose series has no state."""
    met = future.join(state.select("series_id", F.lit(True).alias("_s")).distinct(), "series_id", "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_s").isNull().cast("int")).alias("share"))


def smoke_violations(scored: DataFrame, expected_rows: int) -> DataFrame:
    """(rule, violations) of a scored grid: its size, missing or infinite predictions, negative ones."""
    p = F.col("y_pred")
    one = scored.agg(F.abs(F.count(F.lit(1)) - expected_rows).alias("row_count"), F.count_if(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))).alias("not_finite"), F.count_if(p < -1e-9).alias("negative"))
    return one.unpivot([], one.columns, "rule", "violations")
