"""Rolling-origin backtests of per-series forecasters: one job for all folds and models.

A forecaster is a function of what a series showed up to its origin. So the state of every day is computed once, over
one shuffle by series, cut down to the origins, and repeated for each step; no fold copies the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.functions.arrays import mean

SEASON, CYCLES, MOVING = 7, 4, 21


def folds(panel: DataFrame, horizon: int = 7, n_origins: int = 8, step: int = 3, min_train_days: int = 42) -> DataFrame:
    """(origin, origin_date, first_test, last_test): the latest origins, the last one leaving just one horizon."""
    dates = panel.select("dt").distinct().select("dt", F.row_number().over(Window.orderBy("dt")).alias("n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("days"))
    fit = F.floor((F.col("days") - min_train_days - horizon) / step) + 1
    enough = F.assert_true((F.col("days") >= min_train_days + horizon) & (fit >= n_origins), F.lit(f"the panel is too short for {n_origins} origins"))
    back = (F.col("days") - horizon - F.col("n")) / step
    picked = dates.filter(F.coalesce(enough.cast("boolean"), F.lit(True))).filter((back >= 0) & (back < n_origins) & (F.pmod(F.col("days") - horizon - F.col("n"), F.lit(step)) == 0))
    return picked.select((n_origins - 1 - back).cast("int").alias("origin"), F.col("dt").alias("origin_date"), F.date_add("dt", 1).alias("first_test"), F.date_add("dt", horizon).alias("last_test"))


def fold_violations(panel: DataFrame, fold_table: DataFrame, horizon: int = 7) -> DataFrame:
    """Folds that overlap their training days, are empty, or don't run from the day after the origin to its horizon."""
    bounds = panel.agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    met = fold_table.crossJoin(F.broadcast(bounds))
    bad = (F.col("first_test") != F.date_add("origin_date", 1)) | (F.col("last_test") != F.date_add("origin_date", horizon)) | (F.col("last_test") > F.col("last")) | (F.col("first") > F.col("origin_date"))
    return met.filter(bad).select("origin", "origin_date")


def croston_step(a: Column, y: Column, alpha: float) -> tuple[Column, Column, Column]:
    """Size, gap and days since the last sale after a day's demand y."""
    sold, fresh = y > 0, a["size"].isNull()
    size = F.when(sold, F.when(fresh, y).otherwise(alpha * y + (1 - alpha) * a["size"])).otherwise(a["size"])
    gap = F.when(sold, F.when(fresh, a["since"]).otherwise(alpha * a["since"] + (1 - alpha) * a["gap"])).otherwise(a["gap"])
    return size, gap, F.when(sold, 1.0).otherwise(a["since"] + 1.0)


def croston(values: Column, alpha: float = 0.1) -> Column:
    """Croston's intermittent forecast with the Syntetos-Boylan correction, folded over a series in order. The first
    interval counts from before the first day; a series without sales forecasts zero."""
    start = F.struct(F.lit(None).cast("double").alias("size"), F.lit(1.0).alias("gap"), F.lit(1.0).alias("since"))
    step = lambda a, y: F.struct(*(c.alias(n) for c, n in zip(croston_step(a, y, alpha), ("size", "gap", "since"))))

    return F.aggregate(values, start, step, lambda a: F.coalesce((1 - alpha / 2) * a["size"] / F.greatest(a["gap"], F.lit(1.0)), F.lit(0.0)))


def states(panel: DataFrame, fold_table: DataFrame, target: str = "demand_latent", whole_history: bool = False) -> DataFrame:
    """Per (origin, series): the last 28 values, the scale of MASE, the moments of the seasonal autoregression, and
    with whole_history all values up to the origin."""
    w = Window.partitionBy("series_id").orderBy("dt")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    y, season = F.col(target), F.lag(target, SEASON).over(w)
    cols = {
        "tail": F.collect_list(target).over(w.rowsBetween(-(SEASON * CYCLES - 1), 0)),
        "n_days": F.count(F.lit(1)).over(past),
        "level": F.avg(target).over(past),
    }
    if whole_history:
        cols["history"] = F.collect_list(target).over(past)
    moved = panel.select("series_id", "dt", y.alias(target), F.abs(y - season).alias("_step"), season.alias("_y7"))
    out = moved.withColumns(cols).withColumns({"scale": F.avg("_step").over(past), "_my": F.avg(F.when(F.col("_y7").isNotNull(), y)).over(past), "_mx": F.avg("_y7").over(past), "_mxy": F.avg(F.col("_y7") * y).over(past), "_mxx": F.avg(F.col("_y7") * F.col("_y7")).over(past)})
    at = out.join(F.broadcast(fold_table.select("origin", F.col("origin_date").alias("dt"))), "dt").withColumnRenamed("dt", "origin_date")
    slope = F.col("_mxy") - F.col("_mx") * F.col("_my")
    var = F.col("_mxx") - F.col("_mx") * F.col("_mx")
    at = at.withColumn("ar_slope", F.when(var > 1e-9, F.greatest(F.least(slope / var, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)).withColumn("ar_base", F.coalesce(F.col("_my") - F.col("ar_slope") * F.col("_mx"), F.col("level")))
    overall = at.groupBy("origin").agg(F.avg("scale").alias("_all"), F.avg("level").alias("global_level"))
    at = at.join(F.broadcast(overall), "origin").withColumn("naive_scale", F.greatest(F.coalesce("scale", "_all"), F.lit(1e-3)))
    return at.drop("_step", "_y7", "_my", "_mx", "_mxy", "_mxx", "_all", "scale", target)


def weekday_levels(panel: DataFrame, fold_table: DataFrame, target: str = "demand_latent") -> DataFrame:
    """(origin, series, weekday, profile): mean per weekday up to each origin, for the weekly-profile forecaster."""
    w = Window.partitionBy("series_id", F.weekday("dt")).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    days = panel.select("series_id", "dt", F.avg(target).over(w).alias("profile"))
    picked = days.join(F.broadcast(fold_table.select("origin", "origin_date")), (F.col("dt") <= F.col("origin_date")) & (F.datediff("origin_date", "dt") < SEASON))
    return picked.select("origin", "series_id", F.weekday("dt").alias("weekday"), "profile")


def croston_levels(panel: DataFrame, fold_table: DataFrame, target: str = "demand_latent", alpha: float = 0.1) -> DataFrame:
    """(origin, series_id, y_pred): Croston's forecast of each series at each origin. A series' days are folded once, in
    order, whatever the number of origins; a series is bounded by the calendar."""
    days = panel.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("dt", F.col(target).cast("double").alias("y")))).alias("d"))
    origins = fold_table.agg(F.map_from_entries(F.collect_list(F.struct("origin_date", "origin"))).alias("_origins"))
    start = F.struct(F.lit(None).cast("double").alias("size"), F.lit(1.0).alias("gap"), F.lit(1.0).alias("since"), F.array().cast("array<struct<origin:int,y_pred:double>>").alias("said"))

    def step(a: Column, x: Column) -> Column:
        size, gap, since = croston_step(a, x["y"], alpha)
        level = F.coalesce((1 - alpha / 2) * size / F.greatest(gap, F.lit(1.0)), F.lit(0.0))
        origin = F.element_at("_origins", x["dt"])
        said = F.when(origin.isNotNull(), F.concat(a["said"], F.array(F.struct(origin.alias("origin"), level.alias("y_pred"))))).otherwise(a["said"])
        return F.struct(size.alias("size"), gap.alias("gap"), since.alias("since"), said.alias("said"))

    met = days.crossJoin(F.broadcast(origins))
    return met.select("series_id", F.explode(F.aggregate("d", start, step, lambda a: a["said"])).alias("s")).select("s.origin", "series_id", "s.y_pred")


def forecasts(h: Column) -> dict[str, Column]:
    """What each baseline says for step h, from the columns of states; none is below zero."""
    tail, n, at = F.col("tail"), F.size("tail"), F.pmod(h - 1, F.lit(SEASON))
    average = mean(tail)
    padded = F.when(n >= SEASON - at, F.get(tail, n - SEASON + at)).otherwise(average)
    same_weekday = F.array(*(F.when(n >= SEASON * c - at, F.get(tail, n - SEASON * c + at)) for c in range(1, CYCLES + 1)))
    all_zero = F.forall(tail, lambda x: x <= 0)
    autoregression = F.when(F.col("n_days") < MOVING, F.col("global_level")).when(all_zero, 0.0).otherwise(F.col("ar_base") + F.col("ar_slope") * padded)
    said = {
        "naive": F.get(tail, n - 1),
        "seasonal_naive": padded,
        "moving_average": mean(F.slice(tail, F.greatest(n - MOVING + 1, F.lit(1)), MOVING)),
        "seasonal_moving_average": F.coalesce(mean(same_weekday), average),
        "seasonal_ar": autoregression,
        "zero": F.lit(0.0),
    }
    return {k: F.greatest(v, F.lit(0.0)) for k, v in said.items()}


def predicted(panel: DataFrame, fold_table: DataFrame, models: tuple[str, ...], horizon: int, target: str) -> DataFrame:
    """What each model says at each origin for each step: (origin, origin_date, series_id, h, dt, naive_scale, p), p
    being model and y_pred."""
    at = states(panel, fold_table, target)
    if "croston" in models:
        at = at.join(croston_levels(panel, fold_table, target).withColumnRenamed("y_pred", "_croston"), ["origin", "series_id"], "left")
    steps = at.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("dt", F.date_add("origin_date", F.col("h")))
    said = forecasts(F.col("h"))
    if "croston" in models:
        said["croston"] = F.coalesce("_croston", F.lit(0.0))
    if "weekly_profile" in models:
        # A weekday that a series has not had yet takes its level.
        profile = weekday_levels(panel, fold_table, target).withColumnRenamed("profile", "_profile")
        steps = steps.withColumn("weekday", F.weekday("dt")).join(profile, ["origin", "series_id", "weekday"], "left")
        said["weekly_profile"] = F.greatest(F.coalesce("_profile", "level"), F.lit(0.0))
    return steps.select("origin", "origin_date", "series_id", "h", "dt", "naive_scale", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), said[m].alias("y_pred")) for m in models))).alias("p"))


def beyond(panel: DataFrame, models: tuple[str, ...] = ("moving_average",), horizon: int = 7, target: str = "demand_latent") -> DataFrame:
    """(model, series_id, origin_date, h, dt, y_pred) for the days after the panel, from each series' state on its last
    day; no truth is joined. A panel without rows has no forecast."""
    last = panel.agg(F.max("dt").alias("origin_date")).filter("origin_date is not null").withColumn("origin", F.lit(0))
    return predicted(panel, last, models, horizon, target).select("p.model", "series_id", "origin_date", "h", "dt", "p.y_pred")


def backtest(panel: DataFrame, fold_table: DataFrame, models: tuple[str, ...] = ("naive", "seasonal_naive", "moving_average", "seasonal_moving_average"), horizon: int = 7, target: str = "demand_latent") -> DataFrame:
    """The backtest contract: a row per (model, origin, series, day) with truth, prediction and scale."""
    wide = predicted(panel, fold_table, models, horizon, target)
    truth = panel.select("series_id", "dt", F.col(target).alias("y_true"), F.col("sale_amount").alias("y_observed"), "available_weight", "is_censored")
    return wide.join(truth, ["series_id", "dt"]).select("p.model", "series_id", "origin", "h", "origin_date", "dt", "y_true", "p.y_pred", "y_observed", "available_weight", "naive_scale", "is_censored")


#: Columns of a backtest result and their types; limits are there only where intervals were made.
RESULT_TYPES = {"model": "string", "origin": "int", "origin_date": "date", "series_id": "string", "dt": "date", "h": "int", "y_true": "double", "y_pred": "double", "y_observed": "double", "is_censored": "boolean", "available_weight": "double", "naive_scale": "double"}
LIMIT_TYPES = {"pred_lo": "double", "pred_hi": "double"}


def empty_result(spark: SparkSession) -> DataFrame:
    """A result without rows, to start a union from."""
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in RESULT_TYPES.items()))


def cast_result(result: DataFrame) -> DataFrame:
    """The result's columns in their types, its own order and others as they are."""
    types = RESULT_TYPES | LIMIT_TYPES
    return result.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in result.columns))


def result_violations(result: DataFrame, horizon: int = 7) -> DataFrame:
    """(rule, violations) of the backtest contract."""
    rows = result.agg(
        F.count_if(F.col("dt") <= F.col("origin_date")).alias("not_after_origin"),
        F.count_if(F.datediff("dt", "origin_date") != F.col("h")).alias("step_is_wrong"),
        F.count_if(F.coalesce(F.col("naive_scale") <= 0, F.lit(True))).alias("scale_not_positive"),
        F.count_if(F.col("y_true").isNull() | F.col("y_pred").isNull()).alias("null_value"),
    )
    keys = result.groupBy("model", "origin", "series_id", "dt").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_key"))
    scales = result.groupBy("origin", "series_id").agg(F.min("naive_scale").alias("a"), F.max("naive_scale").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("scale_varies"))
    wide = rows.crossJoin(keys).crossJoin(scales)
    return wide.unpivot([], wide.columns, "rule", "violations")


def quantile_violations(result: DataFrame, names: Sequence[str], least_origins: int = 1) -> DataFrame:
    """(rule, violations) of predicted quantiles, by rising level, of intervals (pred_lo, pred_hi) where there are any,
    and of the number of origins."""
    crossed = sum((F.coalesce((F.col(b) < F.col(a) - 1e-9).cast("int"), F.lit(0)) for a, b in zip(names, names[1:])), F.lit(0))
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
    rules = {"quantiles_cross": F.coalesce(F.sum(crossed), F.lit(0)), "quantile_missing": F.count_if(missing), "too_few_origins": F.greatest(F.lit(least_origins) - F.count_distinct("origin"), F.lit(0))}
    if {"pred_lo", "pred_hi"} <= set(result.columns):
        rules["interval_inverted"] = F.count_if(F.col("pred_hi") < F.col("pred_lo") - 1e-9)
    one = result.agg(*(c.cast("long").alias(n) for n, c in rules.items()))
    return one.unpivot([], one.columns, "rule", "violations")
