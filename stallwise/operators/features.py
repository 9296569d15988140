"""Leak-proof features: all that is known at the close of a day, and the supervised matrix made from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.arrays import mean, spread
from stallwise.functions.calendar import calendar_columns

LAGS = (0, 1, 2, 3, 6, 7, 13, 14, 20, 21, 27, 28)
WINDOWS = (7, 14, 28)
HIERARCHY = ("store_id", "product_id", "third_category_id")
KNOWN_AHEAD = ("discount", "activity_flag")


def days():
    return Window.partitionBy("series_id").orderBy("dt")


def last_days(n: int):
    return days().rowsBetween(-(n - 1), 0)


def lag_features(target: str, prefix: str = "latent", lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"{prefix}_lag_{k}": F.lag(target, k).over(days()) if k else F.col(target) for k in lags}


def rolling_features(target: str, prefix: str = "latent", windows: Sequence[int] = WINDOWS) -> dict[str, Column]:
    """Mean, spread, extremes and median of the last n days, from max(2, n // 4) days on; the ratio of the 7- to the
    28-day mean, null where the long one is not positive."""
    out: dict[str, Column] = {}
    for n in windows:
        w, least = last_days(n), max(2, n // 4)
        enough = F.count(target).over(w) >= least
        for name, f in (("mean", F.avg(target)), ("std", F.stddev_samp(target)), ("max", F.max(target)), ("min", F.min(target)), ("median", F.percentile(target, F.lit(0.5)))):
            out[f"{prefix}_roll_{name}_{n}"] = F.when(enough, f.over(w))
    long = out[f"{prefix}_roll_mean_28"]
    out[f"{prefix}_momentum_7_28"] = F.when(long > 0, out[f"{prefix}_roll_mean_7"] / long)
    return out


def seasonal_features(target: str, prefix: str = "latent", season: int = 7, cycles: int = 4) -> dict[str, Column]:
    """Mean and spread of the same weekday in the last cycles, as far as there are any."""
    past = F.array(*(F.lag(target, season * k).over(days()) for k in range(1, cycles + 1)))
    return {f"{prefix}_dow_mean_{cycles}": mean(past), f"{prefix}_dow_std_{cycles}": spread(past)}


def intermittency_features(target: str) -> dict[str, Column]:
    """Share of zero days of 28, and days since the last sale (null before the first)."""
    at = F.row_number().over(days())
    last_sale = F.last(F.when(F.col(target) > 0, F.col("_at")), True).over(days())
    return {"_at": at, "zero_share_28": F.avg((F.col(target) <= 0).cast("int")).over(last_days(28)), "days_since_sale": F.col("_at") - last_sale}


def censoring_history() -> dict[str, Column]:
    out = {f"censored_share_{n}": F.avg(F.col("is_censored").cast("int")).over(last_days(n)) for n in (7, 28)}
    out["oos_hours_roll_7"] = F.when(F.count("oos_hours_day").over(last_days(7)) >= 2, F.avg("oos_hours_day").over(last_days(7)))
    return out


def exogenous_lags(columns: Sequence[str] = ("discount",), lags: Sequence[int] = (0, 1, 7)) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(days()) if k else F.col(c) for c in columns for k in lags}


def origin_state(panel: DataFrame, target: str = "demand_latent", exogenous: Sequence[str] = ("discount",)) -> DataFrame:
    """Every row with what was known at its close. All windows share one partitioning and order, so that the panel is
    shuffled and sorted once."""
    steps = intermittency_features(target)
    out = panel.withColumn("_at", steps.pop("_at"))
    out = out.withColumns({**lag_features(target), **rolling_features(target), **seasonal_features(target), **steps, **censoring_history(), **exogenous_lags(exogenous)})
    return out.drop("_at")


def origins(panel: DataFrame, horizon: int, min_train_days: int) -> DataFrame:
    """(origin_date): days with enough history before and a whole horizon after. Distinct days are few."""
    dates = panel.select("dt").distinct()
    order = Window.orderBy("dt")
    numbered = dates.select("dt", F.row_number().over(order).alias("n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("days"))
    return numbered.filter((F.col("n") >= min_train_days) & (F.col("n") <= F.col("days") - horizon)).select(F.col("dt").alias("origin_date"))


def training_origins(panel: DataFrame, horizon: int, warmup: int = max(LAGS) + 1, stride: int = 2, most: int = 20) -> DataFrame:
    """(origin_date): the latest origins with a whole horizon behind them, every stride-th, at most so many; the first days,
    where the long lags are missing, are none."""
    usable = origins(panel, horizon, warmup + 1)
    last = usable.agg(F.max("origin_date").alias("_last"))
    back = F.datediff("_last", "origin_date")
    return usable.crossJoin(F.broadcast(last)).filter((back % stride == 0) & (back < stride * most)).select("origin_date")


def supervised_matrix(state: DataFrame, panel: DataFrame, origin_dates: DataFrame, horizon: int, target: str = "demand_latent", how: str = "inner") -> DataFrame:
    """(series, origin, h) with the state at the origin, what is known ahead of the target day, its calendar and its
    labels. States are cut down to origins before they are repeated for each step."""
    carried = [c for c in state.columns if "_lag_" in c or "_roll_" in c or "_share_" in c or "_dow_" in c or c in ("latent_momentum_7_28", "days_since_sale")]
    at = state.join(F.broadcast(origin_dates), F.col("dt") == F.col("origin_date"), "left_semi")
    at = at.select("series_id", F.col("dt").alias("origin_date"), *carried, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    at = at.withColumn("dt", F.date_add("origin_date", F.col("h")))
    truth = panel.select("series_id", "dt", *HIERARCHY, *KNOWN_AHEAD, F.col(target).alias("y"), F.col("sale_amount").alias("y_observed"))
    return at.join(truth, ["series_id", "dt"], how).withColumns(calendar_columns())


#: Parts of the names that lagged features carry.
LAG_MARKS = ("_lag_", "_roll_", "_momentum_", "_dow_mean_", "_dow_std_", "zero_share_", "days_since_sale", "censored_share_", "oos_hours_roll_")


def lag_feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(m in c for m in LAG_MARKS)]
