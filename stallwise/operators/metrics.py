"""Accuracy, interval and censoring metrics of backtest results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.arrays import quantile_name
from stallwise.operators.lineage import written
from stallwise.operators.quantiles import exact_quantiles, levels
from stallwise.operators.recovery import clean_day_bias, recensored_bias

TOLERANCE = 1e-9


def point_metrics(y: str = "y_true", p: str = "y_pred", scale: str = "naive_scale") -> dict[str, Column]:
    e, y_, p_ = F.abs(F.col(y) - F.col(p)), F.col(y), F.col(p)
    both = F.abs(y_) + F.abs(p_)
    return {
        "mae": F.avg(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": F.avg(p_ - y_),
        "mase": F.avg(e / F.col(scale)),
        "wape": F.when(F.sum(F.abs(y_)) > 0, F.sum(e) / F.sum(F.abs(y_))),
        "smape": F.coalesce(F.avg(F.when(both > 0, 2 * e / both)), F.lit(0.0)),
    }


def pinball(level: float, y: str, p: str) -> Column:
    gap = F.col(y) - F.col(p)
    return F.avg(F.greatest(level * gap, (level - 1) * gap))


def interval_metrics(low: str, high: str, alpha: float, y: str = "y_true") -> dict[str, Column]:
    inside = (F.col(y) >= F.col(low) - TOLERANCE) & (F.col(y) <= F.col(high) + TOLERANCE)
    miss = F.greatest(F.col(low) - F.col(y), F.lit(0.0)) + F.greatest(F.col(y) - F.col(high), F.lit(0.0))
    width = F.col(high) - F.col(low)
    return {"coverage": F.avg(inside.cast("int")), "width": F.avg(width), "interval_score": F.avg(width + 2 / alpha * miss)}


def by(result: DataFrame, *keys: str) -> DataFrame:
    return result.groupBy("model", *keys).agg(*(c.alias(n) for n, c in point_metrics().items()), F.count(F.lit(1)).alias("n"))


def rotation_bands(history: DataFrame, target: str = "demand_latent", low: float = 0.5, high: float = 0.85) -> DataFrame:
    """(series_id, rotation_band): low up to the median of the series' means, high beyond the upper quantile."""
    means = written(history.groupBy("series_id").agg(F.avg(target).alias("m")))
    cuts = exact_quantiles(means, [], "m", levels(low, high)).select("q")
    band = F.when(F.col("m") <= F.col("q")[0], "low").when(F.col("m") > F.col("q")[1], "high").otherwise("mid")
    return means.join(F.broadcast(cuts), F.lit(True), "left").select("series_id", F.col("m").alias("mean_demand"), band.alias("rotation_band"))


def by_band(result: DataFrame, bands: DataFrame) -> DataFrame:
    met = result.join(bands.select("series_id", "rotation_band"), "series_id", "left").withColumn("rotation_band", F.coalesce("rotation_band", F.lit("unknown")))
    return by(met, "rotation_band")


def summary(result: DataFrame) -> DataFrame:
    """Mean over origins of each origin's metric (not the pooled one), its spread, worst and best."""
    each = by(result, "origin")
    long = each.unpivot(["model", "origin"], ["mae", "rmse", "bias", "mase", "wape", "smape"], "metric", "value").filter("value is not null")
    return long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.max("value").alias("worst"), F.min("value").alias("best"), F.count(F.lit(1)).alias("n_origins"))


def improvement(table: DataFrame, baseline: str, metric: str = "mase", least_pct: float = 20.0) -> DataFrame:
    means = table.filter(F.col("metric") == metric).select("model", F.col("mean").alias("value"))
    ref = means.filter(F.col("model") == baseline).select(F.col("value").alias("ref"))
    pct = 100 * (1 - F.col("value") / F.col("ref"))
    return means.crossJoin(F.broadcast(ref)).select("model", "value", pct.alias("improvement_pct"), (F.col("value") < F.col("ref")).alias("beats"), (pct >= least_pct).alias("reaches_target"))


def quantile_metrics(result: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """(model, level, pinball, share_below): loss and calibration of each predicted quantile."""
    aggs = [c for q in levels for c in (pinball(q, "y_true", quantile_name(q)).alias(f"loss_{quantile_name(q)}"), F.avg((F.col("y_true") <= F.col(quantile_name(q)) + TOLERANCE).cast("int")).alias(f"below_{quantile_name(q)}"))]
    wide = result.groupBy("model").agg(*aggs)
    rows = F.array(*(F.struct(F.lit(q).alias("level"), F.col(f"loss_{quantile_name(q)}").alias("pinball"), F.col(f"below_{quantile_name(q)}").alias("share_below")) for q in levels))
    return wide.select("model", F.explode(rows).alias("x")).select("model", "x.*")


def coverage_report(result: DataFrame, alpha: float = 0.1, slack: float = 0.02, keys: tuple[str, ...] = ()) -> DataFrame:
    got = result.groupBy("model", *keys).agg(*(c.alias(n) for n, c in interval_metrics("pred_lo", "pred_hi", alpha).items()), F.count(F.lit(1)).alias("n"))
    return got.withColumns({"gap": F.col("coverage") - (1 - alpha), "reaches_nominal": F.col("coverage") >= 1 - alpha - slack})


def censoring_metrics(result: DataFrame) -> DataFrame:
    e = F.abs(F.col("y_true") - F.col("y_pred")) / F.col("naive_scale")
    return result.groupBy("model").agg(
        recensored_bias(F.col("y_observed"), F.col("y_pred"), F.col("available_weight")).alias("recensored_bias"),
        clean_day_bias(F.col("y_observed"), F.col("y_pred"), F.col("is_censored")).alias("clean_day_bias"),
        F.count_if(~F.col("is_censored")).alias("n_clean"),
        F.count_if("is_censored").alias("n_censored"),
        F.avg(F.when(~F.col("is_censored"), e)).alias("mase_clean"),
        F.avg(F.when(F.col("is_censored"), e)).alias("mase_censored"),
    )


def long_form(result: DataFrame, bands: DataFrame) -> DataFrame:
    """(model, cut, key, metric, value) over origins, steps and bands."""
    parts = [by(result, k).withColumn("cut", F.lit(k)).withColumn("key", F.col(k).cast("string")).drop(k) for k in ("origin", "h")]
    parts.append(by_band(result, bands).withColumn("cut", F.lit("band")).withColumnRenamed("rotation_band", "key"))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.unpivot(["model", "cut", "key"], ["mase", "wape", "mae", "rmse"], "metric", "value").filter("value is not null")


def model_groups(table: DataFrame, baseline: str) -> DataFrame:
    """Models whose point metrics agree to six decimals, as one group with its improvement over the baseline."""
    wide = table.groupBy("model").pivot("metric", ["mae", "mase", "rmse", "wape"]).agg(F.first("mean"))
    signature = F.concat_ws("|", *(F.round(c, 6).cast("string") for c in ("mae", "mase", "rmse", "wape")))
    groups = wide.withColumn("signature", signature).groupBy("signature").agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"), F.min("mase").alias("mase"))
    ref = wide.filter(F.col("model") == baseline).select(F.col("mase").alias("ref"))
    return groups.crossJoin(F.broadcast(ref)).select("models", "mase", (100 * (1 - F.col("mase") / F.col("ref"))).alias("improvement_pct"))


def band_verdict(value: Column, reference: Column, margin: float = 0.05) -> Column:
    return F.when(value < reference * (1 - margin), "better").when(value > reference * (1 + margin), "worse").otherwise("equal")
